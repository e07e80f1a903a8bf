"""Every registered query against its DuckDB twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
from verification import check

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check.duck(SF_DIR)


@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query(spark, connection, name):
    verdict = check.compare(spark, connection, SF_DIR, name)
    assert verdict.startswith("ok") or "no twin" in verdict, verdict


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "masked", "entities", "n_entities", "is_masked"] and df.count() > 0


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    untold = set(entry.QUERIES) - set(entry.ORACLE)
    assert untold == {"toxicity_model", "bundle_model", "embedding_head"}
