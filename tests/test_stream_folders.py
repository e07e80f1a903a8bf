"""Streams of tables that are a folder of files each, as large ones are."""

import pytest

from verification.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The tables as folders of three files."""
    path = tmp_path_factory.mktemp("folders")
    for name in ("documents", "conversations", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["stream_first_arrivals", "stream_newest", "stream_screening", "stream_pairs", "stream_windows"])
def test_a_folder_streams_as_its_files_do(spark, folders, name):
    one, many = (QUERIES[name](spark, path).collect() for path in (SF, folders))
    assert one and sorted(map(str, many)) == sorted(map(str, one))
