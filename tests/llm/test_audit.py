import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from textward.llm import audit, queries

from .conftest import SF


def plain_words(text):
    return (text or "").encode("utf-8").split()


def plain_fails(docs):
    """For each document (id, text, part) the set of filters it fails."""
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    out = []
    for d, text, _ in docs:
        t, w = text or "", plain_words(text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t],
        }
        out.append({f for f, failed in fails.items() if failed})
    return out


def plain_audit(docs, fails, good, toxic):
    """Rows of the audit, by applying the filters in every order to every document."""
    rows = {}
    for part in {p or "" for _, _, p in docs}:
        mine = [(d, f) for (d, _, p), f in zip(docs, fails) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = mine, []
            for step, name in enumerate(order, 1):
                removed = [(d, f) for d, f in left if name in f]
                redundant = sum(name in f for _, f in gone)
                left, gone = [x for x in left if name not in x[1]], gone + removed
                shapley[name] += len(removed)
                rows[part, "".join(order), step] = [
                    len(left), len(removed), redundant, sum(f == {name} for _, f in mine),
                    sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed),
                ]
        for (p, order, step), counts in rows.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return rows


def check(spark, docs, labels, got):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    want = plain_audit(docs, plain_fails(docs), good, toxic)
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert [r[c] for c in audit.COUNTS] == want[r.part, r.filter_order, r.step], r
    assert all(t == "bigint" for c, t in got.dtypes if c in audit.COUNTS)


def test_query_against_every_order(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    check(spark, docs, labels, queries.op11_filter_audit(spark, SF))


def test_random_documents_and_labels(spark):
    rng = random.Random(11)
    docs = []
    for i in range(300):
        many = rng.choice([5, 150, 199, 200, 201, 300])
        text = " ".join(rng.choice(["word", "Word", f"w{j}", "x"]) for j in range(many)) + rng.choice(["", "", " #", "|"])
        docs.append((i, text, rng.choice(["a", "b", None, ""])))
    docs += [(300 + i, docs[rng.randrange(40)][1], "a") for i in range(60)] + [(5, docs[7][1], "b"), (5, docs[7][1], "b")]
    labels = [(rng.randrange(380), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)] + [(None, 1, 1)]
    check(
        spark, docs, labels,
        audit.interactions(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")),
    )


def test_odd_rows(spark, odd, none):
    labels = [(2, 1, 0), (3, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    renamed = odd.withColumnRenamed("size", "row").withColumnRenamed("fp", "part").withColumnRenamed("lang", "fails")
    check(spark, docs, labels, audit.interactions(renamed, table))
    check(spark, docs, [], audit.interactions(odd, table.limit(0)))
    assert audit.interactions(none, table).count() == 0


def test_other_filters(spark):
    docs = spark.createDataFrame([(i, "t" * i, "p") for i in range(10)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = audit.interactions(docs, labels, {"odd": F.col("doc_id") % 2 == 1, "small": F.col("doc_id") < 4}).collect()
    assert len(rows) == 6 * 3
    first = {r.filter_order: r for r in rows if r.step == 1}
    assert (first["oddsmallE"].removed, first["smalloddE"].removed, first["smalloddE"].kept, first["oddsmallE"].unique_fails) == (5, 4, 6, 3)
    with pytest.raises(ValueError):
        audit.audit(docs, {}, {})
