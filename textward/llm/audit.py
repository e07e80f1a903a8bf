"""What filters do to each other, whatever the order they are applied in.

Each filter is a relation: the ids of the documents that fail it. Everything else follows from the
relations by left-anti and left-semi joins, for every set of filters that can stand before a step.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textward.functions.planning import bind
from textward.llm.common import words
from textward.session import staged

# Filters of an audit at most; steps and prefixes grow with the factorial of their number.
MOST_FILTERS = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by name, null texts taken as empty: A few words, B repetitive words, C capitals,
    D symbols."""
    text = F.coalesce(text, F.lit(""))
    word = bind(words(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": word["n"] < 200,
        "B": 100 * word["distinct"].cast("long") < 50 * word["n"].cast("long"),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def judged(docs: DataFrame, filters: dict[str, Column], id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(row, id, part, fails, copy_of) of documents, written: ``row`` tells rows apart, ``fails`` has the names of
    the filters a row fails, and ``copy_of`` a hash that texts share if they are identical."""
    fails = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in filters.items()]))
    return staged(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), fails.alias("fails"),
        F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)).alias("copy_of"),
    ), "judged")


def copies(rows: DataFrame) -> DataFrame:
    """(row) of the judged rows whose text is identical to that of a row with a smaller id; a null id is
    neither smaller nor larger than another."""
    first = rows.groupBy("copy_of").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = staged(first, "first")  # so that both sides of the join come by shuffles, and a hot text can be split
    return rows.select("row", "id", "copy_of").join(first, "copy_of").where("id > first").select("row")


def labelled(rows: DataFrame, labels: DataFrame, id: str = "doc_id") -> dict[str, DataFrame]:
    """(row) of the judged rows with a label: good_lost for quality 1, toxic_lost for toxic 1."""
    tables = {}
    for name, holds in (("good_lost", "quality = 1"), ("toxic_lost", "toxic = 1")):
        ids = labels.where(holds).select(F.col(f"`{id}`").alias("id"))
        tables[name] = rows.select("row", "id").join(ids, "id", "left_semi").select("row")
    return tables


def audit(rows: DataFrame, failing: dict[str, DataFrame], labels: dict[str, DataFrame]) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included: (part, filter_order, step) and
    COUNTS, all long.

    ``rows`` has (row, part) with distinct rows; ``failing`` the rows (row) that fail each filter, by its name;
    ``labels`` the rows of each label. Of a step: ``kept`` are the survivors after it, ``removed`` those it
    takes, ``redundant`` those that fail its filter and are gone already; ``good_lost`` and ``toxic_lost`` are
    removed rows with the label. Of a filter: ``unique_fails`` fail no other one, and ``shapley`` is what it
    removes, summed over all orders. A table without rows has no part, and gives no row.

    How. What a step does depends on the set of filters before it, not on their order. Each failing id is
    taken once for each such set and left-anti joined with the relations of that set: what is left is removed;
    left-semi joined, redundant. The survivors of each set come from left-anti joins alike; rows that fail
    nothing survive all and are counted once. All these joins are on the row, so ids are shuffled once and
    taken for the sets after it; rows are distinct, and no key is hot. Only counts go further.
    """
    names = sorted(failing)
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters")
    bit = {name: 1 << i for i, name in enumerate(names)}
    every = (1 << len(names)) - 1
    failing = {name: staged(table.select("row").distinct(), f"failing-{name}") for name, table in failing.items()}
    rows = rows.select("row", "part")
    fails = reduce(DataFrame.unionByName, [t.withColumn("filter", F.lit(bit[name])) for name, t in failing.items()])
    anyone = reduce(DataFrame.unionByName, failing.values())
    held = staged(rows.join(anyone, "row", "left_semi"), "held")
    fails = staged(fails.join(held, "row"), "fails")

    def taken(df: DataFrame, sets: Column) -> DataFrame:
        """The rows of a table once for each of the sets, where the row's joins take place."""
        return df.repartition(F.col("row")).withColumn("before", F.explode(sets))

    def without(df: DataFrame) -> DataFrame:
        """The rows that fail none of the filters in their set."""
        for name, table in failing.items():
            mine = table.withColumnRenamed("row", "_row")
            df = df.join(mine, (F.col("row") == F.col("_row")) & (F.col("before").bitwiseAND(F.lit(bit[name])) > 0), "left_anti")
        return df

    all_sets = F.sequence(F.lit(0), F.lit(every))
    earlier = F.filter(all_sets, lambda s: s.bitwiseAND(F.col("filter")) == 0)
    cases = [fails.withColumn("kind", F.lit("removed"))]
    cases += [fails.join(table, "row", "left_semi").withColumn("kind", F.lit(name)) for name, table in labels.items()]
    by = ["part", "before", "filter"]
    removed = without(taken(reduce(DataFrame.unionByName, cases), earlier))
    counted = removed.groupBy(*by).pivot("kind", ["removed", "good_lost", "toxic_lost"]).count()
    gone = fails.select(F.col("row").alias("_row"), F.col("filter").alias("_filter"))
    redundant = taken(fails, earlier).join(
        gone, (F.col("row") == F.col("_row")) & (F.col("before").bitwiseAND(F.col("_filter")) > 0), "left_semi"
    ).groupBy(*by).agg(F.count("*").alias("redundant"))
    survivors = without(taken(held, all_sets)).groupBy("part", F.col("before").alias("after")).agg(F.count("*").alias("survivors"))
    clean = rows.join(anyone, "row", "left_anti").groupBy("part").agg(F.count("*").alias("clean"))

    step = F.explode(F.array(*[
        F.struct(F.lit(s).alias("before"), F.lit(b).alias("filter"), F.lit(s | b).alias("after"))
        for b in bit.values() for s in range(every + 1) if not s & b
    ]))
    table = rows.select("part").distinct().select("part", step.alias("s")).select("part", "s.*")
    table = table.join(counted, by, "left").join(redundant, by, "left").join(survivors, ["part", "after"], "left").join(clean, "part", "left")
    table = table.na.fill(0).withColumn("kept", F.col("clean") + F.col("survivors"))
    before = F.bit_count("before")
    orders = F.get(F.array(*[F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names))]), before)
    mine = Window.partitionBy("part", "filter")
    table = table.withColumns({
        "unique_fails": F.sum(F.when(before == len(names) - 1, F.col("removed")).otherwise(0)).over(mine),
        "shapley": F.sum(orders * F.col("removed")).over(mine),
    })
    # n! * n rows, whatever the data.
    places = [
        ("".join(order), i + 1, bit[name], sum(bit[x] for x in order[:i]))
        for order in permutations(names) for i, name in enumerate(order)
    ]
    steps = rows.sparkSession.createDataFrame(places, "filter_order string, step int, filter int, before int")
    return table.join(F.broadcast(steps), ["filter", "before"]).select(
        "part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in COUNTS]
    )


def interactions(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """The audit of the text filters A to D, or those given, and of E, a text identical to that of a smaller id.

    Texts are read once. A null text is an empty one, a null part an empty one. Every row counts: equal rows
    count each, and of copies with one id none fails E by the other. A label holds for an id if any of its rows
    in ``labels`` says so.
    """
    rows = judged(docs, text_filters(F.col(f"`{text}`")) if filters is None else filters, id, text, part)
    names = list(text_filters(F.col("x"))) if filters is None else list(filters)
    failing = {name: rows.where(F.array_contains("fails", name)).select("row") for name in names}
    return audit(rows, failing | {"E": copies(rows)}, labelled(rows, labels, id))
