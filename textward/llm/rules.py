"""Quality rules: text statistics, and a decision list learned from labelled ones.

Everything that touches documents is a Spark expression. The driver sees only counts per feature
and bin, a table whose size is fixed by the parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions.planning import bind, evaluate_here
from textward.llm.common import uniform, words
from textward.session import staged

WINDOW = 8


def repeated_words(w: Column) -> Column:
    """How many words of an array lie in a window of WINDOW words found twice or more in it.

    Windows are compared by their 64-bit hashes, first for any repeat at all; only texts with one are
    sorted by window to find which, so a long text takes n log n steps.
    """

    def covered(places: Column) -> Column:
        # Each repeated window adds the words up to the next one's begin, at most its own.
        ends = F.concat(F.slice(places, 2, F.size(places)), F.array(F.element_at(places, -1) + WINDOW))
        return F.aggregate(F.zip_with(places, ends, lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda s, x: s + x)

    def places(pairs: Column) -> Column:
        same = lambda p, j: p["h"] == F.get(pairs, j)["h"]
        found = F.filter(pairs, lambda p, i: F.coalesce(same(p, i - 1), F.lit(False)) | F.coalesce(same(p, i + 1), F.lit(False)))
        return bind(F.array_sort(F.transform(found, lambda p: p["i"])), covered)

    def counted(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bind(pairs, places))

    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) < WINDOW, 0).otherwise(bind(windows, counted)).cast("long")


# Features that rules may use, as SQL over the columns that ``statistics`` gives.
FEATURES = {
    "n_words": "double(n_words)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
}


STATISTICS = ("n_words", "word_chars", "n_distinct", "n_repeat_words", "n_symbols", "n_marks", "n_capitals", "n_dup_lines")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their statistics in place of columns so called; the text stays.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_marks`` (! and ?),
    ``n_capitals``, ``n_distinct`` (different words), ``n_dup_lines`` (lines with a word that equal
    an earlier one), ``n_repeat_words``; all long, and zero for a null or blank text.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")

    dup = bind(lines, lambda found: (F.size(found) - F.size(F.array_distinct(found))).cast("long"))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")

    def measures(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            repeated_words(w).alias("n_repeat_words"),
            count(r"[#*$%&|<>]").alias("n_symbols"), count("[!?]").alias("n_marks"), count(r"\p{Lu}").alias("n_capitals"),
            dup.alias("n_dup_lines"),
        )

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in STATISTICS]
    made = "made" + "_" * max(map(len, docs.columns))  # longer than any name there is
    # Computed once: no filter or feature on a statistic computes it again.
    return docs.select(*kept, evaluate_here(bind(words(t), measures)).alias(made)).select(*kept, f"{made}.*")


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a document is rejected by the first whose conditions all hold."""

    rules: tuple[tuple[Condition, ...], ...] = field(default_factory=tuple)

    def rule(self) -> Column:
        """Which rule rejects a document with ``statistics``, as text; null if none does."""
        chain = None
        for number, conditions in enumerate(self.rules, 1):
            holds = F.expr(" and ".join(c.sql() for c in conditions))
            name = F.lit(f"{number}: " + " and ".join(map(str, conditions)))
            chain = F.when(holds, name) if chain is None else chain.when(holds, name)
        return F.lit(None).cast("string") if chain is None else chain


@dataclass(frozen=True)
class Learner:
    """Sequential covering. Of the labelled rows, at most ``sample`` (those with the smallest hash of
    their id) are learned from; two thirds grow rules and one third prunes them."""

    sample: int = 50_000
    bins: int = 32
    max_rules: int = 8
    max_conditions: int = 3
    min_precision: float = 0.95
    min_support: int = 5
    seed: int = 11

    def learn(self, labelled: DataFrame, bad: str = "bad", id: str = "doc_id") -> DecisionList:
        """Rules that tell rows with ``bad`` = 1 from those with 0; rows with statistics, an id and a
        label, which may be null (left out). With no bad rows, or none that rules catch at the
        precision asked for, the list is empty.

        Each round grows a conjunction by the condition of largest information gain among all
        features and cuts, prunes conditions that do not pay on the pruning rows, keeps the rule
        if it is precise on both parts, and goes on with the rows it does not cover. Cuts lie
        midway between neighbouring quantiles of both classes. A round is one aggregation of
        counts per feature and bin; rows never leave Spark.
        """
        u = uniform(F.col(id), self.seed)
        rows = labelled.where(F.col(bad).isin(0, 1)).select(
            F.col(bad).cast("int").alias("bad"), u.alias("u"), *[F.expr(e).alias(f) for f, e in FEATURES.items()]
        )
        rows = staged(rows.orderBy("u", *FEATURES).limit(self.sample), "labelled")
        grid = F.lit([i / self.bins for i in range(self.bins + 1)])
        quantiles = rows.groupBy("bad").agg(*[F.percentile_approx(f, grid).alias(f) for f in FEATURES]).collect()
        cuts = {}
        for f in FEATURES:
            values = sorted({v for q in quantiles for v in q[f] or []})
            cuts[f] = [(a + b) / 2 for a, b in zip(values, values[1:])]
        binned = staged(
            rows.select(
                "bad", (F.floor(F.col("u") * (1 << 20)) % 3 > 0).alias("grow"),
                *[_bin(f, cuts[f]).alias(f) for f in FEATURES],
            ),
            "binned",
        )
        rules: list[list[tuple[str, bool, int]]] = []
        left = binned
        while len(rules) < self.max_rules:
            rule = self._prune(left, self._grow(left, cuts))
            if not rule:
                break
            rules.append(rule)
            left = left.where(~_covers(rule))
        return DecisionList(tuple(tuple(Condition(f, above, cuts[f][i]) for f, above, i in rule) for rule in rules))

    def _grow(self, rows: DataFrame, cuts: dict[str, list[float]]) -> list[tuple[str, bool, int]]:
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < self.max_conditions:
            covered = rows.where("grow") if not rule else rows.where("grow").where(_covers(rule))
            stacked = covered.select("bad", F.explode(F.array(*[
                F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES
            ])).alias("at"))
            counts: dict[str, dict[int, list[int]]] = {f: {} for f in FEATURES}
            for feature, at, positive, n in stacked.groupBy("at.feature", "at.bin").agg(F.sum("bad"), F.count("*")).collect():
                counts[feature][at] = [positive, n - positive]
            some = counts[next(iter(FEATURES))].values()
            p0, n0 = sum(c[0] for c in some), sum(c[1] for c in some)
            if p0 < self.min_support or n0 == 0 and rule:
                break
            best = max(
                (
                    (_gain(p, n, p0, n0), f, above, i)
                    for f in FEATURES for above in (True, False) for i in range(len(cuts[f]))
                    for p, n in [_sums(counts[f], above, i)] if p >= self.min_support
                ),
                default=(0.0,),
            )
            if best[0] <= 0:
                break
            rule.append(best[1:])
        return rule

    def _prune(self, rows: DataFrame, rule: list[tuple[str, bool, int]]) -> list[tuple[str, bool, int]]:
        """The shortest begin of the rule that is worth most on the pruning rows, if precise enough."""
        if not rule:
            return []
        heads = [rule[: i + 1] for i in range(len(rule))]
        held = [_covers(h) for h in heads]
        part = lambda grow, i, bad: F.count(F.when((F.col("grow") == grow) & held[i] & (F.col("bad") == bad), 1))
        got = rows.agg(*[part(g, i, b) for i in range(len(heads)) for g in (False, True) for b in (1, 0)]).first()
        best, worth = None, -2.0
        for i in range(len(heads)):
            p, n, grown_p, grown_n = got[4 * i : 4 * i + 4]
            value = (p - n) / (p + n) if p + n else -1.0
            precise = p + grown_p >= self.min_precision * (p + n + grown_p + grown_n) and p >= self.min_precision * (p + n)
            if precise and grown_p + p >= self.min_support and value > worth:
                best, worth = heads[i], value
        return best or []


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many cuts are below a row's value."""
    return F.size(F.filter(F.lit(cuts), lambda cut: F.col(feature) > cut)) if cuts else F.lit(0)


def _covers(rule: list[tuple[str, bool, int]]) -> Column:
    holds = F.lit(True)
    for feature, above, i in rule:
        holds &= F.col(feature) > i if above else F.col(feature) <= i
    return holds


def _sums(counts: dict[int, list[int]], above: bool, i: int) -> tuple[int, int]:
    """Bad and good rows on one side of a cut; a row's bin is the number of cuts below its value."""
    inside = [c for b, c in counts.items() if (b > i) == above]
    return sum(c[0] for c in inside), sum(c[1] for c in inside)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's information gain of covering p of p0 bad and n of n0 good rows."""
    return p * (log2((p + 1) / (p + n + 2)) - log2((p0 + 1) / (p0 + n0 + 2)))


def judge(docs: DataFrame, labels: DataFrame, learner: Learner | None = None, id: str = "doc_id") -> tuple[DataFrame, DecisionList]:
    """(documents with statistics, ``base_failed``, ``rule`` and ``kept``; the list that was learned).

    ``labels`` has (doc_id, quality), quality 0 for documents to reject. Documents that fail the base
    rules are not kept whatever the list says, and the list is learned from labelled ones that do
    not fail. Null texts have no words and fail. Labels of unknown ids, null labels and null ids
    teach nothing; a repeated label counts as often. An empty table of documents gives an empty
    result, an empty table of labels an empty list. Columns named as a statistic are replaced.

    At most ``learner.sample`` labels are drawn, which bounds what is broadcast to find their texts;
    the list then goes over all documents in one pass, without a shuffle.
    """
    learner = learner or Learner()
    known = labels.select(F.col(id), (1 - F.col("quality").cast("int")).alias("bad")).where("bad is not null")
    drawn = staged(known.withColumn("_u", uniform(F.col(id), learner.seed)).orderBy("_u", "bad").limit(learner.sample).drop("_u"), "drawn")
    narrow = docs.select(F.col(f"`{id}`").alias(id), "text")
    made = learner.learn(statistics(narrow.join(F.broadcast(drawn), id)).where(~base_failed()), id=id)
    judged = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", made.rule())
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), made
