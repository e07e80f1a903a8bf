"""One query per operator, over whole tables.

Results are flat: arrays are joined to text, maps exploded to rows, doubles rounded, counts cast
to BIGINT, so that another engine's rows can be compared with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions import chat, labels, language, pii, scores
from textward.functions import text as T
from textward.operators import (
    dedupe, key_index, language_model, logistic, metrics, ranks, rollups, sampling, subwords, summaries, tfidf,
)
from textward.operators import ensemble as E
from textward.operators import models
from textward.plans import corpus_build, evaluation, screening
from textward.session import scratch_path, staged
from textward.sources import batches, corpus, decision_log
from textward.sources.reading import spread
from textward.sources.catalogue import COLUMNS, FILE, Catalogue, SourceSpec, read_source
from textward.streaming import live

Query = Callable[[SparkSession, str], DataFrame]

# Guards whose keywords occur in the invented prose of the tables.
GUARDS = E.Registry(
    inputs={
        "en": [
            E.ClassifierSpec("policy_bypass_guard", options={"keywords": ("hate", "of of")}),
            E.ClassifierSpec("prompt_injection_guard", options={"keywords": ("the the", "der der")}),
        ],
        "es": [E.ClassifierSpec("spanish_prompt_guard", options={"keywords": ("ci ci", "ciónci")})],
    },
    outputs=[
        E.ClassifierSpec("isolated_nsfw_guardrail", options={"keywords": ("that that", "thinth")}),
        E.ClassifierSpec(
            "toxicity_guard",
            options={"keywords": ("idiot", "moron", "worthless", "drop dead", "que que")},
        ),
    ],
)
INSULTS = ("idiot", "moron", "worthless", "stupid", "loser", "pathetic", "clown", "scum", "trash", "hate")
GRADED = E.ClassifierSpec(
    "insult_share", backend="keyword_share", threshold=0.1, options={"keywords": INSULTS}
)
COARSE = E.ClassifierSpec("toxicity_guard", options={"keywords": ("idiot", "moron", "worthless", "drop dead")})



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(array) -> F.Column:
    return F.array_join(array, ",")


def big(column) -> F.Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def r6(column) -> F.Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def events(spark, sf_dir) -> DataFrame:
    """Events with their value as a whole number of cents, whose mean no summing order changes."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def labelled(spark, sf_dir) -> DataFrame:
    """Documents with a label, as corpus rows."""
    known = table(spark, sf_dir, "labels")
    return docs(spark, sf_dir).join(known, "doc_id").select(
        F.col("doc_id").alias("pos"), "text", F.col("toxic").alias("label"), "source", "lang", "quality"
    )


# ---- personal data ------------------------------------------------------------------------------


def pii_mask(spark, sf_dir):
    m = pii.mask(docs(spark, sf_dir).select("doc_id", "text"))
    return m.select(
        "doc_id",
        F.col("masked.text").alias("masked"),
        joined(F.col("masked.masked_entities")).alias("entities"),
        big(F.size("masked.masked_entities")).alias("n_entities"),
        pii.is_masked(F.col("masked")).alias("is_masked"),
    )


def pii_scan(spark, sf_dir):
    s = pii.scan(docs(spark, sf_dir).select("doc_id", "text"))
    s = s.withColumn("r", pii.scan_result(F.col("entities")))
    return s.select("doc_id", joined(F.col("entities")).alias("entities"), "r.passed", "r.confidence", "r.detail")


def pii_entity_freq(spark, sf_dir):
    return pii.entity_counts(pii.scan(docs(spark, sf_dir).select("text")))


def pii_mask_freq(spark, sf_dir):
    m = pii.mask(docs(spark, sf_dir).select("text"))
    return pii.entity_counts(m.select(F.col("masked.masked_entities").alias("entities")))


# ---- text scalars -------------------------------------------------------------------------------


def normalize_ws(spark, sf_dir):
    text = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id",
        T.normalize_whitespace(text).alias("normalized"),
        T.single_line(text).alias("one_line"),
        T.PREPROCESSORS["identity"](text).alias("same"),
    )


def clip_text(spark, sf_dir):
    clipped = T.clip(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", clipped.alias("text"), big(F.length(clipped)).alias("length"))


def injection_tags(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id",
        T.tag_attack_words(F.col("text")).alias("tagged"),
        joined(T.attack_tag_flags(F.col("text"))).alias("tags"),
    )


def near_keys(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.near_duplicate_key(F.col("text")).alias("near_key"))


def word_stats(spark, sf_dir):
    text = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id",
        big(T.latin_letter_count(text)).alias("n_letters"),
        big(T.word_count(text)).alias("n_words"),
        big(F.size(T.latin_words(text))).alias("n_distinct"),
        T.has_two_latin_letters(text).alias("two_letters"),
        T.has_more_words_than(text, 5).alias("long_text"),
    )


# ---- language -----------------------------------------------------------------------------------


def routed(df: DataFrame) -> DataFrame:
    return screening.with_route(df, GUARDS)


def language_route(spark, sf_dir):
    r = routed(docs(spark, sf_dir).select("doc_id", F.col("text").alias("prompt")))
    return r.select(
        "doc_id", "route.lang", "route.confidence", "route.method", "route.target",
        language.route_detail(F.col("route")).alias("detail"),
    )


def route_vs_label_lang(spark, sf_dir):
    r = routed(docs(spark, sf_dir).select("lang", F.col("text").alias("prompt")))
    return r.groupBy("lang", F.col("route.lang").alias("routed")).agg(F.count(F.lit(1)).alias("n"))


def language_buckets(spark, sf_dir):
    """Bucket of the document's own language tag, for three configurations."""
    lang = F.col("lang")
    return docs(spark, sf_dir).select(
        "doc_id",
        language.resolve_bucket(lang, ["en", "es"]).alias("en_es"),
        language.resolve_bucket(lang, ["de", "fr"]).alias("de_fr"),
        language.target(lang, "english filter", "spanish filter").alias("target"),
    )


def history_language(spark, sf_dir):
    t = screening.with_history_language(routed(screening.user_turns(turns(spark, sf_dir))))
    found = language.detect(
        F.col("prompt"), preferred="en", history=F.coalesce("history_lang", F.lit(""))
    )
    return t.select(
        "conv_id", "turn", F.coalesce("history_lang", F.lit("none")).alias("history_lang"),
        found["lang"].alias("lang"), found["method"].alias("method"),
    )


# ---- classifiers --------------------------------------------------------------------------------


def keyword_ensemble(spark, sf_dir):
    users = turns(spark, sf_dir).filter(F.col("role") == "user").select("conv_id", "turn", "text")
    r = E.with_results(users, GUARDS.flat(), "text", "results")
    results = F.col("results")
    return r.select(
        "conv_id", "turn",
        E.passed(results).alias("passed"),
        E.max_score(results).alias("max_score"),
        joined(E.failed_filters(results)).alias("blocked_by"),
        F.array_join(F.transform(results, lambda x: x["detail"]), ";").alias("details"),
    )


def aggregate_score(spark, sf_dir):
    r = E.with_results(docs(spark, sf_dir).select("doc_id", "text"), GUARDS.outputs, "text", "results")
    r = r.withColumn("s", E.aggregate_score(F.col("results")))
    return r.select(
        "doc_id", "s.is_malicious", "s.confidence", joined(F.col("s.blocked_by")).alias("blocked_by"), "s.detail"
    )


def score_summary(spark, sf_dir):
    """One row per document and classifier; the name given twice keeps its last score."""
    specs = [*GUARDS.outputs, GRADED, E.ClassifierSpec("toxicity_guard", options={"keywords": ("stupid",)})]
    r = E.with_results(docs(spark, sf_dir).select("doc_id", "text"), specs, "text", "results")
    return r.select(
        "doc_id", F.explode(E.scores_summary(F.col("results"))).alias("filter_name", "score")
    ).withColumn("score", r6("score"))


def blocking_labels(spark, sf_dir):
    """Classifier labels in many spellings, made from the label table."""
    known = table(spark, sf_dir, "labels")
    spelled = F.concat(
        F.lit(" "),
        F.element_at(
            F.array(*[F.lit(v) for v in ("Toxic", "SAFE", "1", "0", "01", "1.0", "other", "+1", "unsafe ")]),
            (F.col("doc_id") % 9 + 1).cast("int"),
        ),
    )
    return known.select(
        "doc_id",
        labels.is_blocking_label(spelled).alias("by_name"),
        labels.is_blocking_label(F.col("toxic"), known.schema["toxic"].dataType).alias("by_number"),
    )


def blocking_confidence(spark, sf_dir):
    """Confidence of a three-class and a two-class bundle over embeddings taken as logits."""
    v = table(spark, sf_dir, "embeddings")
    names = ["benign", "toxic", "other"]
    p3 = scores.softmax(F.slice("embedding", 1, 3))
    p2 = scores.softmax(F.slice("embedding", 1, 2))
    base = v.select("vec_id", p3.alias("p3"), p2.alias("p2"))
    top = F.array_position(F.col("p3"), F.array_max("p3")).cast("int")
    predicted = F.element_at(F.array(*[F.lit(n) for n in names]), top)
    three = E.bundle_result("three", predicted, F.col("p3"), F.array(*[F.lit(n) for n in names]))
    unnamed = E.bundle_result("unnamed", predicted, F.col("p2"), F.array(F.lit("a"), F.lit("b")))
    bare = E.bundle_result("bare", predicted)
    return base.select(
        "vec_id",
        three["passed"].alias("passed"),
        r6(three["confidence"]).alias("three"),
        r6(unnamed["confidence"]).alias("unnamed"),
        bare["confidence"].alias("bare"),
    )


def softmax_block(spark, sf_dir):
    """Sequence classifier over embeddings as logits; the label name settles the index."""
    v = table(spark, sf_dir, "embeddings")
    id2label = {0: "SAFE", 1: "INJECTION", **{i: f"L{i}" for i in range(2, 64)}}
    r = E.sequence_result("sequence", F.col("embedding"), id2label, threshold=0.016, label_name="injection")
    s = v.select("vec_id", r.alias("r"))
    return s.select("vec_id", r6("r.confidence").alias("score"), (~F.col("r.passed")).alias("blocked"))


def clamp_threshold(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    score = scores.clamp01(F.get("embedding", F.lit(0)).cast("double") * 4)
    return v.select("vec_id", r6(score).alias("score"), scores.exceeds(score, 0.5).alias("blocked"))


def toxicity_details(spark, sf_dir):
    """The toxicity filter's lines, for given predictions and probabilities."""
    known = table(spark, sf_dir, "labels")
    r = E.toxicity_result("Toxicity", F.col("toxic"), (F.col("doc_id") % 1000) / 1000.0)
    return known.select("doc_id", r.alias("r")).select("doc_id", "r.passed", r6("r.confidence").alias("confidence"), "r.detail")


def truncated_inputs(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id", E.is_truncated(T.word_count(F.col("text")), 512).alias("truncated")
    )


VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def subword_truncation(spark, sf_dir):
    """Pieces of every text by a vocabulary, longest match first, and whether a model of 512 saw its end."""
    count = subwords.counter(spark, subwords.read_pieces(spark, VOCABULARY))
    counted = docs(spark, sf_dir).select("doc_id", count(F.col("text")).alias("pieces"))
    return counted.select("doc_id", "pieces", E.is_truncated(F.col("pieces"), 512).alias("truncated"))


def _external() -> E.ClassifierSpec:
    """Stands in for a model from outside, one that cannot score texts beginning with T."""

    # Inside a function, so that it reaches the Python workers by value.
    def load():
        def score(texts):
            if any(text.startswith("T") for text in texts):
                raise ValueError("cannot score")
            return [len(text) % 100 / 80.0 for text in texts]

        return score

    return E.ClassifierSpec("external_model", backend="external", threshold=0.6, options={"load": load})


EXTERNAL = _external()


def external_classifier(spark, sf_dir):
    r = docs(spark, sf_dir).select("doc_id", "text").withColumn("r", E.classify(EXTERNAL, F.col("text")))
    return r.select(
        "doc_id",
        "r.passed",
        F.coalesce(r6("r.confidence"), F.lit(-1.0)).alias("score"),
        F.col("r.detail").startswith("error").alias("failed"),
    )


def external_predictions(spark, sf_dir):
    """Evaluation rows of an external model: rows it fails on are left out."""
    p = evaluation.predictions(labelled(spark, sf_dir).select("pos", "text", "label"), EXTERNAL)
    return p.select(F.col("pos").alias("doc_id"), F.col("label"), "pred", r6("score").alias("score"))


# ---- labels and sources -------------------------------------------------------------------------


def _label_conventions(spark, sf_dir) -> dict[str, tuple[SourceSpec, DataFrame]]:
    known = table(spark, sf_dir, "labels")
    base = docs(spark, sf_dir).join(known, "doc_id")
    toxic = F.col("toxic") == 1
    word = F.when(F.col("quality") == 0, "VARIES").when(toxic, "BLOCKED").otherwise("PASS")
    spelled = F.when(toxic, " Jailbreak ").when(F.col("doc_id") % 5 == 0, "unknown").otherwise("Benign")
    return {
        "int_label": (
            SourceSpec("int_label", "text", label_field="toxic", language="en"), base),
        "bool_label": (
            SourceSpec("bool_label", "text", label_field="flag", language="mixed"),
            base.withColumn("flag", toxic)),
        "mapped_label": (
            SourceSpec("mapped_label", "text", label_field="expected", label_map={"BLOCKED": 1, "PASS": 0},
                       drop_label_values=("VARIES",), language_field="lang"),
            base.withColumn("expected", word)),
        "spelled_label": (
            SourceSpec("spelled_label", "text", label_field="kind", language="multi"),
            base.withColumn("kind", spelled)),
        "fixed_label": (SourceSpec("fixed_label", "text", fixed_label=1, language="en"), base.drop("lang")),
        "no_label": (SourceSpec("no_label", "text"), base),
    }


def resolve_labels(spark, sf_dir):
    parts = [
        corpus.label_rows(df, spec, F.col("doc_id")).select(
            F.col("pos").alias("doc_id"), "source", F.coalesce(big("label"), F.lit(-1)).alias("label"), "kept"
        )
        for spec, df in _label_conventions(spark, sf_dir).values()
    ]
    return corpus.concatenate(parts)


def resolve_lang(spark, sf_dir):
    parts = [
        corpus.label_rows(df, spec, F.col("doc_id")).select(F.col("pos").alias("doc_id"), "source", "lang")
        for spec, df in _label_conventions(spark, sf_dir).values()
    ]
    return corpus.concatenate(parts)


def _tree(spark, sf_dir):
    """Turns as a tree of messages: the first turn of a conversation has no parent."""
    spec = SourceSpec(
        "tree", "text", fixed_label=0, filter={"role": "user", "parent_id_is_null": True}, language="multi"
    )
    rows = turns(spark, sf_dir).withColumn("parent_id", F.when(F.col("turn") > 0, F.col("turn") - 1))
    return spec, rows


def filtered_source(spark, sf_dir):
    spec, rows = _tree(spark, sf_dir)
    out = corpus.corpus_rows(corpus.label_rows(rows, spec, F.col("conv_id")))
    return out.select(F.col("pos").alias("conv_id"), "text", big("label").alias("label"), "source", "lang", big("length").alias("length"))


def split_labels(spark, sf_dir):
    """A source whose label is given by the split a row is in."""
    from textward.sources.catalogue import read_source

    spec = SourceSpec("by_split", "text", split_per_label={"harmful": 1, "benign": 0}, language="en")
    d = docs(spark, sf_dir)
    halves = {"harmful": d.filter(F.col("source") < "src13"), "benign": d.filter(F.col("source") >= "src13")}
    rows = corpus.label_rows(read_source(spark, spec, halves), spec, F.col("doc_id"))
    return rows.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n")).select("source", big("label").alias("label"), "n")


def source_stats(spark, sf_dir):
    parts = [corpus.label_rows(df, spec, F.col("doc_id")) for spec, df in _label_conventions(spark, sf_dir).values()]
    spec, rows = _tree(spark, sf_dir)
    parts.append(corpus.label_rows(rows, spec, F.col("conv_id")))
    return summaries.source_stats(corpus.concatenate(parts))


# ---- screening ----------------------------------------------------------------------------------


def last_user_prompt(spark, sf_dir):
    p = screening.last_prompts(turns(spark, sf_dir))
    return p.select("conv_id", "prompt", F.when(F.col("prompt") == "", 400).otherwise(200).cast("bigint").alias("status"))


def _screened_turns(spark, sf_dir):
    return screening.screen(screening.user_turns(turns(spark, sf_dir)), GUARDS)


def _flat(results: DataFrame, *keys: str) -> DataFrame:
    return results.select(
        *keys, "decision", big("status_code").alias("status_code"), "content", "detail",
        joined(F.col("failed_filters")).alias("failed_filters"),
        F.coalesce("log_type", F.lit("")).alias("log_type"),
        F.coalesce("logged_response", F.lit("")).alias("logged_response"),
    )


def screen_conversations(spark, sf_dir):
    return _flat(_screened_turns(spark, sf_dir), "conv_id", "turn")


def next_responses(spark, sf_dir):
    """Conversations whose turns are two apart and whose every third answer comes one later."""
    apart = F.col("turn") * 2
    late = (F.col("role") == "assistant") & (F.floor(F.col("turn") / 2) % 3 == 0)
    moved = turns(spark, sf_dir).withColumn("turn", F.when(late, apart + 1).otherwise(apart))
    return screening.user_turns(moved).select("conv_id", "turn", "prompt", "response")


def screen_last_prompts(spark, sf_dir):
    return _flat(screening.screen(screening.last_turns(turns(spark, sf_dir)), GUARDS), "conv_id")


def screen_documents(spark, sf_dir):
    """Every document as a prompt that is answered with itself: masks and drops occur."""
    d = docs(spark, sf_dir).select("doc_id", F.col("text").alias("prompt"), F.col("text").alias("response"))
    return _flat(screening.screen(d, GUARDS), "doc_id")


def screen_without_output(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.col("text").alias("prompt"), F.col("text").alias("response"))
    off = screening.Options(enable_output_classifiers=False)
    return screening.screen(d, GUARDS, off).select("doc_id", "decision", "content", "detail")


def screening_scores(spark, sf_dir):
    s = _screened_turns(spark, sf_dir)
    return s.select("conv_id", "turn", F.explode("scores").alias("name", "score"))


def decision_stats(spark, sf_dir):
    counts = summaries.decision_counts(_screened_turns(spark, sf_dir))
    return counts.select(*[big(c).alias(c) for c in ("total", "allowed", "blocked", "dropped", "errors")])


def latency_stats(spark, sf_dir):
    """Decision counts and mean latency over events as a decision log; errors have none."""
    e = events(spark, sf_dir)
    names = {"signup": "ALLOWED", "view": "ALLOWED", "click": "BLOCKED", "purchase": "DROPPED"}
    decision = F.lit("ERROR")
    for event, name in names.items():
        decision = F.when(F.col("event_type") == event, name).otherwise(decision)
    log = e.select(
        decision.alias("decision"), F.when(F.col("event_type") != "error", F.col("cents")).alias("total_latency_ms")
    )
    return summaries.decision_counts(log)


def blocked_by_freq(spark, sf_dir):
    return summaries.blocked_by(_screened_turns(spark, sf_dir))


def recent_decisions(spark, sf_dir):
    log = screening.log_entries(_screened_turns(spark, sf_dir))
    newest = decision_log.newest(log, 500, ("conv_id", "turn"))
    return newest.select(
        "conv_id", "turn", "type", "decision",
        F.coalesce(joined(F.col("failed_filters")), F.lit("none")).alias("failed_filters"),
    )


def recent_stats(spark, sf_dir):
    """Decision counts over the whole log."""
    log = screening.log_entries(_screened_turns(spark, sf_dir)).drop("total_latency_ms")
    return decision_log.recent_stats(log)


def _stored_log(spark, sf_dir) -> str:
    """A log of the screened turns, an hour a conversation: three batches, one of them written twice."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 3600 + F.col("turn"))
    name = F.concat(F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 12, "0"))
    results = screening.log_entries(_screened_turns(spark, sf_dir)).select("conv_id", "turn", "type", "decision", "response")
    entries = staged(results.withColumns({"ts": at, "id": name}), "entries")
    path = scratch_path(spark, "log")
    for batch in (0, 1, 2, 1):
        decision_log.append(entries.filter(F.pmod("conv_id", F.lit(3)) == batch), path, batch)
    return path


def log_roundtrip(spark, sf_dir):
    """What a log holds from a day on, after its first days went to a compacted copy and the rest followed."""
    path, into = _stored_log(spark, sf_dir), scratch_path(spark, "compacted")
    decision_log.compact(spark, path, into, "2023-11-17")
    rest = decision_log.read(spark, path, "2023-11-17")
    decision_log.append(rest.drop("day", "batch"), into, "rest")
    log = decision_log.read(spark, into, "2023-11-16")
    return log.select("conv_id", "turn", "type", "decision", "response", F.date_format("day", "yyyy-MM-dd").alias("day"))


def log_newest(spark, sf_dir):
    """The 300 newest entries of the stored log, from its last days."""
    newest = decision_log.newest_of(spark, _stored_log(spark, sf_dir), 300)
    return newest.select("id", "type", "decision")


def error_payloads(spark, sf_dir):
    """What callers see of requests that end in an error."""
    failed = screening.screen(screening.last_turns(turns(spark, sf_dir)), GUARDS).filter("decision = 'ERROR'")
    return screening.payload(failed).select("conv_id", big("status_code").alias("status_code"), "payload")


def decision_filter(spark, sf_dir):
    log = screening.log_entries(_screened_turns(spark, sf_dir))
    return decision_log.by_decision(log, "BLOCKED").select("conv_id", "turn", "type", "response")


def score_band(spark, sf_dir):
    return screening.score_bands(_screened_turns(spark, sf_dir)).groupBy("filter_name", "band").agg(
        F.count(F.lit(1)).alias("n")
    )


def chat_messages(spark, sf_dir):
    """Each user turn as messages with its conversation's system turn, and the prompt read back."""
    t = turns(spark, sf_dir)
    system = t.filter((F.col("role") == "system") & (F.col("turn") == 0)).select("conv_id", F.col("text").alias("system"))
    users = t.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    both = users.join(system, "conv_id", "left")
    m = both.withColumn("messages", chat.build_messages(F.col("system"), F.col("prompt")))
    return m.select(
        "conv_id", "turn", big(F.size("messages")).alias("n_messages"),
        chat.last_user_prompt(F.col("messages")).alias("prompt"),
        F.to_json("messages").alias("messages"),
    )


def chat_responses(spark, sf_dir):
    """Response JSON built, parsed, its text taken, masked and put back."""
    a = docs(spark, sf_dir).select(
        "doc_id",
        F.to_json(
            chat.response_envelope(F.col("text"), "test-model", F.concat(F.lit("id-"), F.col("doc_id")), F.lit(0))
        ).alias("body"),
    )
    parsed = a.withColumn("response", F.from_json("body", chat.RESPONSE)).withColumn(
        "text", chat.assistant_content(F.col("response"))
    )
    m = pii.mask(parsed)
    changed = F.when(
        pii.is_masked(F.col("masked")),
        chat.replace_assistant_content(F.col("response"), F.col("masked.text")),
    ).otherwise(F.col("response"))
    return m.select("doc_id", F.to_json(changed).alias("body"), pii.is_masked(F.col("masked")).alias("changed"))


def batch_requests(spark, sf_dir):
    """Batch requests made from user turns, with every kind of fault."""
    users = turns(spark, sf_dir).filter(F.col("role") == "user")
    k = F.col("conv_id") % 8
    prompts = F.when(k == 1, F.lit("[]")).when(k == 2, F.lit('["a", 1]')).otherwise(
        F.to_json(F.array("text", F.lit("second")))
    )
    model = F.when(k == 3, F.lit('" "')).otherwise(F.lit('"m"'))
    concurrency = F.when(k == 4, F.lit("0")).when(k == 5, F.lit("101")).when(k == 6, F.lit("1")).otherwise(F.lit("20"))
    system = F.when(k == 7, F.lit("7")).otherwise(F.lit("null"))
    body = F.format_string(
        '{"prompts": %s, "model": %s, "concurrency": %s, "system_message": %s}', prompts, model, concurrency, system
    )
    checked = batches.checked_requests(users.select("conv_id", "turn", body.alias("body")))
    return checked.select(
        "conv_id", "turn", F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce(big(F.size("prompts")), F.lit(-1)).alias("n_prompts"),
        F.coalesce(big("concurrency"), F.lit(-1)).alias("concurrency"),
    )


def batch_screening(spark, sf_dir):
    """Conversations as batches of one prompt per user turn; the summary of each batch."""
    return (
        _screened_turns(spark, sf_dir)
        .groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            *[
                F.count_if(F.col("decision") == d).alias(n)
                for d, n in (("ALLOWED", "allowed"), ("BLOCKED", "blocked"), ("DROPPED", "dropped"), ("ERROR", "errors"))
            ],
        )
    )


def _prompt_files(spark, sf_dir) -> str:
    """All documents as one request, a prompt a line, in several files, more of them for a larger table."""
    path = scratch_path(spark, "request")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    ordered = rows.repartitionByRange(max(4, rows.rdd.getNumPartitions()), "doc_id").sortWithinPartitions("doc_id")
    ordered.select(F.to_json(F.struct("doc_id", "prompt"))).write.text(path)
    return path


def batch_flow(spark, sf_dir):
    """A request of all documents read in several tasks, checked, screened and summarised; the places of its
    prompts are held against the documents' order."""
    lines = batches.read_prompt_lines(spark, _prompt_files(spark, sf_dir))
    error = batches.lines_error(lines)
    asked = lines.select("index", "prompt", F.col("prompt").alias("response"))
    results = staged(screening.screen(asked, GUARDS).select("index", "decision"), "batch")
    at = results.agg(
        F.min("index").alias("first_place"), F.max("index").alias("last_place"), F.count_distinct("index").alias("places"),
        F.coalesce(F.sum(F.when(F.col("decision") == "BLOCKED", F.col("index"))), F.lit(0)).alias("blocked_places"),
    ).first()
    return batches.summary(results).select("*", F.lit(error or "none").alias("error"), *[F.lit(at[c]).cast("bigint").alias(c) for c in at.asDict()])


def screen_failures(spark, sf_dir):
    """Documents screened by a model that fails on some of them: those are errors, the others go on."""
    registry = E.Registry(inputs={"en": [EXTERNAL], "es": GUARDS.inputs["es"]}, outputs=GUARDS.outputs)
    d = docs(spark, sf_dir).select("doc_id", F.col("text").alias("prompt"), F.col("text").alias("response"))
    r = screening.payload(screening.screen(d, registry))
    failed = F.col("log_type") == "INPUT_MODEL_ERROR"
    return r.select(
        "doc_id", "decision", big("status_code").alias("status_code"), "log_type", "detail",
        F.when(failed, F.col("payload")).otherwise("").alias("error_payload"),
    )


def language_trained(spark, sf_dir):
    """Languages of all documents by a detector learned from every other one."""
    d = docs(spark, sf_dir).select("doc_id", "text", "lang")
    weights, totals = (staged(t, "language") for t in language_model.train(d.filter("doc_id % 2 = 0")))
    found = language_model.detect(d, weights, totals, "doc_id")
    return found.join(d.select("doc_id", F.col("lang").alias("label")), "doc_id").select(
        "doc_id", F.coalesce("lang", F.lit("unsure")).alias("lang"), "label", r6("margin").alias("margin")
    )


def daily_rollups(spark, sf_dir):
    """Events rolled up by day, the last days again when late ones came; estimates held against all events."""
    e = events(spark, sf_dir)
    path = scratch_path(spark, "rollups")
    last = e.agg(F.date_sub(F.max(F.to_date("ts")), 2)).first()[0]
    is_late = (F.col("event_id") % 7 == 0) & (F.to_date("ts") >= F.lit(last))
    columns = {"by": "event_type", "value": "cents", "distinct": "user_id"}
    rollups.store(rollups.partials(e.where(~F.coalesce(is_late, F.lit(False))), **columns), path)
    rollups.refresh(e, e.where(is_late), path, **columns)
    found = rollups.merged(rollups.read(spark, path), "event_type")
    exact = e.join(found.select("event_type", "quantile"), "event_type").groupBy("event_type").agg(
        (F.count_if(F.col("cents") <= F.col("quantile")) / F.count("cents")).alias("rank"), F.count_distinct("user_id").alias("users")
    )
    return found.join(exact, "event_type").select(
        "event_type", "n", "days", r6("mean").alias("mean_cents"), F.abs(F.col("rank") - 0.95).between(0, 0.01).alias("p95_near"),
        (F.abs(F.col("members") - F.col("users")) <= F.col("users") * 0.03).alias("users_near"),
    )


# ---- corpus construction ------------------------------------------------------------------------


def dedupe_kept(spark, sf_dir):
    return dedupe.kept_positions(docs(spark, sf_dir), order="doc_id")


def dedupe_rows(spark, sf_dir):
    return dedupe.keep_first(docs(spark, sf_dir), order="doc_id").select("doc_id", "text", "source", "lang")


def incremental_dedupe(spark, sf_dir):
    """Documents in three deliveries, each held against the keys of those before it."""
    index, kept = scratch_path(spark, "index"), []
    for delivery in range(3):
        part = docs(spark, sf_dir).filter(F.pmod("doc_id", F.lit(3)) == delivery)
        kept.append(key_index.admit(part, index, delivery, order="doc_id", digits=1).withColumn("delivery", F.lit(delivery)))
    return kept[0].union(kept[1]).union(kept[2])


def dedupe_counts(spark, sf_dir):
    c = dedupe.collision_counts(docs(spark, sf_dir), order="doc_id")
    return c.select(*[big(n).alias(n) for n in c.columns])


def unseen_documents(spark, sf_dir):
    """Documents whose near-duplicate key no earlier half of the table has."""
    d = docs(spark, sf_dir).select("doc_id", "source", T.near_duplicate_key(F.col("text")).alias("near_key"))
    first, second = d.filter("source < 'src13'"), d.filter("source >= 'src13'")
    new = dedupe.unseen(second, first, "near_key").select("doc_id", F.lit("new").alias("kind"))
    old = dedupe.seen_before(second, first, "near_key").select("doc_id", F.lit("seen").alias("kind"))
    return new.unionByName(old)


def balance(spark, sf_dir):
    rows = labelled(spark, sf_dir).drop("text")
    return sampling.balance(rows, 0.3).select(F.col("pos").alias("doc_id"), big("label").alias("label"))


def balance_stats(spark, sf_dir):
    rows = labelled(spark, sf_dir).drop("text")
    s = sampling.balance_stats(rows, sampling.balance(rows, 0.3), 0.3)
    return s.select("kept_pos", "kept_neg", "subsampled", "desired_neg", big("neg_strata").alias("neg_strata"))


def split(spark, sf_dir):
    s = sampling.split(labelled(spark, sf_dir).drop("text"))
    return s.select(F.col("pos").alias("doc_id"), "split")


def split_summary(spark, sf_dir):
    return summaries.split_summary(sampling.split(labelled(spark, sf_dir).drop("text")))


def stratum_count(spark, sf_dir):
    return summaries.stratum_count(labelled(spark, sf_dir))


def training_order(spark, sf_dir):
    """Place of each row in the shuffled order, counted from its hash."""
    return labelled(spark, sf_dir).select(
        F.col("pos").alias("doc_id"), sampling.seeded_hash("7-order", "pos").alias("order_key")
    )


def built_corpus(spark, sf_dir):
    """Normalize, deduplicate, balance and split, as one job; text length kept as a check."""
    spec = SourceSpec("documents", "text", label_field="toxic", language_field="lang")
    raw = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    rows = corpus.corpus_rows(corpus.label_rows(raw, spec, F.col("doc_id")))
    kept = staged(dedupe.keep_first(rows), "deduplicated")
    final = sampling.split(sampling.balance(kept, 0.6))
    return final.select(F.col("pos").alias("doc_id"), big("label").alias("label"), "lang", big("length").alias("length"), "split")


def _built_files(spark, sf_dir) -> tuple[str, dict]:
    """A build from two training sources and a held-out one, over all labelled documents, in files."""
    raw = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    part = {name: raw.filter(F.pmod("doc_id", F.lit(5)).isin(rests)) for name, rests in
            {"first": [0, 1], "second": [2, 3], "jailbreakbench_behaviors": [4]}.items()}
    spec = lambda name: SourceSpec(name, "text", label_field="toxic", language_field="lang", key_field="doc_id")
    catalogue = Catalogue([spec("first"), spec("second")], [spec("jailbreakbench_behaviors")], [])
    out = scratch_path(spark, "built")
    return out, corpus_build.build(spark, catalogue, out, 0.3, splits={k: {"all": v} for k, v in part.items()})


def catalogue_scan(spark, sf_dir):
    """Documents written as splits whose files differ in their columns, read back by a catalogue's source."""
    path, d = scratch_path(spark, "source"), table(spark, sf_dir, "documents")
    part = lambda i: d.filter(F.pmod("doc_id", F.lit(4)) == i)
    part(0).select("doc_id", "text", "lang").write.parquet(f"{path}/train")
    part(1).select("doc_id", "text", "source").write.mode("append").parquet(f"{path}/train")
    part(2).select("doc_id", "text").write.parquet(f"{path}/test")
    part(3).select("doc_id", "text", F.lit(None).cast("string").alias("lang")).write.parquet(f"{path}/validation")
    rows = read_source(spark, SourceSpec("documents", "text", path=path, split="all"))
    return rows.select(
        "doc_id", F.element_at(F.split(F.col(FILE), "/"), 1).alias("split"), "lang", "source", F.array_contains(COLUMNS, "lang").alias("has_lang")
    )


def split_sinks(spark, sf_dir):
    """The split corpus as a build has written it."""
    rows = spark.read.parquet(f"{_built_files(spark, sf_dir)[0]}/splits")
    return rows.select(
        F.col("pos.row").alias("doc_id"), "source", big("label").alias("label"), "lang", big("length").alias("length"), "split"
    )


def held_out_sets(spark, sf_dir):
    """A held-out set as a build has written it, under its known name."""
    rows = spark.read.parquet(f"{_built_files(spark, sf_dir)[0]}/eval_jailbreakbench.parquet")
    return rows.select(F.col("pos.row").alias("doc_id"), "source", big("label").alias("label"), "lang", big("length").alias("length"))


def _manifest_counts(value, path: tuple[str, ...] = ()):
    """Every whole number of a manifest, by its path."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from _manifest_counts(inner, (*path, key))
    elif isinstance(value, int) and not isinstance(value, bool):
        yield "/".join(path), value


def manifest_rows(spark, sf_dir):
    """The counts of a build's manifest, read back from its file."""
    counts = _manifest_counts(corpus_build.read_manifest(spark, _built_files(spark, sf_dir)[0]))
    return spark.createDataFrame([c for c in counts if c[0] != "seed"], "path string, n bigint")


# ---- evaluation ---------------------------------------------------------------------------------


def scored(spark, sf_dir, spec: E.ClassifierSpec = GRADED) -> DataFrame:
    p = evaluation.predictions(labelled(spark, sf_dir), spec)
    return p.withColumn("tbl", F.when(F.col("quality") == 1, "good").otherwise("poor")).select(
        "tbl", "source", "lang", "label", "pred", "score", (F.col("pos") % 37 + 1).cast("double").alias("latency_ms")
    )


def confusion_slices(spark, sf_dir):
    m = metrics.with_ratios(metrics.confusion_counts(scored(spark, sf_dir)))
    return m.select(
        "tbl", "dimension", "value", *[big(c).alias(c) for c in ("n", "tp", "fp", "tn", "fn")],
        *[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")],
    )


def _auc(spark, sf_dir, column):
    a = metrics.auc(metrics.ranked_scores(scored(spark, sf_dir)))
    return a.select("tbl", "dimension", "value", r6(column).alias(column))


def roc_auc(spark, sf_dir):
    return _auc(spark, sf_dir, "roc_auc")


def pr_auc(spark, sf_dir):
    return _auc(spark, sf_dir, "pr_auc")


def evaluation_report(spark, sf_dir):
    return evaluation.evaluate(scored(spark, sf_dir)).select(
        "tbl", "dimension", "value", big("n").alias("n"),
        *[r6(c).alias(c) for c in ("f1", "roc_auc", "pr_auc", "mean_latency_ms", "p95_latency_ms")],
    )


def rounded_report(spark, sf_dir):
    """The report as displayed, of the two tables together and each for itself."""
    rows = staged(scored(spark, sf_dir), "scored")
    both = rows.unionByName(rows.withColumn("tbl", F.lit("both")))
    return evaluation.rounded_report(evaluation.evaluate(both)).select(
        "tbl", "dimension", "value", big("n").alias("n"), "precision", "recall", "accuracy", "mean_latency_ms"
    )


def p95_rank(spark, sf_dir):
    e = events(spark, sf_dir)
    means = e.groupBy("event_type").agg(F.round(F.avg("cents"), 6).alias("mean_cents"))
    p95 = ranks.value_at_rank(e, ["event_type"], "value", ranks.p95_rank, "p95_ms")
    return means.join(p95, "event_type")


def threshold_sweep(spark, sf_dir):
    best = metrics.threshold_sweep(metrics.ranked_scores(scored(spark, sf_dir)))
    return best.select("tbl", "dimension", "value", r6("flag_from").alias("flag_from"), r6("f1").alias("f1"))


def model_bake_off(spark, sf_dir):
    reports = {
        "graded": metrics.with_ratios(metrics.confusion_counts(scored(spark, sf_dir))),
        "coarse": metrics.with_ratios(metrics.confusion_counts(scored(spark, sf_dir, COARSE))),
    }
    return evaluation.bake_off(reports).select(
        "tbl", "dimension", "value", r6("graded").alias("graded"), r6("coarse").alias("coarse")
    )


def promotion_gate(spark, sf_dir):
    candidate = metrics.with_ratios(metrics.confusion_counts(scored(spark, sf_dir)))
    baseline = metrics.with_ratios(metrics.confusion_counts(scored(spark, sf_dir, COARSE)))
    g = evaluation.promotion_gate(
        candidate, baseline, baseline, "good", ("poor", "lang", "es"), ["src1", "src2", "src3"]
    )
    return g.select(r6("f1").alias("f1"), "f1_ok", "spanish_ok", big("sources_gained").alias("sources_gained"), "gain_ok", "promoted")


def labelled_accuracy(spark, sf_dir):
    rows = evaluation.predictions(labelled(spark, sf_dir), COARSE)
    a = metrics.labelled_accuracy(rows, F.col("label") == 1, F.col("pred") == 1)
    return a.select(big("n").alias("n"), big("correct").alias("correct"), r6("accuracy").alias("accuracy"))


def first_rows(spark, sf_dir):
    """The first rows in order: the row limit of an evaluation."""
    return evaluation.first_rows(labelled(spark, sf_dir), 100).select(F.col("pos").alias("doc_id"), "source")


# ---- models (no SQL twin) -----------------------------------------------------------------------


def toxicity_model(spark, sf_dir):
    """A text model trained on the labelled documents, scoring all of them."""
    rows = labelled(spark, sf_dir)
    model = models.train_text_model(rows)
    out = models.score_toxicity(docs(spark, sf_dir).select("doc_id", "text"), model)
    return out.select("doc_id", "toxicity.passed", F.round("toxicity.confidence", 4).alias("confidence"))


def bundle_model(spark, sf_dir):
    """The same model seen as a bundle with named classes."""
    model = models.train_text_model(labelled(spark, sf_dir))
    out = models.score_bundle(docs(spark, sf_dir).select("doc_id", "text"), model, "bundle", ["safe", "toxic"])
    return out.select("doc_id", "result.passed", F.round("result.confidence", 4).alias("confidence"))


def embedding_head(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label"))
    out = models.apply_head(v, models.train_head(v))
    return out.select("vec_id", "label", "pred", F.round("score", 4).alias("score"))


def tfidf_weights(spark, sf_dir):
    """Of every document how many terms it has, the length of its weights before scaling, and its heaviest term."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    idf = staged(tfidf.fit(d, "doc_id"), "idf")
    w = tfidf.weights(d, idf, "doc_id")
    per_doc = w.groupBy("id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum(F.col("weight") * F.col("weight")).alias("unit"),
        F.sum(F.col("n") * F.col("n") * F.col("idf") * F.col("idf")).alias("squares"),
        F.min(F.struct(-F.col("n") * F.col("idf"), "term"))["term"].alias("heaviest"),
    )
    found = d.join(per_doc, d["doc_id"] == per_doc["id"], "left")
    return found.select(
        "doc_id", F.coalesce("terms", F.lit(0)).alias("terms"), r6(F.sqrt("squares")).alias("length"), r6("unit").alias("unit"), "heaviest"
    )


def embedding_head_gradient(spark, sf_dir):
    """A head fitted on embeddings by Newton's method: the gradient of its loss at every weight, recomputed in
    expressions, is below a millionth of the rows."""
    v = staged(table(spark, sf_dir, "embeddings").select("embedding", (F.col("label") >= 5).cast("int").alias("label")), "head")
    head = logistic.fit(v, "embedding", "label")
    n = v.count()
    return logistic.gradient(v, head, "embedding", "label").select(
        big("place").alias("place"), (F.abs(F.col("gradient")) <= n * 1e-6).alias("near_zero")
    )


# ---- streams ------------------------------------------------------------------------------------

_ONCE = {"availableNow": True}


def _stream(spark, sf_dir, name) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return live.read_stream(spark, sf_dir, schema, f"{name}.parquet")


def _arriving_documents(spark, sf_dir) -> DataFrame:
    """Documents as requests, spread by key because a file arrives as few splits."""
    cores = spark.sparkContext.defaultParallelism
    return _stream(spark, sf_dir, "documents").repartition(cores, "doc_id").select(
        "doc_id", F.col("text").alias("prompt"), F.col("text").alias("response")
    )


def _finish(query) -> None:
    query.awaitTermination()


def stream_screening(spark, sf_dir):
    """Documents arriving as requests, screened into the decision log, read back."""
    arriving = _arriving_documents(spark, sf_dir)
    log = scratch_path(spark, "stream-log")
    _finish(live.append_to_log(live.screen_stream(arriving, GUARDS), log, scratch_path(spark, "cp"), _ONCE))
    return spark.read.parquet(log).select("doc_id", "type", "decision", "response", "detail")


def stream_newest(spark, sf_dir):
    """The newest entries of a log a stream has written: all from here, so ordered by document."""
    arriving = _arriving_documents(spark, sf_dir)
    log = scratch_path(spark, "stream-log")
    _finish(live.append_to_log(live.screen_stream(arriving, GUARDS), log, scratch_path(spark, "cp"), _ONCE))
    first_day = decision_log.days_of(decision_log.read(spark, log))[0]
    return decision_log.newest(decision_log.read(spark, log, first_day), 500, ("doc_id",)).select("doc_id", "type", "decision")


def stream_pairs(spark, sf_dir):
    """Prompts and answers arriving apart, paired by conversation and turn; unanswered prompts too.

    A row of each side that arrives a day after all others lets the watermark pass them, so that prompts
    without an answer come out. The watermark never passes those two rows themselves, so they do not.
    """
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn"))
    turns = table(spark, sf_dir, "conversations")
    last = turns.agg(
        (F.coalesce(F.max("conv_id"), F.lit(0)) + 1).alias("conv_id"), (F.coalesce(F.max("turn"), F.lit(0)) + 86_400).alias("turn")
    )
    later = scratch_path(spark, "stream-later")
    closing = last.select(*[
        (F.col(f.name) if f.name in last.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in turns.schema
    ])
    closing.write.parquet(later)

    def side(role):
        rows = _stream(spark, sf_dir, "conversations").filter(F.col("role") == role)
        return rows.union(live.read_stream(spark, later, turns.schema)).withColumn("ts", at)

    pairs = live.pair_turns(side("user"), side("assistant"))
    out = scratch_path(spark, "stream-pairs")
    _finish(live.write_table(pairs, out, scratch_path(spark, "cp"), _ONCE))
    return spark.read.schema("conv_id bigint, turn bigint, ts timestamp, prompt string, response string").parquet(out).select(
        "conv_id", "turn", "prompt", "response"
    )


def stream_windows(spark, sf_dir):
    """Windowed counts in update mode; the last update of a window is its result."""
    arriving = _stream(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    counts = live.decision_windows(arriving, "1 day", "40 days", by="event_type", latency="cents")
    out = scratch_path(spark, "stream-windows")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _finish(
        counts.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, "cp")).trigger(**_ONCE).start()
    )
    updates = spark.read.parquet(out)
    last = updates.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "mean_latency_ms"), "batch").alias("r"))
    start = F.col("window_start").cast("timestamp_ntz").alias("window_start")
    return last.select(start, "event_type", big("r.n").alias("n"), r6("r.mean_latency_ms").alias("mean_cents"))


def stream_first_arrivals(spark, sf_dir):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 600)
    rows = live.first_arrivals(_stream(spark, sf_dir, "documents").withColumn("ts", at), within="1 day")
    out = scratch_path(spark, "stream-first")
    _finish(live.write_table(rows.select("near_key"), out, scratch_path(spark, "cp"), _ONCE))
    return spark.read.parquet(out)


def windowed_decisions(spark, sf_dir):
    w = live.decision_windows(events(spark, sf_dir), "1 day", by="event_type", latency="cents")
    return w.select("window_start", "event_type", big("n").alias("n"), r6("mean_latency_ms").alias("mean_cents"))


_NAMES = [
    "pii_mask", "pii_scan", "pii_entity_freq", "pii_mask_freq",
    "normalize_ws", "clip_text", "injection_tags", "near_keys", "word_stats",
    "language_route", "route_vs_label_lang", "language_buckets", "history_language",
    "keyword_ensemble", "aggregate_score", "score_summary", "blocking_labels", "blocking_confidence",
    "softmax_block", "clamp_threshold", "toxicity_details", "truncated_inputs", "subword_truncation", "external_classifier", "external_predictions",
    "resolve_labels", "resolve_lang", "filtered_source", "split_labels", "source_stats",
    "last_user_prompt", "next_responses", "screen_conversations", "screen_last_prompts", "screen_documents",
    "screen_without_output", "screening_scores", "decision_stats", "latency_stats", "blocked_by_freq",
    "recent_decisions", "recent_stats", "log_roundtrip", "log_newest", "error_payloads", "decision_filter", "score_band", "chat_messages", "chat_responses",
    "batch_requests", "batch_screening", "batch_flow", "screen_failures", "language_trained", "daily_rollups",
    "dedupe_kept", "dedupe_rows", "incremental_dedupe", "dedupe_counts", "unseen_documents", "balance", "balance_stats",
    "split", "split_summary", "stratum_count", "training_order", "built_corpus", "catalogue_scan", "split_sinks", "held_out_sets", "manifest_rows",
    "confusion_slices", "roc_auc", "pr_auc", "evaluation_report", "rounded_report", "p95_rank", "threshold_sweep",
    "model_bake_off", "promotion_gate", "labelled_accuracy", "first_rows",
    "toxicity_model", "bundle_model", "embedding_head", "tfidf_weights", "embedding_head_gradient",
    "stream_screening", "stream_newest", "stream_pairs", "stream_windows", "stream_first_arrivals",
    "windowed_decisions",
]
QUERIES: dict[str, Query] = {name: globals()[name] for name in _NAMES}
