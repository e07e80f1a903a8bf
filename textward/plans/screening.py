"""Screening requests and their recorded responses.

One lazy plan: route the prompt, score it, take the response of prompts that pass, mask it, score
the masked text, decide. Work meant only for prompts that pass sees nulls for the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textward.functions import chat, language, pii
from textward.functions import scores as S
from textward.functions.planning import evaluate_here
from textward.operators import ensemble as E

# Texts the results carry.
REFUSAL = "Sorry, I cannot answer this prompt"
NO_PROMPT = "No user message found in request."
ALL_PASSED = "All classifiers passed"
OUTPUT_DISABLED = "Output classifiers disabled; upstream response returned without output validation"
EMPTY_RESPONSE = "(empty response)"
NO_RESPONSE = "no recorded response"

# Type of the log entry per stage that decided.
LOG_TYPES = {
    "allowed": "PASSED",
    "blocked": "INPUT_BLOCKED",
    "dropped": "OUTPUT_BLOCKED",
    "upstream": "UPSTREAM_ERROR",
    "input_model": "INPUT_MODEL_ERROR",
    "output_model": "OUTPUT_MODEL_ERROR",
}


@dataclass(frozen=True)
class Options:
    refusal_message: str = REFUSAL
    enable_output_classifiers: bool = True
    preferred_lang: str = "en"
    mask_char: str = "*"
    detector: language.Detector = language.heuristic_detector


RESULT_COLUMNS = [
    "prompt", "status_code", "decision", "content", "scores", "latencies_ms", "total_latency_ms",
    "detail", "failed_filters", "log_type", "logged_response",
]


# ---- requests -----------------------------------------------------------------------------------


def _prompts(conversations: DataFrame) -> DataFrame:
    return conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt")
    )


def _answers(conversations: DataFrame) -> DataFrame:
    return conversations.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("text").alias("response")
    )


TURNS_PER_CHUNK = 1024


def next_answers(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, answer_turn) of the turns a user speaks at, answered or not.

    A user's turn is answered by the next one of its conversation at which the user or the assistant
    speaks, if the assistant does; turns of others and missing numbers in between do not matter.

    Turns are looked at in chunks, whose last turn needs the first one of a later chunk: one narrow row per
    chunk goes through the window of a whole conversation, so that a conversation of millions of turns is
    spread over all tasks. Rows without a conversation or turn have no answer.
    """
    spoken = (
        conversations.filter(F.col("role").isin("user", "assistant"))
        .groupBy("conv_id", "turn").agg(F.max(F.col("role") == "user").alias("asks"), F.max(F.col("role") == "assistant").alias("answers"))
        .withColumn("chunk", F.floor(F.col("turn") / TURNS_PER_CHUNK))
    )
    turn = F.struct("turn", "answers")
    in_chunk = Window.partitionBy("conv_id", "chunk").orderBy("turn")
    chunks = spoken.groupBy("conv_id", "chunk").agg(F.min(turn).alias("first"))
    later = chunks.select("conv_id", "chunk", F.lead("first").over(Window.partitionBy("conv_id").orderBy("chunk")).alias("later"))
    # A chunk has 1,024 rows at most; only the last of them looks beyond it.
    here = spoken.withColumn("next", F.lead(turn).over(in_chunk)).filter("asks")
    found = here.join(later, ["conv_id", "chunk"], "left").withColumn("next", F.coalesce("next", "later"))
    return found.select("conv_id", "turn", F.when(F.col("next.answers"), F.col("next.turn")).alias("answer_turn"))


def _with_answers(prompts: DataFrame, conversations: DataFrame) -> DataFrame:
    """The prompts (conv_id, turn, ...) with the response that answers them, null if none does."""
    found = next_answers(conversations).filter("answer_turn is not null")
    answered = prompts.join(found, ["conv_id", "turn"], "left")
    at = (F.col("conv_id") == F.col("a_conv")) & (F.col("answer_turn") == F.col("a_turn"))
    return answered.join(_answers(conversations), at, "left").drop("answer_turn", "a_conv", "a_turn")


def user_turns(conversations: DataFrame) -> DataFrame:
    """Every user turn as a request, with the assistant turn that answers it, if there is one.

    Texts are joined on (conversation, turn), a key no row shares with another, so that a long
    conversation is spread over all tasks.
    """
    return _with_answers(_prompts(conversations), conversations)


def last_prompts(conversations: DataFrame) -> DataFrame:
    """Per conversation, the text of its last user turn (``""`` without one) and that turn.

    The turn is found from the narrow columns; only then are texts joined, by (conversation,
    turn), which is also the key the responses are joined by.
    """
    last = conversations.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("turn")
    )
    return last.join(_prompts(conversations), ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("prompt", F.lit("")).alias("prompt")
    )


def last_turns(conversations: DataFrame) -> DataFrame:
    """One request per conversation: its last user prompt and the response recorded for it."""
    return _with_answers(last_prompts(conversations), conversations)


def requests_from_messages(df: DataFrame, messages: str = "messages") -> DataFrame:
    return df.withColumn("prompt", chat.last_user_prompt(F.col(messages)))


def with_history_language(turns: DataFrame, route: str = "route") -> DataFrame:
    """Adds ``history_lang``: the language of the last earlier turn that was told by its text.

    Chunks of turns are looked at by themselves; what a chunk inherits comes from one row per
    earlier chunk, so that a long conversation does not end up in one task.
    """
    told = F.when(~F.col(f"{route}.method").startswith("fallback"), F.col(f"{route}.lang"))
    chunked = turns.withColumn("__told", told).withColumn(
        "__chunk", F.floor(F.col("turn") / TURNS_PER_CHUNK)
    )
    in_chunk = Window.partitionBy("conv_id", "__chunk").orderBy("turn").rowsBetween(
        Window.unboundedPreceding, -1
    )
    by_chunk = chunked.groupBy("conv_id", "__chunk").agg(
        F.max(F.when(F.col("__told").isNotNull(), F.struct("turn", "__told")))["__told"].alias("__last")
    )
    earlier = Window.partitionBy("conv_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    inherited = by_chunk.select(
        "conv_id", "__chunk", F.last("__last", True).over(earlier).alias("__inherited")
    )
    return (
        chunked.withColumn("__here", F.last("__told", True).over(in_chunk))
        .join(inherited, ["conv_id", "__chunk"])
        .withColumn("history_lang", F.coalesce("__here", "__inherited"))
        .drop("__told", "__chunk", "__here", "__inherited")
    )


# ---- the plan -----------------------------------------------------------------------------------


def _per_bucket(registry: E.Registry, bucket: Column, make) -> tuple[Column, Column]:
    """(value, error) by language bucket; a bucket that cannot be built gives its error text."""
    value, error = F.lit(None), F.lit(None).cast("string")
    for name, specs in registry.inputs.items():
        here = bucket == name
        try:
            value = F.when(here, make(specs, here)).otherwise(value)
        except Exception as exc:
            error = F.when(here, F.lit(str(exc))).otherwise(error)
    return value.cast(f"array<{E.FILTER_RESULT}>"), error


def with_route(df: DataFrame, registry: E.Registry, options: Options = Options(), history: str | None = None) -> DataFrame:
    """Adds ``route``: STRUCT<lang, confidence, method, target> of the prompt."""
    found = language.detect(
        F.col("prompt"),
        preferred=options.preferred_lang,
        history=F.col(history) if history else None,
        short_detector=options.detector,
        long_detector=options.detector,
    )
    detected = df.withColumn("route", evaluate_here(found))
    r = F.col("route")
    return detected.withColumn(
        "route",
        F.struct(
            r["lang"].alias("lang"),
            r["confidence"].alias("confidence"),
            r["method"].alias("method"),
            language.target(
                r["lang"], registry.target_name("en"), registry.target_name("es")
            ).alias("target"),
        ),
    )


def score_inputs(
    df: DataFrame, registry: E.Registry, options: Options = Options(), history: str | None = None
) -> DataFrame:
    """Adds the route and the input ensemble's results for the prompt's language."""
    routed = with_route(df, registry, options, history)
    bucket = language.resolve_bucket(F.col("route.lang"), list(registry.inputs))
    has_prompt = F.coalesce(F.col("prompt") != "", F.lit(False))
    results, error = _per_bucket(
        registry,
        bucket,
        lambda specs, here: E.evaluate_all(specs, F.col("prompt"), here & has_prompt),
    )
    return routed.withColumn("input_results", evaluate_here(results)).withColumn("input_error", error)


def screen(
    requests: DataFrame,
    registry: E.Registry = E.DEFAULT_REGISTRY,
    options: Options = Options(),
    history: str | None = None,
) -> DataFrame:
    """Decides every request. Needs ``prompt`` and ``response``; other columns are kept.

    A null response stands for a failed call, for the reason in ``upstream_error`` if that
    column exists. A classifier that cannot be built, or fails on a row, decides that row as an
    error with its message; the row does not pass, and other rows go on.
    """
    keep = [c for c in requests.columns if c not in ("prompt", "response", "upstream_error")]
    scored = score_inputs(requests, registry, options, history)
    scored = scored.withColumn("input_error", F.coalesce("input_error", E.first_error(F.col("input_results"))))

    output_error = None
    if options.enable_output_classifiers:
        try:
            for spec in registry.outputs:
                E.check_spec(spec)
        except Exception as exc:
            output_error = str(exc)

    no_prompt = F.coalesce(F.col("prompt") == "", F.lit(True))
    input_ok = (
        ~no_prompt
        & F.col("input_error").isNull()
        & F.lit(output_error is None)
        & E.passed(F.col("input_results"))
    )
    staged_1 = scored.withColumn("__input_ok", F.coalesce(input_ok, F.lit(False))).withColumn(
        "__response", F.when(F.col("__input_ok"), F.col("response"))
    )
    masked = pii.mask(staged_1, "__response", "__masked", options.mask_char)
    text, entities = F.col("__masked.text"), F.col("__masked.masked_entities")
    runs_output = options.enable_output_classifiers and output_error is None
    outputs = (
        F.when(text.isNotNull(), E.evaluate_all(registry.outputs, text, text.isNotNull()))
        if runs_output
        else F.lit(None).cast(f"array<{E.FILTER_RESULT}>")
    )
    done = masked.withColumn("__out", text).withColumn("output_results", evaluate_here(outputs))
    failed_here = E.first_error(F.col("output_results"))

    # Decided by the first of these that holds.
    out = F.col("__out")
    stage = (
        F.when(no_prompt, "no_prompt")
        .when(F.col("input_error").isNotNull(), "input_model")
        .when(F.lit(output_error is not None), "output_model")
        .when(~F.col("__input_ok"), "blocked")
        .when(out.isNull(), "upstream")
        .when(failed_here.isNotNull(), "output_model")
        .when(~F.coalesce(E.passed(F.col("output_results")), F.lit(True)), "dropped")
        .otherwise("allowed")
    )
    done = done.withColumn("__stage", evaluate_here(stage))
    is_ = lambda *names: F.col("__stage").isin(*names)

    route_line = language.route_detail(F.col("route"))
    reason = F.coalesce(
        F.col("upstream_error") if "upstream_error" in requests.columns else F.lit(None).cast("string"),
        F.lit(NO_RESPONSE),
    )
    refusal, model_error = F.lit(options.refusal_message), F.coalesce(F.lit(output_error), failed_here)
    in_failed, out_failed = E.failed_filters(F.col("input_results")), E.failed_filters(F.col("output_results"))
    masked_line = F.when(
        F.size(entities) > 0, F.concat(F.lit("PII masked: "), F.array_join(entities, ", "))
    )
    headline = (
        F.when(is_("input_model"), F.concat(F.lit("Input model error: "), F.col("input_error")))
        .when(is_("blocked"), F.concat(F.lit("Blocked by input classifiers: "), F.array_join(in_failed, ", ")))
        .when(is_("upstream"), F.concat(F.lit("Upstream error: "), reason))
        .when(is_("dropped"), F.concat(F.lit("Blocked by output classifiers: "), F.array_join(out_failed, ", ")))
        .otherwise(F.lit(ALL_PASSED if options.enable_output_classifiers else OUTPUT_DISABLED))
    )
    detail = (
        F.when(is_("no_prompt"), NO_PROMPT)
        .when(is_("output_model"), F.concat(F.lit("Output model error: "), model_error))
        .otherwise(F.concat_ws(" | ", headline, route_line, F.when(is_("dropped", "allowed"), masked_line)))
    )
    content = (
        F.when(is_("no_prompt"), "")
        .when(is_("input_model"), F.col("input_error"))
        .when(is_("output_model"), model_error)
        .when(is_("blocked", "dropped"), refusal)
        .when(is_("upstream"), reason)
        .otherwise(out)
    )
    logged = (
        F.when(is_("dropped"), F.coalesce(F.nullif(out, F.lit("")), refusal))
        .when(is_("allowed"), F.coalesce(F.nullif(out, F.lit("")), F.lit(EMPTY_RESPONSE)))
        .when(~is_("no_prompt"), content)
    )

    def summary(of, router_value: Column) -> Column:
        empty = F.create_map().cast("map<string,double>")
        router = F.create_map(F.lit(S.ROUTER_KEY), router_value)
        input_part = F.when(is_("blocked", "upstream", "dropped", "allowed"), S.prefix_keys(of(F.col("input_results")), "input"))
        output_part = F.when(F.col("output_results").isNotNull(), S.prefix_keys(of(F.col("output_results")), "output"))
        merged = S.merge_maps(S.merge_maps(F.coalesce(input_part, empty), router), F.coalesce(output_part, empty))
        return F.when(is_("no_prompt", "output_model"), empty).otherwise(merged)

    finished = done.withColumn(
        "scores", summary(E.scores_summary, F.col("route.confidence"))
    ).withColumn("latencies_ms", summary(E.latencies_summary, F.lit(0.0)))
    log_type = F.lit(None).cast("string")
    for name, type_ in LOG_TYPES.items():
        log_type = F.when(is_(name), type_).otherwise(log_type)
    return finished.select(
        *keep,
        F.coalesce("prompt", F.lit("")).alias("prompt"),
        F.when(is_("no_prompt"), 400)
        .when(is_("input_model", "output_model"), 503)
        .when(is_("upstream"), 502)
        .otherwise(200)
        .alias("status_code"),
        F.when(is_("allowed"), "ALLOWED").when(is_("blocked"), "BLOCKED").when(is_("dropped"), "DROPPED")
        .otherwise("ERROR").alias("decision"),
        content.alias("content"),
        "scores",
        "latencies_ms",
        F.aggregate(F.map_values("latencies_ms"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
        .alias("total_latency_ms"),
        detail.alias("detail"),
        F.when(is_("blocked"), in_failed).when(is_("dropped"), out_failed)
        .otherwise(F.array().cast("array<string>")).alias("failed_filters"),
        log_type.alias("log_type"),
        logged.alias("logged_response"),
    )


def log_entries(results: DataFrame) -> DataFrame:
    """The rows the decision log keeps; requests without a prompt are not logged.

    ``failed_filters`` is set only on entries that were blocked or dropped.
    """
    return results.filter(F.col("log_type").isNotNull()).select(
        *[c for c in results.columns if c not in RESULT_COLUMNS],
        F.col("log_type").alias("type"),
        "prompt",
        F.col("logged_response").alias("response"),
        "decision",
        "scores",
        "latencies_ms",
        "total_latency_ms",
        "detail",
        F.when(F.col("decision").isin("BLOCKED", "DROPPED"), F.col("failed_filters")).alias("failed_filters"),
    )


def payload(results: DataFrame, model: str = "textward") -> DataFrame:
    """Adds ``payload``, the JSON a caller would see: the response, a refusal or an error."""
    envelope = chat.response_envelope(
        F.col("content"), model, chat.random_response_id(), F.unix_timestamp()
    )
    message = (
        F.when(F.col("status_code") == 502, F.concat(F.lit("Upstream LLM error: "), F.col("content")))
        .otherwise(F.col("detail"))
    )
    error = F.to_json(F.struct(F.struct(message.alias("message")).alias("error")))
    return results.withColumn(
        "payload", F.when(F.col("status_code") == 200, F.to_json(envelope)).otherwise(error)
    )


def score_bands(results: DataFrame) -> DataFrame:
    """One row per displayed score, with its band."""
    return results.select(
        *[c for c in results.columns if c not in RESULT_COLUMNS],
        F.explode(S.without_router(F.col("scores"))).alias("filter_name", "score"),
    ).withColumn("band", S.severity_band(F.col("score")))
