"""Prompt batches: one JSON request holding many prompts, or one prompt a line in as many files as it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textward.functions.chat import DEFAULT_CONCURRENCY, batch_error, build_messages
from textward.operators.summaries import decision_counts
from textward.session import staged


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: ``file`` and ``body``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("body")
    )


def checked_requests(
    requests: DataFrame, default_model: str = "default", max_prompts: int | None = None
) -> DataFrame:
    """Adds ``prompts``, ``model``, ``system_message``, ``concurrency`` and ``error``.

    ``error`` is null for a sound request, else the message of the first check it fails. The
    concurrency is the number asked for, at most one per prompt.
    """
    raw = F.from_json("body", "prompts string, model string, system_message string, concurrency string")
    body = F.try_parse_json("body")

    def value(name: str):
        # JSON text of the value, null when the key is absent; a JSON null stays "null".
        return F.to_json(F.try_variant_get(body, f"$.{name}", "variant"))

    is_object = F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False))
    error = F.when(body.isNull(), "Invalid JSON body").when(
        ~is_object, "Request body must be a JSON object."
    ).otherwise(
        batch_error(value("prompts"), value("model"), value("system_message"), value("concurrency"), max_prompts)
    )
    checked = requests.select("*", error.alias("error"), raw.alias("__raw"))
    sound = checked.select(
        *requests.columns,
        "error",
        F.from_json(F.when(F.col("error").isNull(), F.col("__raw.prompts")), "array<string>").alias("prompts"),
        F.coalesce(F.col("__raw.model"), F.lit(default_model)).alias("model"),
        F.col("__raw.system_message").alias("system_message"),
        F.coalesce(F.col("__raw.concurrency").try_cast("decimal(38,0)"), F.lit(DEFAULT_CONCURRENCY)).alias("__c"),
    )
    return sound.withColumn("concurrency", F.when(F.col("prompts").isNotNull(), F.least(F.col("__c"), F.size("prompts")).cast("int"))).drop("__c")


def prompt_rows(checked: DataFrame) -> DataFrame:
    """One row per prompt of the sound requests: its index and the messages it is sent as."""
    keep = [c for c in checked.columns if c not in ("prompts", "error", "body")]
    return checked.filter(F.col("error").isNull()).select(
        *keep, F.posexplode("prompts").alias("index", "prompt")
    ).withColumn("messages", build_messages(F.col("system_message"), F.col("prompt")))


def read_prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    """(index, prompt, line, fault) of a request whose prompts are lines of JSON, in a file or a folder of them.

    A line is a string, or an object with a string ``prompt``; ``line`` is its text, which may hold more, and
    ``fault`` says why it has no prompt. Blank lines do not count. ``index`` numbers the lines from 0 in the
    order of file names and lines.

    Files are split like any other text, and every line is parsed where it is read. A line's number is its place
    in its block plus the lines of all blocks before, of which there is one narrow row each.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"),
    )
    value = F.try_parse_json("line")
    kind = F.schema_of_variant(value)
    prompt = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(
        F.schema_of_variant(F.try_variant_get(value, "$.prompt", "variant")) == "STRING", F.try_variant_get(value, "$.prompt", "string")
    )
    fault = F.when(value.isNull(), "Invalid JSON body").when(prompt.isNull(), "Every item in `prompts` must be a string.")
    lines = staged(lines.withColumns({"prompt": prompt, "fault": fault}), "prompt-lines")
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(staged(blocks, "blocks"), ["file", "block"]).select(
        (F.col("at") + F.col("shift")).alias("index"), "prompt", "line", "fault"
    )


def lines_error(lines: DataFrame) -> str | None:
    """Why the request of these lines is refused, if it is: it has no line, or the first faulty line's fault."""
    found = lines.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("fault").isNotNull(), F.struct("index", "fault"))).alias("bad")).first()
    if not found["n"]:
        return "`prompts` must be a non-empty array of strings."
    return found["bad"]["fault"] if found["bad"] else None


def summary(results: DataFrame) -> DataFrame:
    """One row: the batch's total and how many of its prompts were allowed, blocked, dropped and errors."""
    return decision_counts(results).select("total", "allowed", "blocked", "dropped", "errors")
