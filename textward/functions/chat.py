"""Chat requests and responses, as arrays and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
REQUEST = f"struct<model:string,messages:{MESSAGES}>"
RESPONSE = (
    "struct<id:string,object:string,created:bigint,model:string,"
    "choices:array<struct<index:int,message:struct<role:string,content:string>,finish_reason:string>>,"
    "usage:struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>>"
)

DEFAULT_CONCURRENCY = 20


def last_user_prompt(messages: Column) -> Column:
    """Content of the last user message, ``""`` without one; an empty one is kept as it is."""
    from_user = F.filter(messages, lambda m: m["role"] == "user")
    last = F.get(from_user, F.size(from_user) - 1)
    return F.coalesce(last["content"], F.lit(""))


def assistant_content(response: Column) -> Column:
    """``choices[0].message.content``, ``""`` where any of it is missing."""
    return F.coalesce(F.get(response["choices"], F.lit(0))["message"]["content"], F.lit(""))


def replace_assistant_content(response: Column, content: Column) -> Column:
    """The response with the first choice's text replaced; no choices, no change."""
    return response.withField(
        "choices",
        F.transform(
            response["choices"],
            lambda c, i: F.when(i == 0, c.withField("message.content", content)).otherwise(c),
        ),
    )


def response_envelope(content: Column, model: Column | str, id: Column, created: Column) -> Column:
    """A chat-completion STRUCT holding one assistant message; ``to_json`` it for a payload."""
    zero = F.lit(0)
    return F.struct(
        id.alias("id"),
        F.lit("chat.completion").alias("object"),
        created.cast("bigint").alias("created"),
        (model if isinstance(model, Column) else F.lit(model)).alias("model"),
        F.array(
            F.struct(
                zero.alias("index"),
                F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"),
                F.lit("stop").alias("finish_reason"),
            )
        ).alias("choices"),
        F.struct(
            zero.alias("prompt_tokens"), zero.alias("completion_tokens"), zero.alias("total_tokens")
        ).alias("usage"),
    )


def random_response_id() -> Column:
    return F.concat(F.lit("chatcmpl-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 29))


def build_messages(system: Column | None, prompt: Column) -> Column:
    """The system message, if there is a non-empty one, then the user's prompt."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    user = message("user", prompt)
    if system is None:
        return F.array(user)
    return F.array_compact(F.array(F.when(system != "", message("system", system)), user))


def batch_error(
    prompts: Column,
    model: Column,
    system_message: Column,
    concurrency: Column,
    max_prompts: int | None = None,
) -> Column:
    """The message of the first check a batch request fails, null when it passes all.

    A batch may have any number of prompts unless ``max_prompts`` is given. The concurrency is only
    checked to be a positive number: how much runs at once is up to the cluster.

    Arguments are the request's JSON values, each as JSON text (null when the key is absent).
    """
    items = F.from_json(F.when(prompts.startswith("["), prompts), "array<string>")
    # Each item as JSON text tells a string from a number; nulls come back as nulls.
    is_string = lambda v: v.startswith('"')
    quoted = F.from_json(F.when(prompts.startswith("["), prompts), "array<variant>")
    all_strings = F.forall(
        quoted, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    )
    model_text = F.get(F.from_json(F.concat(F.lit("["), model, F.lit("]")), "array<string>"), F.lit(0))
    count = F.when(concurrency.rlike(r"^-?[0-9]+$"), concurrency.try_cast("decimal(38,0)"))
    # A JSON true counts as the integer 1.
    count = F.when(concurrency == "true", F.lit(1).cast("decimal(38,0)")).otherwise(count)
    no_prompts = F.coalesce(F.size(items) < 1, F.lit(True)) | items.isNull()
    too_many = F.lit(False) if max_prompts is None else F.size(items) > max_prompts
    # The messages.
    return (
        F.when(no_prompts, "`prompts` must be a non-empty array of strings.")
        .when(too_many, f"Batch requests are limited to {max_prompts} prompts.")
        .when(
            model.isNotNull()
            & ~F.coalesce(is_string(model) & (F.trim(model_text) != ""), F.lit(False)),
            "`model` must be a non-empty string.",
        )
        .when(
            system_message.isNotNull() & (system_message != "null") & ~is_string(system_message),
            "`system_message` must be a string when provided.",
        )
        .when(~all_strings, "Every item in `prompts` must be a string.")
        .when(
            concurrency.isNotNull() & ~F.coalesce(count >= 1, F.lit(False)),
            "`concurrency` must be an integer greater than 0.",
        )
    )
