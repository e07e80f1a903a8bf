"""Chat formatting: tool calls linked to their results, ordered, validated and written as JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.session import staged


@dataclass(frozen=True)
class Argument:
    """What a schema says about one argument: its JSON kind and, if given, its bounds."""

    kind: str  # string, integer, number, boolean, object, array
    required: bool = True
    least: float | None = None  # of a number, or of a string's length
    most: float | None = None
    choices: tuple[str, ...] = ()


Schemas = dict[str, dict[str, Argument]]

# Spark's names of the kinds of JSON values, as their types begin.
_KINDS = {
    "string": r"^STRING", "integer": r"^BIGINT", "number": r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": r"^BOOLEAN",
    "object": r"^OBJECT", "array": r"^ARRAY",
}


def _argument_error(value: Column, name: str, spec: Argument) -> Column:
    """What is wrong with an argument, null if nothing is; a JSON null counts as missing."""
    found = F.schema_of_variant(F.try_variant_get(value, f"$['{name}']", "variant"))
    missing = found.isNull() | (found == "VOID")
    text = F.try_variant_get(value, f"$['{name}']", "string")
    measure = F.length(text).cast("double") if spec.kind == "string" else F.try_variant_get(value, f"$['{name}']", "double")
    error = F.when(missing, F.lit(f"{name} is missing") if spec.required else F.lit(None).cast("string")).when(
        ~found.rlike(_KINDS[spec.kind]), F.lit(f"{name} is not of kind {spec.kind}")
    )
    if spec.least is not None:
        error = error.when(measure < spec.least, F.lit(f"{name} is below {spec.least:g}"))
    if spec.most is not None:
        error = error.when(measure > spec.most, F.lit(f"{name} is above {spec.most:g}"))
    if spec.choices:
        error = error.when(~text.isin(*spec.choices), F.lit(f"{name} is not a choice"))
    return error


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments (JSON text) by its tool's schema, in order, as an array."""
    value = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    chain = None
    for tool, fields in sorted(schemas.items()):
        errors = [_argument_error(value, field, spec) for field, spec in sorted(fields.items())]
        unknown = F.transform(
            F.array_sort(F.array_distinct(F.filter(keys, lambda k: ~k.isin(*fields)))), lambda k: F.concat(k, F.lit(" is unknown"))  # noqa: B023
        )
        found = F.concat(F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>"), unknown)
        chain = F.when(name == tool, found) if chain is None else chain.when(name == tool, found)
    no_tool = F.array(F.lit("tool is unknown"))
    not_object = F.coalesce(~F.schema_of_variant(value).rlike("^OBJECT"), F.lit(True))
    return F.when(not_object, F.array(F.lit("arguments are not a JSON object"))).otherwise(
        no_tool if chain is None else chain.otherwise(no_tool)
    )


def depths(nodes: DataFrame) -> DataFrame:
    """(node, depth) of distinct nodes with a ``parent`` each or null: 0 without a parent that exists,
    else one more than the parent's; null on a cycle and below one.

    Pointers double in each round, so a chain of n takes log n rounds of one join. A round's table is
    written to the shared folder. Only unfinished nodes are joined on.
    """
    names = nodes.select(F.col("node").alias("known"))
    state = nodes.join(names, F.col("parent") == F.col("known"), "left").select(
        "node", F.col("known").alias("up"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("steps")
    )
    state = staged(state, "pointers")
    rounds = max(state.count(), 1).bit_length() + 1
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        above = state.select(F.col("node").alias("above"), F.col("up").alias("next"), F.col("steps").alias("more"))
        state = staged(
            state.join(above, F.col("up") == F.col("above"), "left").select(
                "node", F.col("next").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
            ),
            "pointers",
        )
    return state.select("node", F.when(F.col("up").isNull(), F.col("steps")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, call_id, depth, status, errors, n_calls, n_results, message) of every call and result.

    ``calls`` has (conv_id, call_id, after, name, arguments): ``after`` is the call of the
    conversation that it follows, or null, and arguments are JSON text. ``results`` has (conv_id,
    call_id, content). Other columns are ignored. Calls and results of one conversation and
    identifier meet in a hash join; one row comes out for each identifier.

    ``depth`` is the place in topological order: 0 for a call that follows none, or one that is not
    there, else one more than what it follows. Calls of a depth can go in any order; (depth,
    call_id) orders a conversation. It is null for calls that follow themselves by a cycle, and for
    results without a call.

    ``status`` is the first that applies: ``no_call``, ``cycle``, ``invalid`` (``errors``, joined by
    "; ", is not empty), ``no_result``, ``linked``. Identifiers that repeat count as one, the
    smallest (name, arguments, after) or content, and the counts tell. A null identifier or
    conversation is one like any other and is never followed. ``message`` is canonical JSON: keys
    in order at every level, no spaces. Arguments that are not JSON are a JSON string in it.
    Empty tables give an empty table.
    """
    key = ("conv_id", "call_id")
    c = calls.select(*key, "after", "name", "arguments").groupBy(*key).agg(
        F.min(F.struct("name", "arguments", "after")).alias("call"), F.count("*").alias("n_calls")
    )
    r = results.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), "content").groupBy("r_conv", "r_call").agg(
        F.min("content").alias("content"), F.count("*").alias("n_results")
    )
    node = lambda conv, call: F.to_json(F.array(conv.cast("string"), call.cast("string")))
    c = staged(c.select(*key, "call.*", "n_calls", node(F.col("conv_id"), F.col("call_id")).alias("node")), "calls")
    parent = F.when(F.col("after").isNotNull() & F.col("conv_id").isNotNull(), node(F.col("conv_id"), F.col("after")))
    c = c.join(depths(c.select("node", parent.alias("parent"))), "node").drop("node")
    c = c.withColumn("problems", argument_errors(F.col("name"), F.col("arguments"), schemas))
    both = c.withColumn("called", F.lit(True)).join(
        r, F.col("conv_id").eqNullSafe(F.col("r_conv")) & F.col("call_id").eqNullSafe(F.col("r_call")), "full_outer"
    )
    called = F.col("called").isNotNull()
    answered = F.col("n_results").isNotNull()
    parsed = F.coalesce(F.try_parse_json("arguments"), F.parse_json(F.coalesce(F.to_json(F.col("arguments").cast("variant")), F.lit("null"))))
    both = both.withColumns({
        "conv": F.when(called, F.col("conv_id")).otherwise(F.col("r_conv")),
        "id": F.when(called, F.col("call_id")).otherwise(F.col("r_call")),
    })
    message = F.to_json(
        F.struct(
            parsed.alias("arguments"), F.col("id").alias("call_id"), F.col("conv").alias("conv_id"),
            F.col("depth"), F.col("name"), F.col("content").alias("result"),
        ),
        {"ignoreNullFields": "false"},
    )
    errors = F.array_join("problems", "; ")
    return both.select(
        F.col("conv").alias("conv_id"), F.col("id").alias("call_id"), "depth",
        F.when(~called, "no_call").when(F.col("depth").isNull(), "cycle").when(F.size("problems") > 0, "invalid")
        .when(~answered, "no_result").otherwise("linked").alias("status"),
        F.when(called, errors).alias("errors"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        message.alias("message"),
    )
