import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textward.functions import chat, labels, scores


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, data, dtype, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], T.StructType([T.StructField("i", T.LongType()), T.StructField("v", dtype)]))
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_label_rules(spark):
    string, integer = T.StringType(), T.IntegerType()
    resolve = lambda dtype, **k: lambda c: labels.resolve_label(c, dtype, **k)
    spellings = ["1", " TRUE ", "injection", "Jailbreak", "blocked", "malicious", "unsafe", "0", "false", "Benign", "PASS", "safe", "maybe", "", None]
    assert values(spark, spellings, string, resolve(string)) == [1] * 7 + [0] * 5 + [None] * 3
    assert values(spark, [0, 1, 2, -1, None], integer, resolve(integer)) == [0, 1, 2, -1, None]
    assert values(spark, [1.9, -1.9, 0.2], T.DoubleType(), resolve(T.DoubleType())) == [1, -1, 0]
    assert values(spark, [True, False, None], T.BooleanType(), resolve(T.BooleanType())) == [1, 0, None]
    mapped = resolve(string, label_map={"BLOCKED": 1, "PASS": 0, "safe": 1}, drop_values=["VARIES", "BLOCKED", "true"])
    assert values(spark, ["BLOCKED", "PASS", "VARIES", "safe", "true", "True", "x"], string, mapped) == [1, 0, None, 1, None, 1, None]
    assert values(spark, [3, None], integer, resolve(integer, fixed=1)) == [1, 1]
    assert values(spark, [3, None], integer, resolve(integer, forced=F.lit(0), fixed=1)) == [0, 0]
    assert values(spark, [3], integer, lambda c: labels.resolve_label(None, None)) == [None]
    assert values(spark, [[1]], T.ArrayType(integer), resolve(T.ArrayType(integer))) == [None]


def test_language_rules(spark):
    lit = F.lit
    case = lambda *a: one(spark, labels.resolve_language(*a))
    assert case(lit("Spanish"), "en", lit("fr")) == "Spanish"
    assert case(lit(""), "en", lit("fr")) == "en"
    assert case(None, "mixed", lit("fr")) == "fr"
    assert case(None, "multi", lit("")) == "en"
    assert case(None, "mixed", None) == "en"
    assert case(None, None, lit("de")) == "de"


def test_blocking_labels(spark):
    names = [*labels.BLOCKING_LABELS, *labels.SAFE_LABELS, " NSFW ", "01", "+1", "1.0", "2", "-1", "1_", "other"]
    want = [True] * 12 + [False] * 8 + [True, True, True, False, False, False, False, False]
    assert values(spark, names, T.StringType(), labels.is_blocking_label) == want


def test_blocking_confidence(spark):
    def case(probabilities, classes, prediction, blocked):
        p = F.lit(None).cast("array<double>") if probabilities is None else F.array(*map(F.lit, probabilities))
        return one(spark, labels.blocking_confidence(p, F.array(*map(F.lit, classes)), F.lit(prediction), F.lit(blocked)))

    assert case(None, ["a"], "a", True) == 1.0 and case(None, ["a"], "a", False) == 0.0
    assert case([0.2, 0.8], ["toxic", "safe"], "safe", False) == 0.2
    assert case([0.3, 0.7], ["a", "b"], "a", False) == 0.7
    assert case([0.1, 0.2, 0.7], ["a", "b", "c"], "b", False) == 0.2
    assert case([0.1, 0.9], ["x", "y", "z"], "w", True) == 0.9
    assert case([0.1, 0.2, 0.7], ["x", "y", "z"], "w", True) == 0.7
    assert case([0.1, 0.2, 0.7], ["x", "y", "z"], "w", False) == 0.0


def test_blocking_label_index():
    index = labels.blocking_label_index
    assert index({0: "SAFE", 1: "INJECTION"}) == 1
    assert index({0: "SAFE", 1: "INJECTION"}, label_id=0) == 0
    assert index({0: "Injection", 1: "SAFE"}, label_name="INJECTION") == 0
    assert index({0: "ok", 1: "jailbreak-attempt", 2: "unsafe"}) == 1
    with pytest.raises(ValueError):
        index({0: "a", 1: "b"}, label_name="zzz")
    with pytest.raises(ValueError):
        index({0: "a", 1: "b", 2: "c"})


def test_softmax_and_bands(spark):
    logits = [1.0, 3.0, -2.0, 800.0]
    top = max(logits)
    total = sum(math.exp(x - top) for x in logits)
    got = one(spark, scores.softmax(F.array(*map(F.lit, logits))))
    assert got == pytest.approx([math.exp(x - top) / total for x in logits])
    assert one(spark, scores.softmax_at(F.array(*map(F.lit, logits)), 3)) == pytest.approx(1.0)
    assert [one(spark, scores.severity_band(F.lit(x))) for x in (0.3, 0.31, 0.7, 0.71)] == ["safe", "warning", "warning", "danger"]
    assert one(spark, scores.exceeds(F.lit(0.5), 0.5)) is False
    assert one(spark, scores.clamp01(F.lit(1.5))) == 1.0 and one(spark, scores.clamp01(F.lit(-0.5))) == 0.0
    assert one(spark, scores.safe_div(F.lit(1), F.lit(0))) == 0.0


def test_maps_merge_with_the_later_value(spark):
    a, b = F.create_map(F.lit("x"), F.lit(1.0), F.lit("y"), F.lit(2.0)), F.create_map(F.lit("y"), F.lit(3.0))
    assert one(spark, scores.merge_maps(a, b)) == {"x": 1.0, "y": 3.0}
    assert one(spark, scores.prefix_keys(b, "output")) == {"output:y": 3.0}


def test_chat_messages(spark):
    schema = chat.MESSAGES
    rows = [
        ([("system", "s"), ("user", "u")],), ([("system", "s")],), ([],),
        ([("user", "first"), ("assistant", "a"), ("user", "")],), ([("user", "one"), ("user", "two"), ("assistant", "z")],),
    ]
    df = spark.createDataFrame(rows, f"messages {schema}")
    assert [r[0] for r in df.select(chat.last_user_prompt(F.col("messages"))).collect()] == ["u", "", "", "", "two"]
    made = lambda system: one(spark, chat.build_messages(system, F.lit("p")))
    assert [m["role"] for m in made(F.lit("s"))] == ["system", "user"]
    assert [m["role"] for m in made(F.lit(""))] == ["user"]
    assert [m["role"] for m in made(F.lit(None).cast("string"))] == ["user"]


def test_chat_response_parts(spark):
    bodies = ['{"choices": []}', "{}", '{"choices": [{"index": 0, "message": {"content": "hi"}}, {"message": {"content": "two"}}]}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string").select(F.from_json("body", chat.RESPONSE).alias("r"))
    assert [r[0] for r in df.select(chat.assistant_content(F.col("r"))).collect()] == ["", "", "hi"]
    changed = df.select(chat.replace_assistant_content(F.col("r"), F.lit("X")).alias("r")).collect()
    assert [c["message"]["content"] for c in changed[2]["r"]["choices"]] == ["X", "two"]
    assert changed[0]["r"]["choices"] == []
