import json

from textward.llm import shards, toolcalls
from textward.llm.queries import QUERIES, SHARDS
from textward.llm.toolcalls import Argument

from .conftest import SF

SCHEMAS = {
    "add": {"a": Argument("number"), "b": Argument("number", most=10), "note": Argument("string", required=False, least=2)},
    "pick": {"which": Argument("string", choices=("x", "y")), "flags": Argument("array", required=False), "of": Argument("object", required=False)},
}
CALLS = "conv_id long, call_id string, after string, name string, arguments string, depth int"


def test_linked_ordered_and_validated(spark):
    calls = [
        (1, "c", "b", "add", '{"b": 2, "a": 1.5}', 0), (1, "a", None, "add", '{"a": 1, "b": 11, "note": "n", "z": null}', 0),
        (1, "b", "a", "pick", '{"which": "y", "of": {"k": 1, "j": [1, {"d": 1, "c": 2}]}}', 0), (1, "d", "nowhere", "pick", '{"which": "q", "flags": {}}', 0),
        (2, "a", "b", "add", "not json", 0), (2, "b", "a", "none", "{}", 0), (2, "e", "a", "add", "[1]", 0),
        (3, "a", None, "add", '{"a": "1", "b": null}', 0), (3, "a", None, "add", '{"a": "1", "b": null}', 0), (None, None, None, None, None, None),
    ]
    results = [(1, "a", "r1"), (1, "c", "é\n"), (1, "b", None), (9, "z", "lost"), (3, "a", "one"), (3, "a", "two"), (None, None, "null")]
    rows = toolcalls.link(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id long, call_id string, content string"), SCHEMAS
    ).collect()
    got = {(r.conv_id, r.call_id): r for r in rows}
    assert len(rows) == len(got) == 10
    view = {k: (r.depth, r.status, r.errors) for k, r in got.items()}
    assert view == {
        (1, "a"): (0, "invalid", "b is above 10; note is below 2; z is unknown"),
        (1, "b"): (1, "linked", ""), (1, "c"): (2, "linked", ""),
        (1, "d"): (0, "invalid", "flags is not of kind array; which is not a choice"),
        (2, "a"): (None, "cycle", "arguments are not a JSON object"), (2, "b"): (None, "cycle", "tool is unknown"),
        (2, "e"): (None, "cycle", "arguments are not a JSON object"),
        (3, "a"): (0, "invalid", "a is not of kind number; b is missing"),
        (9, "z"): (None, "no_call", None), (None, None): (0, "invalid", "arguments are not a JSON object"),
    }
    assert (got[3, "a"].n_calls, got[3, "a"].n_results, got[1, "d"].n_results) == (2, 2, 0)
    for r in rows:
        assert r.message == json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[1, "b"].message)["arguments"] == {"which": "y", "of": {"k": 1, "j": [1, {"d": 1, "c": 2}]}}
    assert json.loads(got[2, "a"].message)["arguments"] == "not json"


def test_long_chains_and_loops(spark):
    nodes = [(str(i), str(i - 1) if i else None) for i in range(700)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s")]
    got = dict(toolcalls.depths(spark.createDataFrame(nodes, "node string, parent string")).collect())
    assert got == {str(i): i for i in range(700)} | dict.fromkeys("xyzws")


def test_no_calls(spark):
    calls = spark.createDataFrame([], CALLS)
    results = spark.createDataFrame([], "conv_id long, call_id string, content string")
    assert toolcalls.link(calls, results, SCHEMAS).count() == 0


# ---- sharding -----------------------------------------------------------------------------------


def test_turns_share_the_table():
    owner = shards.fill(SHARDS)
    counts = [owner.count(s) for s in SHARDS[:3]]
    assert len(owner) == shards.TABLE_SIZE and max(counts) - min(counts) <= 1
    assert {owner.count(s) for s in SHARDS} <= {65_537 // 256, 65_537 // 256 + 1}


def test_claims_are_the_first_free_preferences():
    """Each slot's owner would lose it to nobody: who prefers the slot to its own got that one earlier."""
    owner = shards.fill(["a", "b", "c"], 13)
    assert sorted(owner) == ["a"] * 5 + ["b"] * 4 + ["c"] * 4
    assert owner == shards.fill(["c", "a", "b"], 13)


def test_few_documents_move_when_a_shard_goes():
    before, after = shards.fill(SHARDS[:10], 10_007), shards.fill(SHARDS[:9], 10_007)
    moved = sum(a != b and a != SHARDS[9] for a, b in zip(before, after))
    assert moved < 0.1 * 10_007


def test_bad_tables():
    for names, size in ((["a", "a"], 13), ([], 13), (["a"], 12), (["a", "b", "c"], 2)):
        try:
            shards.fill(names, size)
        except ValueError:
            continue
        raise AssertionError((names, size))


def test_placement(spark, odd, none):
    rows = QUERIES["op8_sharding"](spark, SF).collect()
    import hashlib

    owner = shards.fill(SHARDS)
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % shards.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, owner[slot])
    placed = shards.place(odd.withColumnRenamed("size", "slot").withColumnRenamed("fp", "shard"), SHARDS, size=1009).collect()
    assert len(placed) == 11 and len({r.shard for r in placed if r.doc_id is None}) == 1
    assert shards.place(none, SHARDS, size=1009).count() == 0
