from verification.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_unanswered_prompts_come_out(spark, tmp_path):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path))
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    answers = {(r.conv_id, r.turn): r.text for r in rows if r.role == "assistant"}
    want = [(r.conv_id, r.turn, r.text, answers.get((r.conv_id, r.turn + 1))) for r in rows if r.role == "user"]
    got = [tuple(r) for r in QUERIES["stream_pairs"](spark, SF).collect()]
    assert any(r[3] is None for r in want) and sorted(got, key=str) == sorted(want, key=str)
