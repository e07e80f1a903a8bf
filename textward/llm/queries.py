"""The numbered operators as queries over whole tables, and their DuckDB twins.

Each query only prepares columns, calls its operator and derives the columns of its result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import audit, bpe, hmm, infill, langid, lines, mixing, neighbours, rules, shards, simhash, toolcalls, winnow
from textward.llm.common import only, word_count
from textward.session import staged

SYMBOLS = r"[#*$%&|<>]"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return only(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *columns)


# ---- 1, SimHash ---------------------------------------------------------------------------------


def op1_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    grouped = simhash.groups(simhash.fingerprints(docs, shingle=3), radius=2)
    return grouped.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


# ---- 2, mixing ----------------------------------------------------------------------------------


def sized(docs: DataFrame) -> DataFrame:
    """Documents with what mixing reads: size in words, a hash of the text, and a quality weight that
    falls with the symbols per word."""
    symbols = F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0))
    return docs.withColumns({
        "size": word_count(F.col("text")), "_symbols": symbols, "text_hash": F.xxhash64("text"),
    }).withColumn("quality", (F.col("size") + 1) / (F.col("size") + 1 + F.col("_symbols") * 5)).drop("_symbols")


def weighted_targets(docs: DataFrame) -> DataFrame:
    """Targets of sources that weigh 1, 2, 3, 1, ... in the order of their names."""
    sizes = staged(mixing.source_sizes(docs), "sizes")
    return mixing.source_targets(sizes, F.col("place") % 3 + 1)


def op2_mixing(spark, sf_dir):
    docs = staged(sized(table(spark, sf_dir, "documents", "doc_id", "source", "text")).drop("text"), "sized")
    mixed = mixing.mix(docs, weighted_targets(docs), F.col("quality"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken")
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols
  FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(doc_id::VARCHAR || '#7'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
           / ((size + 1)::DOUBLE / (size + 1 + symbols * 5)::DOUBLE) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::DOUBLE AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, n * 3 / w AS ratio,
         (sum(n) OVER () - coalesce(sum(n * 3) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM s WINDOW p AS (ORDER BY n * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, n, CASE WHEN ratio <= v THEN n * 3 ELSE v * w END AS target
  FROM (SELECT *, max(level) FILTER (WHERE level <= ratio) OVER () AS v FROM r)
), e AS (
  SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs FROM t
), o AS (
  SELECT k.*, e.n, e.target, e.epochs,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, n::BIGINT AS source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND ahead + size / 2 <= target - epochs * n THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""


# ---- 3, LM scoring ------------------------------------------------------------------------------


def op3_hmm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return hmm.score(docs, fold == 2)


# ---- 4, nearest neighbours ----------------------------------------------------------------------


def op4_neighbours(spark, sf_dir):
    vectors = staged(neighbours.usable(table(spark, sf_dir, "embeddings", "vec_id", "embedding")), "vectors")
    return neighbours.nearest(vectors, F.col("id") % 20 == 0, k=20)


OP4_SQL = """
WITH v AS (
  SELECT vec_id AS id, min(embedding::DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
    AND len([e FOR e IN embedding IF e <> 0]) > 0
  GROUP BY vec_id
), p AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.x) = len(c.x) WHERE q.id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


# ---- 5, quality rules ---------------------------------------------------------------------------


def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    judged, _ = rules.judge(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


# ---- 6, line dedup ------------------------------------------------------------------------------


def op6_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return lines.deduplicate(docs).select("doc_id", "text", "n_lines", "n_dropped_lines")


# ---- 7, tool calls ------------------------------------------------------------------------------

# The tools that a user's turn is read as a call of.
SCHEMAS: toolcalls.Schemas = {
    "open": {"text": toolcalls.Argument("string", least=1, most=600), "words": toolcalls.Argument("integer", least=1)},
    "ask": {
        "text": toolcalls.Argument("string", least=1, most=600),
        "words": toolcalls.Argument("integer", least=1, most=80),
        "turn": toolcalls.Argument("integer", required=False, most=6),
    },
}


def op7_tool_calls(spark, sf_dir):
    """User turns as calls of a tool that the assistant's next turn answers; a call follows the one two
    turns before it."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    name = F.when(F.col("turn") < 2, "open").otherwise("ask")
    arguments = F.to_json(F.struct(
        F.when(F.col("turn") >= 2, F.col("turn")).alias("turn"), F.col("text"), word_count(F.col("text")).alias("words")
    ))
    call = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    calls = turns.where("role = 'user'").select(
        "conv_id", call(F.col("turn")).alias("call_id"), call(F.col("turn") - 2).alias("after"), name.alias("name"),
        arguments.alias("arguments"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", call(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    return toolcalls.link(calls, results, SCHEMAS)


OP7_SQL = r"""
WITH u AS (
  SELECT conv_id, 'call_' || turn AS call_id, turn, text, len(regexp_extract_all(text, '[^ 	-
]+')) AS words, count(*) AS n_calls
  FROM conversations WHERE role = 'user' GROUP BY conv_id, turn, text
), i AS (
  SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM u
), c AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS depth FROM i
), e AS (
  SELECT *, array_to_string(list_filter([
      CASE WHEN len(text) < 1 THEN 'text is below 1' WHEN len(text) > 600 THEN 'text is above 600' END,
      CASE WHEN turn > 6 THEN 'turn is above 6' END,
      CASE WHEN words < 1 THEN 'words is below 1' WHEN words > 80 AND turn >= 2 THEN 'words is above 80' END
    ], lambda x: x IS NOT NULL), '; ') AS errors,
    CASE WHEN turn < 2 THEN json_object('text', text, 'words', words) ELSE json_object('text', text, 'turn', turn, 'words', words) END AS arguments
  FROM c
), r AS (
  SELECT conv_id, 'call_' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' GROUP BY ALL
)
SELECT coalesce(e.conv_id, r.conv_id) AS conv_id, coalesce(e.call_id, r.call_id) AS call_id, e.depth,
       CASE WHEN e.conv_id IS NULL THEN 'no_call' WHEN errors <> '' THEN 'invalid' WHEN r.conv_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
       e.errors, coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_results, 0)::BIGINT AS n_results,
       json_object('arguments', arguments, 'call_id', coalesce(e.call_id, r.call_id), 'conv_id', coalesce(e.conv_id, r.conv_id),
                   'depth', depth, 'name', CASE WHEN e.conv_id IS NULL THEN NULL WHEN turn < 2 THEN 'open' ELSE 'ask' END, 'result', content)::VARCHAR AS message
FROM e FULL JOIN r ON e.conv_id = r.conv_id AND e.call_id = r.call_id
"""


# ---- 8, sharding --------------------------------------------------------------------------------

SHARDS = [f"shard-{i:03d}" for i in range(256)]


def op8_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source")
    return shards.place(docs, SHARDS).select("doc_id", "slot", "shard")


# ---- 9, language of pages -----------------------------------------------------------------------


def op9_language_id(spark, sf_dir):
    return langid.identify(
        table(spark, sf_dir, "pages", "page_id", "url", "html"), table(spark, sf_dir, "documents", "text", "lang")
    )


# ---- 10, byte-level BPE -------------------------------------------------------------------------


def op10_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    done = bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


# ---- 11, filter interactions --------------------------------------------------------------------


def op11_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return audit.interactions(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w
  FROM documents
), f AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name
), o AS (
  SELECT a.name || b.name || c.name || e.name || g.name AS filter_order FROM x a, x b, x c, x e, x g
  WHERE len(list_distinct([a.name, b.name, c.name, e.name, g.name])) = 5
), s AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
         list_sum([0] || [1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, step)])::BIGINT AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)
), r AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER (mask & (before | bit) = 0) AS kept,
         sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
         sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant,
         sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER (mask & bit > 0 AND mask & before = 0) AS good_lost,
         sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""


# ---- 12, benchmark decontamination --------------------------------------------------------------


def op12_decontamination(spark, sf_dir):
    found = winnow.find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP12_SQL = r"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, w, least(len(w), 10) AS size
  FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), v AS (
  SELECT DISTINCT item, size, array_to_string(w[pos:pos + size - 1], ' ') AS part
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS pos FROM i)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS part
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, (SELECT DISTINCT size FROM v))
), m AS (
  SELECT p.doc_id, p.size, pos, item FROM p JOIN v ON p.part = v.part AND p.size = v.size
), h AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


# ---- 13, fill-in-middle -------------------------------------------------------------------------


def op13_infill(spark, sf_dir):
    done = infill.restore(infill.transform(table(spark, sf_dir, "documents", "doc_id", "text")))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), k AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT *, substr(text, 1, least(a, b)) AS prefix, substr(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle,
         substr(text, greatest(a, b) + 1) AS suffix
  FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_hmm": op3_hmm,
    "op4_neighbours": op4_neighbours,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_tool_calls": op7_tool_calls,
    "op8_sharding": op8_sharding,
    "op9_language_id": op9_language_id,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_filter_audit": op11_filter_audit,
    "op12_decontamination": op12_decontamination,
    "op13_infill": op13_infill,
}

ORACLE = {
    "op2_mixing": OP2_SQL,
    "op4_neighbours": OP4_SQL,
    "op7_tool_calls": OP7_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_decontamination": OP12_SQL,
    "op13_infill": OP13_SQL,
}
