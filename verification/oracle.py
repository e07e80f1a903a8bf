"""The DuckDB twin of each query, written from the semantics rather than from the Spark plans."""

from __future__ import annotations

from textward.functions.labels import BLOCKING_LABELS, SAFE_LABELS
from textward.functions.language import SPANISH_HINT_WORDS, SPANISH_MARKERS
from textward.functions.pii_patterns import PII_PATTERNS
from textward.functions.text import ATTACK_TAGS
from verification.queries import GUARDS, INSULTS

# Whitespace as Python has it, spelled out for RE2.
SPACE = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LATIN = "a-zA-ZÀ-ɏ"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quoted(values) -> str:
    return ", ".join(q(v) for v in values)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'), ' ')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{SPACE}]+'))"


def near_key(x: str) -> str:
    return f"sha256({strip(f'lower({x})')})"


# ---- personal data ------------------------------------------------------------------------------


def masked(table: str, key: str, text: str) -> str:
    """CTEs s0..s51 masking one pattern after the other; the last is named ``masked``."""
    steps = [f"s0 AS (SELECT {key}, {text} AS t, CAST([] AS VARCHAR[]) AS ents FROM {table})"]
    for i, (name, pattern) in enumerate(PII_PATTERNS.items(), 1):
        p = q("(?i)" + pattern)
        hits = f"regexp_extract_all(t, {p})"
        parts = f"string_split_regex(t, {p})"
        glued = (
            f"array_to_string(list_transform(list_zip({parts}, "
            f"list_append(list_transform({hits}, lambda m: repeat('*', length(m))), '')), lambda z: z[1] || z[2]), '')"
        )
        steps.append(
            f"s{i} AS (SELECT {key}, CASE WHEN regexp_matches(t, {p}) THEN {glued} ELSE t END AS t, "
            f"CASE WHEN regexp_matches(t, {p}) THEN list_append(ents, {q(name)}) ELSE ents END AS ents FROM s{i - 1})"
        )
    steps.append(f"masked AS (SELECT * FROM s{len(PII_PATTERNS)})")
    return ",\n".join(steps)


def scanned(x: str) -> str:
    tests = ", ".join(
        f"CASE WHEN regexp_matches({x}, {q('(?i)' + p)}) THEN {q(n)} END" for n, p in PII_PATTERNS.items()
    )
    return f"list_filter([{tests}], lambda e: e IS NOT NULL)"


SQL: dict[str, str] = {}

SQL["pii_mask"] = f"""
WITH {masked('documents', 'doc_id', 'text')}
SELECT doc_id, t AS masked, array_to_string(ents, ',') AS entities, CAST(len(ents) AS BIGINT) AS n_entities,
       len(ents) > 0 AS is_masked
FROM masked"""

SQL["pii_scan"] = f"""
WITH s AS (SELECT doc_id, {scanned('text')} AS e FROM documents)
SELECT doc_id, array_to_string(e, ',') AS entities, len(e) = 0 AS passed,
       CASE WHEN len(e) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
       CASE WHEN len(e) = 0 THEN 'No PII detected' ELSE 'PII detected: ' || array_to_string(e, ', ') END AS detail
FROM s"""

SQL["pii_entity_freq"] = f"""
WITH s AS (SELECT unnest({scanned('text')}) AS entity FROM documents)
SELECT entity, count(*) AS n_docs FROM s GROUP BY entity"""

SQL["pii_mask_freq"] = f"""
WITH {masked('documents', 'doc_id', 'text')}
SELECT entity, count(*) AS n_docs FROM (SELECT unnest(ents) AS entity FROM masked) GROUP BY entity"""

# ---- text scalars -------------------------------------------------------------------------------

SQL["normalize_ws"] = f"""
SELECT doc_id, {collapse('text')} AS normalized, {strip("replace(text, chr(10), ' ')")} AS one_line, text AS same
FROM documents"""

SQL["clip_text"] = f"""
WITH c AS (SELECT doc_id, {strip('text')} AS text FROM documents)
SELECT doc_id, text, length(text)::BIGINT AS length FROM c"""


def _tag_steps() -> tuple[str, str]:
    steps = [
        rf"a0 AS (SELECT doc_id, regexp_replace({strip('text')}, '[^\x00-\x7F]+', ' ', 'g') AS t, "
        "CAST([] AS VARCHAR[]) AS tags FROM documents)"
    ]
    for i, (tag, vocabulary) in enumerate(ATTACK_TAGS.items(), 1):
        p = q(rf"(?i)\b({'|'.join(vocabulary)})\b")
        steps.append(
            f"a{i} AS (SELECT doc_id, regexp_replace(t, {p}, ' {tag} ', 'g') AS t, "
            f"CASE WHEN regexp_matches(t, {p}) THEN list_append(tags, '{tag}') ELSE tags END AS tags FROM a{i - 1})"
        )
    return ",\n".join(steps), f"a{len(ATTACK_TAGS)}"


_steps, _last = _tag_steps()
SQL["injection_tags"] = f"""
WITH {_steps}
SELECT doc_id, lower({collapse('t')}) AS tagged, array_to_string(tags, ',') AS tags FROM {_last}"""

SQL["near_keys"] = f"SELECT doc_id, {near_key('text')} AS near_key FROM documents"

_letters = f"length(regexp_replace(text, '[^{LATIN}]', '', 'g'))"
SQL["word_stats"] = f"""
SELECT doc_id, {_letters}::BIGINT AS n_letters, {words('text')}::BIGINT AS n_words,
       len(list_distinct(regexp_extract_all(lower(text), '[{LATIN}]+')))::BIGINT AS n_distinct,
       {_letters} >= 2 AS two_letters, {words('text')} > 5 AS long_text
FROM documents"""

# ---- language -----------------------------------------------------------------------------------

_EN_TARGET = ", ".join(s.name for s in GUARDS.inputs["en"])
_ES_TARGET = ", ".join(s.name for s in GUARDS.inputs["es"])


def routed(table: str, columns: str, text: str, history: str = "NULL") -> str:
    """CTE ``routed`` with lang, confidence, method and target of a text."""
    hints = f"list_has_any(regexp_extract_all(lower({text}), '[{LATIN}]+'), [{quoted(SPANISH_HINT_WORDS)}])"
    return f"""
detected AS (
  SELECT {columns}, length(regexp_replace({text}, '[^{LATIN}]', '', 'g')) < 2 AS bare,
    CASE WHEN regexp_matches(lower({text}), '[{SPANISH_MARKERS}]') THEN 'es' WHEN {hints} THEN 'es' ELSE 'en' END AS found,
    CASE WHEN regexp_matches(lower({text}), '[{SPANISH_MARKERS}]') THEN 0.95::DOUBLE ELSE 0.75::DOUBLE END AS conf,
    CASE WHEN {words(text)} > 5 THEN 'fasttext' ELSE 'lingua' END AS detector,
    coalesce(nullif({history}, ''), 'en') AS fallback
  FROM {table}),
routed AS (
  SELECT *, CASE WHEN bare THEN fallback ELSE found END AS r_lang, CASE WHEN bare THEN 0.0::DOUBLE ELSE conf END AS r_conf,
    CASE WHEN bare THEN 'fallback_no_alpha' ELSE detector END AS r_method,
    CASE WHEN (CASE WHEN bare THEN fallback ELSE found END) = 'es' THEN {q(_ES_TARGET)} ELSE {q(_EN_TARGET)} END AS r_target
  FROM detected)"""


_ROUTE_LINE = "printf('Input language router: %s (%.4f, %s) -> %s', r_lang, r_conf, r_method, r_target)"

SQL["language_route"] = f"""
WITH {routed('documents', 'doc_id', 'text')}
SELECT doc_id, r_lang AS lang, r_conf AS confidence, r_method AS method, r_target AS target, {_ROUTE_LINE} AS detail
FROM routed"""

SQL["route_vs_label_lang"] = f"""
WITH {routed('documents', 'lang', 'text')}
SELECT lang, r_lang AS routed, count(*) AS n FROM routed GROUP BY lang, r_lang"""

SQL["language_buckets"] = """
SELECT doc_id, CASE WHEN lang IN ('en', 'es') THEN lang ELSE 'en' END AS en_es,
       CASE WHEN lang IN ('de', 'fr') THEN lang ELSE 'de' END AS de_fr,
       CASE WHEN lang = 'es' THEN 'spanish filter' ELSE 'english filter' END AS target
FROM documents"""

SQL["history_language"] = f"""
WITH {routed("(SELECT * FROM conversations WHERE role = 'user')", 'conv_id, turn, text', 'text')},
h AS (SELECT *, last_value(CASE WHEN NOT bare THEN r_lang END IGNORE NULLS) OVER
        (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM routed)
SELECT conv_id, turn, coalesce(past, 'none') AS history_lang,
       CASE WHEN bare THEN coalesce(past, 'en') ELSE found END AS lang, r_method AS method
FROM h"""

# ---- classifiers --------------------------------------------------------------------------------


def hit(text: str, keywords) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {q(k)})" for k in keywords) + ")"


def failed(specs, text: str) -> str:
    """List of the names of the guards that a text sets off."""
    tests = ", ".join(f"CASE WHEN {hit(text, s.options['keywords'])} THEN {q(s.name)} END" for s in specs)
    return f"list_filter([{tests}], lambda e: e IS NOT NULL)"


def details(specs, text: str) -> str:
    return " || ';' || ".join(
        f"CASE WHEN {hit(text, s.options['keywords'])} THEN '[BLOCKED] {s.name} | Confidence: 92.0%' "
        f"ELSE '[PASSED] {s.name} | Confidence: 94.0%' END"
        for s in specs
    )


_ALL_INPUT = GUARDS.flat()
SQL["keyword_ensemble"] = f"""
WITH f AS (SELECT conv_id, turn, {failed(_ALL_INPUT, 'text')} AS by_, {details(_ALL_INPUT, 'text')} AS details
           FROM conversations WHERE role = 'user')
SELECT conv_id, turn, len(by_) = 0 AS passed, CASE WHEN len(by_) > 0 THEN 0.92::DOUBLE ELSE 0.06::DOUBLE END AS max_score,
       array_to_string(by_, ',') AS blocked_by, details
FROM f"""

SQL["aggregate_score"] = f"""
WITH f AS (SELECT doc_id, {failed(GUARDS.outputs, 'text')} AS by_ FROM documents)
SELECT doc_id, len(by_) > 0 AS is_malicious, CASE WHEN len(by_) > 0 THEN 0.92::DOUBLE ELSE 0.06::DOUBLE END AS confidence,
       array_to_string(by_, ',') AS blocked_by,
       CASE WHEN len(by_) > 0 THEN 'Blocked by: ' || array_to_string(by_, ', ') ELSE 'All input classifiers passed' END AS detail
FROM f"""

_GRADED = "(" + " + ".join(f"contains(lower(text), {q(k)})::INT" for k in INSULTS) + f")::DOUBLE / {len(INSULTS)}"
_COARSE = hit("text", ("idiot", "moron", "worthless", "drop dead"))

SQL["score_summary"] = f"""
SELECT doc_id, 'isolated_nsfw_guardrail' AS filter_name,
       CASE WHEN {hit('text', GUARDS.outputs[0].options['keywords'])} THEN 0.92::DOUBLE ELSE 0.06::DOUBLE END AS score FROM documents
UNION ALL SELECT doc_id, 'insult_share', round({_GRADED}, 6) FROM documents
UNION ALL SELECT doc_id, 'toxicity_guard', CASE WHEN contains(lower(text), 'stupid') THEN 0.92::DOUBLE ELSE 0.06::DOUBLE END FROM documents"""

SQL["blocking_labels"] = f"""
WITH s AS (SELECT doc_id, toxic, lower(trim(['Toxic', 'SAFE', '1', '0', '01', '1.0', 'other', '+1', 'unsafe '][doc_id % 9 + 1])) AS name FROM labels)
SELECT doc_id, CASE WHEN name IN ({quoted(BLOCKING_LABELS)}) THEN true WHEN name IN ({quoted(SAFE_LABELS)}) THEN false
                    WHEN regexp_full_match(name, '[+-]?[0-9]+') THEN name::INT = 1 ELSE false END AS by_name,
       toxic = 1 AS by_number
FROM s"""


def softmax(n: int) -> str:
    e = f"list_transform(embedding[1:{n}], lambda x: exp(x::DOUBLE - list_max(embedding[1:{n}])::DOUBLE))"
    return f"list_transform({e}, lambda x: x / list_sum({e}))"


SQL["blocking_confidence"] = f"""
WITH p AS (SELECT vec_id, {softmax(3)} AS p3, {softmax(2)} AS p2 FROM embeddings),
t AS (SELECT *, ['benign', 'toxic', 'other'][list_position(p3, list_max(p3))] AS predicted FROM p)
SELECT vec_id, predicted <> 'toxic' AS passed, round(p3[2], 6) AS three, round(p2[2], 6) AS unnamed,
       CASE WHEN predicted = 'toxic' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bare
FROM t"""

SQL["softmax_block"] = f"""
WITH p AS (SELECT vec_id, ({softmax(64)})[2] AS s FROM embeddings)
SELECT vec_id, round(s, 6) AS score, s > 0.016::DOUBLE AS blocked FROM p"""

SQL["clamp_threshold"] = """
WITH s AS (SELECT vec_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, embedding[1]::DOUBLE * 4)) AS s FROM embeddings)
SELECT vec_id, round(s, 6) AS score, s > 0.5::DOUBLE AS blocked FROM s"""

SQL["toxicity_details"] = """
WITH p AS (SELECT doc_id, toxic, (doc_id % 1000)::DOUBLE / 1000.0::DOUBLE AS p FROM labels)
SELECT doc_id, toxic <> 1 AS passed, round(p, 6) AS confidence,
       CASE WHEN toxic = 1 THEN printf('🚩 [ALERT] TOXIC CONTENT | Confidence: %.1f%%', p * 100)
            ELSE printf('✅ [CLEAN] SAFE | Confidence: %.1f%%', (1.0::DOUBLE - p) * 100) END AS detail
FROM p"""

SQL["truncated_inputs"] = f"SELECT doc_id, {words('text')} >= 512 AS truncated FROM documents"

SQL["subword_truncation"] = r"""
WITH RECURSIVE pieces AS (SELECT unnest(json_keys(content::JSON, '$.model.vocab')) AS piece FROM read_text('/opt/tokenizers/word_bpe_49k.json')),
vocab AS (SELECT DISTINCT CASE WHEN ends_with(piece, '</w>') THEN piece[:-5] ELSE piece END AS part, ends_with(piece, '</w>') AS final FROM pieces),
found AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^ \t-\r]+')) AS word FROM documents),
words AS (SELECT DISTINCT word FROM found),
sizes AS (SELECT max(length(part)) AS most FROM vocab),
parts AS (SELECT word, place, size, substr(word, place, size) AS part, place + size - 1 = length(word) AS last
  FROM (SELECT word, place, unnest(range(1, least(most, length(word) - place + 1) + 1)) AS size
        FROM (SELECT word, unnest(range(1, length(word) + 1)) AS place FROM words), sizes)),
best AS (SELECT p.word, p.place, max(p.size) AS size FROM parts p JOIN vocab v ON p.part = v.part AND (NOT v.final OR p.last) GROUP BY ALL),
walk AS (
  SELECT word, 1::BIGINT AS place, 0::BIGINT AS n FROM words
  UNION ALL
  SELECT w.word, w.place + coalesce(b.size, 1), w.n + 1 FROM walk w LEFT JOIN best b ON b.word = w.word AND b.place = w.place
  WHERE w.place <= length(w.word)),
counts AS (SELECT word, max(n) AS n FROM walk GROUP BY word),
totals AS (SELECT doc_id, sum(n)::BIGINT AS pieces FROM found JOIN counts USING (word) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(pieces, 0) END AS pieces, coalesce(pieces, 0) >= 512 AS truncated
FROM documents LEFT JOIN totals USING (doc_id)"""

_EXTERNAL = "least(1.0::DOUBLE, (length(text) % 100)::DOUBLE / 80.0::DOUBLE)"
SQL["external_classifier"] = f"""
SELECT doc_id, NOT starts_with(text, 'T') AND {_EXTERNAL} <= 0.6::DOUBLE AS passed,
       CASE WHEN starts_with(text, 'T') THEN -1.0::DOUBLE ELSE round({_EXTERNAL}, 6) END AS score,
       starts_with(text, 'T') AS failed
FROM documents"""
SQL["external_predictions"] = f"""
SELECT doc_id, toxic AS label, ({_EXTERNAL} > 0.6::DOUBLE)::INT AS pred, round({_EXTERNAL}, 6) AS score
FROM documents JOIN labels USING (doc_id) WHERE NOT starts_with(text, 'T')"""

# ---- labels and sources -------------------------------------------------------------------------

_blank = f"NOT regexp_matches(text, '[^{SPACE}]')"
_CONVENTIONS = {
    "int_label": ("toxic", "'en'"),
    "bool_label": ("CASE WHEN toxic = 1 THEN 1 ELSE 0 END", "lang"),
    "mapped_label": ("CASE WHEN quality = 0 THEN NULL WHEN toxic = 1 THEN 1 ELSE 0 END", "lang"),
    "spelled_label": ("CASE WHEN toxic = 1 THEN 1 WHEN doc_id % 5 = 0 THEN NULL ELSE 0 END", "lang"),
    "fixed_label": ("1", "'en'"),
    "no_label": ("NULL", "lang"),
}
_rows = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS source, CAST({label} AS BIGINT) AS label, {lang} AS lang, {_blank} AS blank "
    "FROM documents JOIN labels USING (doc_id)"
    for n, (label, lang) in _CONVENTIONS.items()
)
SQL["resolve_labels"] = f"""
SELECT doc_id, source, coalesce(label, -1) AS label, label IS NOT NULL AND NOT blank AS kept FROM ({_rows})"""
SQL["resolve_lang"] = f"SELECT doc_id, source, lang FROM ({_rows})"
SQL["source_stats"] = f"""
WITH r AS (SELECT source, label, label IS NOT NULL AND NOT blank AS kept FROM ({_rows})
  UNION ALL SELECT 'tree', 0, NOT ({_blank}) FROM conversations WHERE role = 'user' AND turn = 0)
SELECT source, count(*) AS raw_rows_after_filter, count(*) FILTER (kept) AS kept_rows, count(*) FILTER (NOT kept) AS skipped_rows,
       count(*) FILTER (kept AND label = 0) AS n_label_0, count(*) FILTER (kept AND label = 1) AS n_label_1
FROM r GROUP BY source"""

SQL["filtered_source"] = f"""
WITH r AS (SELECT conv_id, {strip('text')} AS text FROM conversations
           WHERE role = 'user' AND turn = 0 AND NOT {_blank})
SELECT conv_id, text, 0::BIGINT AS label, 'tree' AS source, 'en' AS lang, length(text)::BIGINT AS length FROM r"""

SQL["split_labels"] = """
SELECT 'by_split' AS source, CASE WHEN source < 'src13' THEN 1 ELSE 0 END::BIGINT AS label, count(*) AS n
FROM documents GROUP BY 2"""

# ---- screening ----------------------------------------------------------------------------------

REFUSAL = "Sorry, I cannot answer this prompt"

SQL["last_user_prompt"] = """
WITH p AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS prompt FROM conversations GROUP BY conv_id)
SELECT conv_id, prompt, CASE WHEN prompt = '' THEN 400 ELSE 200 END::BIGINT AS status FROM p"""


def screened(requests: str, keys: str, output: bool = True) -> str:
    """CTE ``decided`` over a table expression with the keys, prompt and response."""
    by_output = failed(GUARDS.outputs, "t") if output else "CAST([] AS VARCHAR[])"
    on = " AND ".join(f"r.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    headline = (
        "All classifiers passed" if output
        else "Output classifiers disabled; upstream response returned without output validation"
    )
    return f"""
requests AS ({requests}),
{routed('requests', f'{keys}, prompt, response', 'prompt')},
inputs AS (SELECT *, CASE WHEN r_lang = 'es' THEN {failed(GUARDS.inputs['es'], 'prompt')}
                          ELSE {failed(GUARDS.inputs['en'], 'prompt')} END AS in_by FROM routed),
answered AS (SELECT {keys}, response FROM inputs WHERE prompt <> '' AND len(in_by) = 0 AND response IS NOT NULL),
{masked('answered', keys, 'response')},
outputs AS (SELECT *, {by_output} AS out_by FROM masked),
decided AS (
  SELECT {', '.join('r.' + k.strip() for k in keys.split(','))}, r.prompt, r_lang, r_conf, m.t, m.ents, in_by, out_by,
    CASE WHEN prompt = '' THEN 'no_prompt' WHEN len(in_by) > 0 THEN 'blocked' WHEN m.t IS NULL THEN 'upstream'
         WHEN len(out_by) > 0 THEN 'dropped' ELSE 'allowed' END AS stage,
    {_ROUTE_LINE} AS line,
    CASE WHEN len(m.ents) > 0 THEN 'PII masked: ' || array_to_string(m.ents, ', ') END AS pii_line
  FROM inputs r LEFT JOIN outputs m ON {on}),
results AS (
  SELECT *, CASE stage WHEN 'allowed' THEN 'ALLOWED' WHEN 'blocked' THEN 'BLOCKED' WHEN 'dropped' THEN 'DROPPED' ELSE 'ERROR' END AS decision,
    CASE stage WHEN 'no_prompt' THEN 400 WHEN 'upstream' THEN 502 ELSE 200 END::BIGINT AS status_code,
    CASE stage WHEN 'no_prompt' THEN '' WHEN 'upstream' THEN 'no recorded response' WHEN 'allowed' THEN t ELSE '{REFUSAL}' END AS content,
    CASE stage WHEN 'no_prompt' THEN 'No user message found in request.'
      WHEN 'blocked' THEN 'Blocked by input classifiers: ' || array_to_string(in_by, ', ') || ' | ' || line
      WHEN 'upstream' THEN 'Upstream error: no recorded response | ' || line
      WHEN 'dropped' THEN concat_ws(' | ', 'Blocked by output classifiers: ' || array_to_string(out_by, ', '), line, pii_line)
      ELSE concat_ws(' | ', '{headline}', line, pii_line) END AS detail,
    CASE stage WHEN 'blocked' THEN array_to_string(in_by, ',') WHEN 'dropped' THEN array_to_string(out_by, ',') ELSE '' END AS failed_filters,
    CASE stage WHEN 'no_prompt' THEN '' WHEN 'blocked' THEN 'INPUT_BLOCKED' WHEN 'upstream' THEN 'UPSTREAM_ERROR'
      WHEN 'dropped' THEN 'OUTPUT_BLOCKED' ELSE 'PASSED' END AS log_type,
    CASE stage WHEN 'no_prompt' THEN '' WHEN 'upstream' THEN 'no recorded response' WHEN 'blocked' THEN '{REFUSAL}'
      WHEN 'dropped' THEN coalesce(nullif(t, ''), '{REFUSAL}') ELSE coalesce(nullif(t, ''), '(empty response)') END AS logged_response
  FROM decided)"""


_TURNS = """SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response FROM conversations u
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"""
_LAST = """SELECT p.conv_id, p.prompt, a.text AS response FROM
  (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS prompt, max(turn) FILTER (role = 'user') AS turn
   FROM conversations GROUP BY conv_id) p
  LEFT JOIN conversations a ON a.conv_id = p.conv_id AND a.turn = p.turn + 1 AND a.role = 'assistant'"""
_DOCS = "SELECT doc_id, text AS prompt, text AS response FROM documents"
_RESULT = "decision, status_code, content, detail, failed_filters, log_type, logged_response"
SQL["next_responses"] = """
WITH t AS (
  SELECT conv_id, role, text, turn * 2 + CASE WHEN role = 'assistant' AND turn // 2 % 3 = 0 THEN 1 ELSE 0 END AS turn
  FROM conversations
), n AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM t WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)
SELECT conv_id, turn, text AS prompt, CASE WHEN next_role = 'assistant' THEN next_text END AS response
FROM n WHERE role = 'user'"""
_TURN_RESULTS = "WITH " + screened(_TURNS, "conv_id, turn")

SQL["screen_conversations"] = f"{_TURN_RESULTS} SELECT conv_id, turn, {_RESULT} FROM results"
SQL["screen_last_prompts"] = f"WITH {screened(_LAST, 'conv_id')} SELECT conv_id, {_RESULT} FROM results"
SQL["screen_documents"] = f"WITH {screened(_DOCS, 'doc_id')} SELECT doc_id, {_RESULT} FROM results"
SQL["screen_without_output"] = f"""
WITH {screened(_DOCS, 'doc_id', output=False)} SELECT doc_id, decision, content, detail FROM results"""

_score = "CASE WHEN list_contains({by}, '{name}') THEN 0.92::DOUBLE ELSE 0.06::DOUBLE END"
_parts = ["SELECT conv_id, turn, 'input:Language Router' AS name, r_conf AS score FROM results WHERE stage <> 'no_prompt'"]
for _lang, _specs in GUARDS.inputs.items():
    for _s in _specs:
        _parts.append(
            f"SELECT conv_id, turn, 'input:{_s.name}', {_score.format(by='in_by', name=_s.name)} FROM results "
            f"WHERE stage <> 'no_prompt' AND (r_lang = 'es') = ({q(_lang)} = 'es')"
        )
for _s in GUARDS.outputs:
    _parts.append(
        f"SELECT conv_id, turn, 'output:{_s.name}', {_score.format(by='out_by', name=_s.name)} FROM results "
        "WHERE stage IN ('dropped', 'allowed')"
    )
_SCORES = ", scored AS (" + " UNION ALL ".join(_parts) + ")"
SQL["screening_scores"] = f"{_TURN_RESULTS} {_SCORES} SELECT * FROM scored"
SQL["score_band"] = f"""{_TURN_RESULTS} {_SCORES}
SELECT name AS filter_name, CASE WHEN score > 0.7 THEN 'danger' WHEN score > 0.3 THEN 'warning' ELSE 'safe' END AS band, count(*) AS n
FROM scored WHERE name <> 'input:Language Router' GROUP BY 1, 2"""

_COUNTS = """count(*) AS total, count(*) FILTER (decision = 'ALLOWED') AS allowed, count(*) FILTER (decision = 'BLOCKED') AS blocked,
  count(*) FILTER (decision = 'DROPPED') AS dropped, count(*) FILTER (decision = 'ERROR') AS errors"""
SQL["decision_stats"] = f"{_TURN_RESULTS} SELECT {_COUNTS} FROM results"
SQL["batch_screening"] = f"{_TURN_RESULTS} SELECT conv_id, {_COUNTS} FROM results GROUP BY conv_id"
SQL["latency_stats"] = f"""
WITH log AS (SELECT CASE event_type WHEN 'signup' THEN 'ALLOWED' WHEN 'view' THEN 'ALLOWED' WHEN 'click' THEN 'BLOCKED'
    WHEN 'purchase' THEN 'DROPPED' ELSE 'ERROR' END AS decision, CASE WHEN event_type <> 'error' THEN round(value * 100)::BIGINT END AS l FROM events)
SELECT {_COUNTS}, coalesce(round(avg(l), 3), 0.0) AS average_total_latency_ms FROM log"""
SQL["blocked_by_freq"] = f"""{_TURN_RESULTS}
SELECT filter_name, decision, count(*) AS n FROM
  (SELECT decision, unnest(CASE stage WHEN 'blocked' THEN in_by WHEN 'dropped' THEN out_by ELSE CAST([] AS VARCHAR[]) END) AS filter_name FROM results)
GROUP BY 1, 2"""
_FAILED_OR_NONE = "CASE WHEN stage IN ('blocked', 'dropped') THEN failed_filters ELSE 'none' END"
SQL["recent_decisions"] = f"""{_TURN_RESULTS}
SELECT conv_id, turn, log_type AS type, decision, {_FAILED_OR_NONE} AS failed_filters FROM results
WHERE stage <> 'no_prompt' ORDER BY conv_id DESC, turn DESC LIMIT 500"""
SQL["recent_stats"] = f"""{_TURN_RESULTS}
SELECT {_COUNTS} FROM (SELECT decision FROM results WHERE stage <> 'no_prompt')"""
_LOG_AT = "to_timestamp(1700000000 + conv_id * 3600 + turn) AT TIME ZONE 'UTC'"
SQL["log_roundtrip"] = f"""{_TURN_RESULTS}
SELECT conv_id, turn, log_type AS type, decision, logged_response AS response, strftime({_LOG_AT}, '%Y-%m-%d') AS day
FROM results WHERE stage <> 'no_prompt' AND {_LOG_AT} >= TIMESTAMP '2023-11-16'"""
SQL["log_newest"] = f"""{_TURN_RESULTS}
SELECT lpad(conv_id::VARCHAR, 12, '0') || '-' || lpad(turn::VARCHAR, 12, '0') AS id, log_type AS type, decision
FROM results WHERE stage <> 'no_prompt' ORDER BY conv_id * 3600 + turn DESC, id DESC LIMIT 300"""
SQL["error_payloads"] = f"""WITH {screened(_LAST, 'conv_id')}
SELECT conv_id, status_code, '{{"error":{{"message":"' || CASE status_code WHEN 502 THEN 'Upstream LLM error: ' || content ELSE detail END
       || '"}}}}' AS payload
FROM results WHERE decision = 'ERROR'"""
SQL["decision_filter"] = f"""{_TURN_RESULTS}
SELECT conv_id, turn, log_type AS type, logged_response AS response FROM results WHERE decision = 'BLOCKED'"""

SQL["chat_messages"] = """
WITH s AS (SELECT conv_id, text AS system FROM conversations WHERE role = 'system' AND turn = 0),
m AS (SELECT u.conv_id, u.turn, u.text, CASE WHEN s.system <> '' THEN
        [{'role': 'system', 'content': s.system}, {'role': 'user', 'content': u.text}]
        ELSE [{'role': 'user', 'content': u.text}] END AS messages
      FROM conversations u LEFT JOIN s USING (conv_id) WHERE u.role = 'user')
SELECT conv_id, turn, len(messages)::BIGINT AS n_messages, text AS prompt, CAST(to_json(messages) AS VARCHAR) AS messages FROM m"""

SQL["chat_responses"] = f"""
WITH {masked('documents', 'doc_id', 'text')}
SELECT doc_id, CAST(to_json({{'id': 'id-' || doc_id, 'object': 'chat.completion', 'created': 0, 'model': 'test-model',
    'choices': [{{'index': 0, 'message': {{'role': 'assistant', 'content': t}}, 'finish_reason': 'stop'}}],
    'usage': {{'prompt_tokens': 0, 'completion_tokens': 0, 'total_tokens': 0}}}}) AS VARCHAR) AS body, len(ents) > 0 AS changed
FROM masked"""

SQL["batch_requests"] = """
SELECT conv_id, turn, CASE conv_id % 8 WHEN 1 THEN '`prompts` must be a non-empty array of strings.'
    WHEN 2 THEN 'Every item in `prompts` must be a string.' WHEN 3 THEN '`model` must be a non-empty string.'
    WHEN 4 THEN '`concurrency` must be an integer greater than 0.'
    WHEN 7 THEN '`system_message` must be a string when provided.' ELSE '' END AS error,
  CASE WHEN conv_id % 8 IN (0, 5, 6) THEN 2 ELSE -1 END::BIGINT AS n_prompts,
  CASE conv_id % 8 WHEN 0 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE -1 END::BIGINT AS concurrency
FROM conversations WHERE role = 'user'"""

SQL["batch_flow"] = f"""
WITH {screened(_DOCS, 'doc_id')},
placed AS (SELECT decision, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM results)
SELECT {_COUNTS}, min(place) AS first_place, max(place) AS last_place, count(DISTINCT place) AS places, 'none' AS error,
       coalesce(sum(place) FILTER (decision = 'BLOCKED'), 0)::BIGINT AS blocked_places
FROM placed"""
_FAILS = "r_lang <> 'es' AND starts_with(prompt, 'T')"
_BY_MODEL = f"CASE WHEN {_EXTERNAL.replace('text', 'prompt')} > 0.6::DOUBLE THEN ['external_model'] ELSE CAST([] AS VARCHAR[]) END"
SQL["screen_failures"] = f"""
WITH {screened(_DOCS, 'doc_id').replace(failed(GUARDS.inputs['en'], 'prompt'), _BY_MODEL).replace('policy_bypass_guard, prompt_injection_guard', 'external_model')}
SELECT doc_id, CASE WHEN {_FAILS} THEN 'ERROR' ELSE decision END AS decision, CASE WHEN {_FAILS} THEN 503 ELSE status_code END::BIGINT AS status_code,
       CASE WHEN {_FAILS} THEN 'INPUT_MODEL_ERROR' WHEN log_type <> '' THEN log_type END AS log_type,
       CASE WHEN {_FAILS} THEN 'Input model error: ValueError: cannot score | ' || line ELSE detail END AS detail,
       CASE WHEN {_FAILS} THEN '{{"error":{{"message":"Input model error: ValueError: cannot score | ' || line || '"}}}}' ELSE '' END AS error_payload
FROM results"""
_RUNS = """SELECT doc_id, lang, unnest([p[i:i + 2] FOR i IN range(1, length(p) - 1)]) AS gram
  FROM (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) || ' ' AS p FROM documents)"""
SQL["language_trained"] = f"""
WITH runs AS ({_RUNS}),
counts AS (SELECT gram, lang, count(*) AS n FROM runs WHERE doc_id % 2 = 0 AND lang IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, round(ln(sum(n) + (SELECT count(DISTINCT gram) FROM counts)) * 1000000)::BIGINT AS total FROM counts GROUP BY lang),
sizes AS (SELECT doc_id, count(*) AS runs FROM runs GROUP BY doc_id),
per_doc AS (SELECT doc_id, gram, count(*) AS n FROM runs GROUP BY ALL),
hits AS (SELECT d.doc_id, c.lang, sum(d.n * round(ln(c.n + 1) * 1000000)::BIGINT) AS hit FROM per_doc d JOIN counts c USING (gram) GROUP BY ALL),
scored AS (SELECT s.doc_id, runs, t.lang, coalesce(hit, 0) - runs * total AS score FROM sizes s CROSS JOIN totals t
  LEFT JOIN hits h ON h.doc_id = s.doc_id AND h.lang = t.lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS place,
           score - lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS ahead FROM scored)
SELECT d.doc_id, CASE WHEN ahead IS NULL OR ahead >= 20000 * runs THEN r.lang ELSE 'unsure' END AS lang, d.lang AS label,
       round(ahead::DOUBLE / (runs * 1000000.0::DOUBLE), 6) AS margin
FROM documents d JOIN ranked r USING (doc_id) WHERE place = 1"""
SQL["daily_rollups"] = """
SELECT event_type, count(*) AS n, count(DISTINCT ts::DATE) AS days, round(avg(round(value * 100)::BIGINT), 6) AS mean_cents,
       true AS p95_near, true AS users_near
FROM events WHERE ts IS NOT NULL GROUP BY event_type"""

# ---- corpus construction ------------------------------------------------------------------------

SQL["dedupe_kept"] = f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {near_key('text')}"
SQL["dedupe_rows"] = f"""
SELECT doc_id, text, source, lang FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY {near_key('text')})"""
SQL["incremental_dedupe"] = f"""
SELECT doc_id, (doc_id % 3)::INTEGER AS delivery FROM documents WHERE text IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {near_key('text')} ORDER BY doc_id % 3, doc_id) = 1"""
SQL["dedupe_counts"] = f"""
WITH k AS (SELECT doc_id, text, {near_key('text')} AS k FROM documents),
f AS (SELECT *, first_value(doc_id) OVER w AS first_id, first_value(text) OVER w AS first_text FROM k
      WINDOW w AS (PARTITION BY k ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT count(*) AS rows_before, count(*) FILTER (doc_id = first_id) AS rows_after,
       count(*) FILTER (doc_id <> first_id AND text = first_text) AS exact_collisions,
       count(*) FILTER (doc_id <> first_id AND text <> first_text) AS near_dup_collisions
FROM f"""
SQL["unseen_documents"] = f"""
WITH d AS (SELECT doc_id, source, {near_key('text')} AS k FROM documents)
SELECT doc_id, CASE WHEN k IN (SELECT k FROM d WHERE source < 'src13') THEN 'seen' ELSE 'new' END AS kind
FROM d WHERE source >= 'src13'"""

_LABELLED = "labelled AS (SELECT doc_id, text, toxic AS label, source, lang, quality FROM documents JOIN labels USING (doc_id))"


def balanced(rows: str, ratio: float, key: str = "doc_id") -> str:
    """CTE ``balanced`` over a CTE of rows with doc_id, label, source and lang; ``key`` is what is hashed."""
    return f"""
sizes AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0,
          round_even(count(*) FILTER (label = 1) * (1.0::DOUBLE - {ratio}::DOUBLE) / {ratio}::DOUBLE, 0)::BIGINT AS desired FROM {rows}),
ranked AS (SELECT r.*, n1, n0, desired, sha256('7|' || {key}) AS h,
    row_number() OVER (PARTITION BY source, lang ORDER BY sha256('7|' || {key})) AS rn, count(*) OVER (PARTITION BY source, lang) AS size
  FROM {rows} r, sizes WHERE label = 0),
drawn AS (SELECT *, row_number() OVER (ORDER BY h) AS place FROM ranked
  WHERE NOT (n1 > 0 AND n0 > desired) OR rn <= least(size, greatest(1, round_even(desired * (size::DOUBLE / n0), 0)::BIGINT))),
balanced AS (SELECT doc_id, label, source, lang FROM {rows} WHERE label = 1
  UNION ALL SELECT doc_id, label, source, lang FROM drawn WHERE NOT (n1 > 0 AND n0 > desired) OR place <= desired)"""


def divided(rows: str, key: str = "doc_id") -> str:
    return f"""
places AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY sha256('7-split|' || {key})) AS rn2,
                  count(*) OVER (PARTITION BY source, label) AS n FROM {rows}),
divided AS (SELECT *, CASE WHEN rn2 <= round_even(n * 0.8::DOUBLE, 0) THEN 'train'
    WHEN rn2 <= round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM places)"""


SQL["balance"] = f"WITH {_LABELLED}, {balanced('labelled', 0.3)} SELECT doc_id, label::BIGINT AS label FROM balanced"
SQL["balance_stats"] = f"""
WITH {_LABELLED}, {balanced('labelled', 0.3)}
SELECT (SELECT count(*) FROM balanced WHERE label = 1) AS kept_pos, (SELECT count(*) FROM balanced WHERE label = 0) AS kept_neg,
       n1 > 0 AND n0 > desired AS subsampled, desired AS desired_neg,
       (SELECT count(DISTINCT (source, lang)) FROM labelled WHERE label = 0) AS neg_strata
FROM sizes"""
SQL["split"] = f"WITH {_LABELLED}, {divided('labelled')} SELECT doc_id, split FROM divided"
SQL["split_summary"] = f"""
WITH {_LABELLED}, {divided('labelled')}
SELECT split, 'total' AS dimension, 'all' AS value, count(*) AS n FROM divided GROUP BY 1
UNION ALL SELECT split, 'by_source', source, count(*) FROM divided GROUP BY 1, 3
UNION ALL SELECT split, 'by_lang', lang, count(*) FROM divided GROUP BY 1, 3
UNION ALL SELECT split, 'by_label', label::VARCHAR, count(*) FROM divided GROUP BY 1, 3"""
SQL["stratum_count"] = f"WITH {_LABELLED} SELECT count(DISTINCT (source, lang)) AS strata FROM labelled WHERE label = 0"
SQL["training_order"] = f"WITH {_LABELLED} SELECT doc_id, sha256('7-order|' || doc_id) AS order_key FROM labelled"
SQL["built_corpus"] = f"""
WITH {_LABELLED},
clean AS (SELECT doc_id, {strip('text')} AS text, label, 'documents' AS source, lang FROM labelled WHERE NOT {_blank}),
firsts AS (SELECT * FROM clean WHERE doc_id IN (SELECT min(doc_id) FROM clean GROUP BY {near_key('text')})),
{balanced('firsts', 0.6)}, {divided('balanced')}
SELECT doc_id, d.label::BIGINT AS label, d.lang, length(text)::BIGINT AS length, split FROM divided d JOIN firsts USING (doc_id)"""

# Labelled documents as two training sources and a held-out one; a row's place is its source's and its doc_id.
_PLACE = "'{' || CASE source WHEN 'first' THEN 0 ELSE 1 END || ', , ' || doc_id || '}'"
_BUILT = f"""{_LABELLED},
pooled AS (SELECT doc_id, {strip('text')} AS text, label, lang, (doc_id % 5)::INT // 2 AS priority, {_blank} AS blank,
           ['first', 'second', 'jailbreakbench_behaviors'][1 + (doc_id % 5)::INT // 2] AS source FROM labelled),
clean AS (SELECT *, row_number() OVER (PARTITION BY {near_key('text')} ORDER BY priority, doc_id) AS place,
          first_value(text) OVER (PARTITION BY {near_key('text')} ORDER BY priority, doc_id) AS first_text
          FROM pooled WHERE NOT blank AND priority < 2),
firsts AS (SELECT * FROM clean WHERE place = 1),
{balanced('firsts', 0.3, _PLACE)}, {divided('balanced', _PLACE)},
final AS (SELECT doc_id, d.source, d.label, d.lang, length(text) AS length, split FROM divided d JOIN firsts USING (doc_id))"""
SQL["catalogue_scan"] = """
SELECT doc_id, ['train', 'train', 'test', 'validation'][1 + (doc_id % 4)::INT] AS split, CASE WHEN doc_id % 4 = 0 THEN lang END AS lang,
       CASE WHEN doc_id % 4 = 1 THEN source END AS source, doc_id % 4 <> 2 AS has_lang
FROM documents"""
SQL["split_sinks"] = f"""
WITH {_BUILT}
SELECT doc_id, source, label::BIGINT AS label, lang, length::BIGINT AS length, split FROM final"""
SQL["held_out_sets"] = f"""
WITH {_BUILT}
SELECT doc_id, source, label::BIGINT AS label, lang, length(text)::BIGINT AS length FROM pooled WHERE NOT blank AND priority = 2"""
SQL["manifest_rows"] = f"""
WITH {_BUILT},
stats AS (SELECT source, CASE WHEN priority < 2 THEN 'training_pool/per_source/' ELSE 'held_out/' END || source || '/' AS path,
          count(*) AS n, count(*) FILTER (NOT blank) AS kept, count(*) FILTER (NOT blank AND label = 0) AS l0,
          count(*) FILTER (NOT blank AND label = 1) AS l1 FROM pooled GROUP BY 1, 2),
pool(path, n) AS (
  SELECT 'pre_dedup_total', count(*) FROM clean UNION ALL SELECT 'post_dedup_total', count(*) FROM firsts
  UNION ALL SELECT 'dedup/exact_collisions', count(*) FROM clean WHERE place > 1 AND text = first_text
  UNION ALL SELECT 'dedup/near_dup_collisions', count(*) FROM clean WHERE place > 1 AND text <> first_text
  UNION ALL SELECT 'balance/kept_pos', count(*) FILTER (label = 1) FROM final
  UNION ALL SELECT 'balance/kept_neg', count(*) FILTER (label = 0) FROM final
  UNION ALL SELECT 'balance/desired_neg', desired FROM sizes WHERE n1 > 0 AND n0 > 0
  UNION ALL SELECT 'balance/neg_strata', (SELECT count(DISTINCT (source, lang)) FROM firsts WHERE label = 0) FROM sizes WHERE n1 > 0 AND n0 > desired
  UNION ALL SELECT 'splits/' || s || '/total', count(*) FILTER (split = s) FROM final, (SELECT unnest(['train', 'val', 'test']) AS s) GROUP BY s
  UNION ALL SELECT 'splits/' || split || '/by_source/' || source, count(*) FROM final GROUP BY split, source
  UNION ALL SELECT 'splits/' || split || '/by_lang/' || lang, count(*) FROM final GROUP BY split, lang
  UNION ALL SELECT 'splits/' || split || '/by_label/' || label, count(*) FROM final GROUP BY split, label)
SELECT path || 'raw_rows_after_filter' AS path, n FROM stats UNION ALL SELECT path || 'kept_rows', kept FROM stats
UNION ALL SELECT path || 'skipped_rows', n - kept FROM stats
UNION ALL SELECT path || 'label_counts/0', l0 FROM stats WHERE l0 > 0 UNION ALL SELECT path || 'label_counts/1', l1 FROM stats WHERE l1 > 0
UNION ALL SELECT 'training_pool/' || path, n FROM pool"""

# ---- evaluation ---------------------------------------------------------------------------------


def scored(score: str, pred: str) -> str:
    return f"""{_LABELLED},
scored AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS tbl, source, lang, label, ({pred})::INT AS pred,
           {score} AS score, (doc_id % 37 + 1)::DOUBLE AS ms FROM labelled),
sliced AS (SELECT *, 'overall' AS dimension, 'all' AS value FROM scored
  UNION ALL SELECT *, 'source', source FROM scored UNION ALL SELECT *, 'lang', lang FROM scored)"""


_GRADED_ROWS = scored(_GRADED, f"{_GRADED} > 0.1::DOUBLE")
_COARSE_ROWS = scored(f"CASE WHEN {_COARSE} THEN 0.92::DOUBLE ELSE 0.06::DOUBLE END", _COARSE)
_SLICE = "tbl, dimension, value"
_CONFUSION = f"""
counts AS (SELECT {_SLICE}, count(*) AS n, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
           count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 1 AND pred = 0) AS fn FROM sliced GROUP BY {_SLICE}),
pr AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS r FROM counts),
confusion AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr)"""

SQL["confusion_slices"] = f"""
WITH {_GRADED_ROWS}, {_CONFUSION}
SELECT {_SLICE}, n, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1,
       round((tp + tn)::DOUBLE / n, 6) AS accuracy
FROM confusion"""

# Every pair of a positive and a negative of a slice, counted from the scores present.
_AUC = f"""
by_score AS (SELECT {_SLICE}, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM sliced GROUP BY {_SLICE}, score),
totals AS (SELECT {_SLICE}, sum(p) AS tp_all, sum(n) AS fp_all FROM by_score GROUP BY {_SLICE}),
pairs AS (SELECT a.tbl, a.dimension, a.value, sum(a.p * b.n * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS won
  FROM by_score a JOIN by_score b USING ({_SLICE}) GROUP BY 1, 2, 3),
flagged AS (SELECT a.tbl, a.dimension, a.value, a.score, any_value(a.p) AS p, sum(b.p) AS tp, sum(b.n) AS fp
  FROM by_score a JOIN by_score b USING ({_SLICE}) WHERE b.score >= a.score GROUP BY 1, 2, 3, 4),
precisions AS (SELECT {_SLICE}, sum(p * tp::DOUBLE / (tp + fp)) AS ap FROM flagged WHERE tp + fp > 0 GROUP BY {_SLICE}),
auc AS (SELECT {_SLICE}, CASE WHEN tp_all > 0 AND fp_all > 0 THEN won::DOUBLE / (tp_all * fp_all) END AS roc_auc,
        CASE WHEN tp_all > 0 AND fp_all > 0 THEN ap / tp_all END AS pr_auc
  FROM totals JOIN pairs USING ({_SLICE}) JOIN precisions USING ({_SLICE}))"""
SQL["roc_auc"] = f"WITH {_GRADED_ROWS}, {_AUC} SELECT {_SLICE}, round(roc_auc, 6) AS roc_auc FROM auc"
SQL["pr_auc"] = f"WITH {_GRADED_ROWS}, {_AUC} SELECT {_SLICE}, round(pr_auc, 6) AS pr_auc FROM auc"

_LATENCY = f"""
placed AS (SELECT {_SLICE}, ms, row_number() OVER (PARTITION BY {_SLICE} ORDER BY ms) - 1 AS place, count(*) OVER (PARTITION BY {_SLICE}) AS k FROM sliced),
latency AS (SELECT {_SLICE}, avg(ms) AS mean_ms, max(CASE WHEN place = round_even(0.95::DOUBLE * (k - 1), 0) THEN ms END) AS p95 FROM placed GROUP BY {_SLICE})"""
SQL["evaluation_report"] = f"""
WITH {_GRADED_ROWS}, {_CONFUSION}, {_AUC}, {_LATENCY}
SELECT {_SLICE}, n, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc,
       round(mean_ms, 6) AS mean_latency_ms, round(p95, 6) AS p95_latency_ms
FROM confusion JOIN auc USING ({_SLICE}) JOIN latency USING ({_SLICE})"""

_BOTH_ROWS = _GRADED_ROWS.replace(
    "sliced AS (SELECT *, 'overall'", "again AS (SELECT * FROM scored UNION ALL SELECT * REPLACE ('both' AS tbl) FROM scored),\n"
    "sliced AS (SELECT *, 'overall'"
).replace("FROM scored\n  UNION", "FROM again\n  UNION").replace("'source', source FROM scored", "'source', source FROM again").replace(
    "'lang', lang FROM scored", "'lang', lang FROM again"
)
SQL["rounded_report"] = f"""
WITH {_BOTH_ROWS}, {_CONFUSION}, {_LATENCY}
SELECT {_SLICE}, n, round(p, 4) AS precision, round(r, 4) AS recall, round((tp + tn)::DOUBLE / n, 4) AS accuracy,
       round(mean_ms, 3) AS mean_latency_ms
FROM confusion JOIN latency USING ({_SLICE})"""

SQL["p95_rank"] = """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place,
           count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(avg(round(value * 100)::BIGINT), 6) AS mean_cents, max(CASE WHEN place = round_even(0.95::DOUBLE * (n - 1), 0) THEN value END) AS p95_ms
FROM r GROUP BY event_type"""

SQL["threshold_sweep"] = f"""
WITH {_GRADED_ROWS}, {_AUC},
f AS (SELECT {_SLICE}, score, coalesce(2 * tp::DOUBLE / nullif(tp_all + tp + fp, 0), 0.0) AS f1 FROM flagged JOIN totals USING ({_SLICE})),
b AS (SELECT *, row_number() OVER (PARTITION BY {_SLICE} ORDER BY f1 DESC, score DESC) AS rn FROM f)
SELECT {_SLICE}, round(score, 6) AS flag_from, round(f1, 6) AS f1 FROM b WHERE rn = 1"""


def _two_reports() -> str:
    graded = f"(WITH {_GRADED_ROWS}, {_CONFUSION} SELECT * FROM confusion)"
    coarse = f"(WITH {_COARSE_ROWS}, {_CONFUSION} SELECT * FROM confusion)"
    return f"new_report AS {graded}, old_report AS {coarse}"


SQL["model_bake_off"] = f"""
WITH {_two_reports()}
SELECT {_SLICE}, round(a.f1, 6) AS graded, round(b.f1, 6) AS coarse FROM new_report a JOIN old_report b USING ({_SLICE})"""
_ES = "tbl = 'poor' AND dimension = 'lang' AND value = 'es'"
SQL["promotion_gate"] = f"""
WITH {_two_reports()},
g AS (SELECT (SELECT f1 FROM new_report WHERE tbl = 'good' AND dimension = 'overall') AS f1,
  coalesce((SELECT r FROM new_report WHERE {_ES}) >= (SELECT r FROM old_report WHERE {_ES}), true) AS spanish_ok,
  (SELECT count(*) FROM new_report a JOIN old_report b USING ({_SLICE}) WHERE tbl = 'good' AND dimension = 'source'
   AND value IN ('src1', 'src2', 'src3') AND round(a.f1 - b.f1, 9) >= 0.10) AS sources_gained)
SELECT round(f1, 6) AS f1, f1 >= 0.85 AS f1_ok, spanish_ok, sources_gained, sources_gained >= 2 AS gain_ok,
       f1 >= 0.85 AND spanish_ok AND sources_gained >= 2 AS promoted
FROM g"""
SQL["labelled_accuracy"] = f"""
WITH {_LABELLED}
SELECT count(*) AS n, count(*) FILTER ((label = 1) = {_COARSE}) AS correct,
       round(count(*) FILTER ((label = 1) = {_COARSE})::DOUBLE / count(*), 6) AS accuracy
FROM labelled"""
SQL["first_rows"] = f"WITH {_LABELLED} SELECT doc_id, source FROM labelled ORDER BY doc_id LIMIT 100"

SQL["tfidf_weights"] = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS n FROM terms GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(*))) + 1 AS idf FROM counts GROUP BY term),
raw AS (SELECT doc_id, term, n * idf AS w FROM counts JOIN idf USING (term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS place FROM raw),
found AS (SELECT doc_id, count(*) AS terms, sqrt(sum(w * w)) AS length, max(CASE WHEN place = 1 THEN term END) AS heaviest FROM ranked GROUP BY doc_id)
SELECT doc_id, coalesce(terms, 0) AS terms, round(length, 6) AS length, CASE WHEN terms > 0 THEN 1.0::DOUBLE END AS unit, heaviest
FROM documents LEFT JOIN found USING (doc_id)"""
SQL["embedding_head_gradient"] = "SELECT place, true AS near_zero FROM (SELECT unnest(range(max(len(embedding)) + 1)) AS place FROM embeddings)"

# ---- streams ------------------------------------------------------------------------------------

_DOC_RESULTS = "WITH " + screened(_DOCS, "doc_id")
SQL["stream_screening"] = f"""{_DOC_RESULTS}
SELECT doc_id, log_type AS type, decision, logged_response AS response, detail FROM results WHERE stage <> 'no_prompt'"""
SQL["stream_newest"] = f"""{_DOC_RESULTS}
SELECT doc_id, log_type AS type, decision FROM results WHERE stage <> 'no_prompt' ORDER BY doc_id DESC LIMIT 500"""
SQL["stream_pairs"] = _TURNS
SQL["stream_windows"] = SQL["windowed_decisions"] = """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(avg(round(value * 100)::BIGINT), 6) AS mean_cents
FROM events GROUP BY 1, 2"""
SQL["stream_first_arrivals"] = f"SELECT DISTINCT {near_key('text')} AS near_key FROM documents"

ORACLE: dict[str, str] = SQL
