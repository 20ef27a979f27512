"""Queries opN_<name> over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedolith.llm.chat import REPLY, link_tool_calls, turns_as_calls
from pedolith.llm.common import table
from pedolith.llm.exact_dedup import exact_dedup
from pedolith.llm.licenses import scan
from pedolith.llm.lm import score
from pedolith.llm.minhash import near_duplicates
from pedolith.llm.mixing import mix
from pedolith.llm.quality import RULES, STOP_WORDS, SYMBOLS, quality
from pedolith.llm.repeats import sentence_span_dedup, suffix_array_dedup
from pedolith.llm.sentencepieces import decode, encode

WS_SQL = r"[\x20\x09-\x0D]+"
NOT_WS_SQL = r"[^\x20\x09-\x0D]+"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


OP1_SQL = f"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{WS_SQL}', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_tool_calls(turns_as_calls(table(spark, sf_dir, "conversations")), spark.sql(REPLY))
    return linked.withColumn("errors", F.array_join("errors", ","))


def _json_sql(**fields: str) -> str:
    """SQL text of a JSON object with sorted keys, null fields left out; values are SQL of JSON."""
    parts = [f"CASE WHEN {v} IS NOT NULL THEN ',\"{k}\":' || {v} ELSE '' END" for k, v in sorted(fields.items())]
    return "'{' || substr(" + " || ".join(parts) + ", 2) || '}'"


OP2_SQL = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, (7 * conv_id + 13 * turn) % 16 AS k, conv_id || ':' || turn AS id FROM conversations),
x AS (
  SELECT conv_id, turn, 0 AS idx, 'message' AS kind, role, NULL AS call_id, NULL AS name, NULL AS arguments, [] AS deps, CASE WHEN role <> 'user' THEN t END AS content, '' AS errors FROM c WHERE role <> 'assistant'
  UNION ALL
  SELECT conv_id, turn, i, 'call', role, id, CASE WHEN k = 3 THEN 'answer' ELSE 'reply' END,
    CASE k WHEN 0 THEN json_object('prompt', t) WHEN 1 THEN json_object('prompt', t, 'turn', turn::VARCHAR) WHEN 2 THEN json_object('loud', true, 'prompt', t, 'turn', turn) WHEN 4 THEN json_array(t) ELSE json_object('prompt', t, 'turn', turn) END::VARCHAR,
    CASE WHEN k = 6 THEN [conv_id || ':' || (turn + 2)] WHEN k = 9 THEN [id || ':b'] WHEN turn >= 2 AND (7 * conv_id + 13 * (turn - 2)) % 16 <> 6 THEN [conv_id || ':' || (turn - 2)] ELSE [] END, NULL,
    CASE k WHEN 0 THEN 'turn: missing' WHEN 1 THEN 'turn: not integer' WHEN 2 THEN 'loud: unknown' WHEN 3 THEN 'name: unknown tool' WHEN 4 THEN 'arguments: no object' ELSE '' END
  FROM c, range(1, 3) r(i) WHERE role = 'user' AND (i = 1 OR k = 5)
  UNION ALL
  SELECT conv_id, turn, 2, 'call', role, id || ':b', 'look_up', json_object('query', t)::VARCHAR, [], NULL, '' FROM c WHERE role = 'user' AND k = 9
  UNION ALL
  SELECT conv_id, turn, 0, 'result', role, CASE k WHEN 7 THEN id || ':none' WHEN 8 THEN conv_id || ':' || (turn - 3) ELSE conv_id || ':' || (turn - 1) END, NULL, NULL, [], t, '' FROM c WHERE role = 'assistant'
),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id, kind ORDER BY turn, idx) AS nth, count(CASE WHEN kind = 'call' THEN 1 END) OVER (PARTITION BY conv_id, call_id) AS n_calls, count(CASE WHEN kind = 'result' THEN 1 END) OVER (PARTITION BY conv_id, call_id) AS n_results FROM x),
s AS (SELECT *, CASE WHEN kind = 'message' THEN 'plain' WHEN nth > 1 THEN 'duplicate' WHEN kind = 'call' AND n_results = 0 THEN 'unanswered' WHEN kind = 'result' AND n_calls = 0 THEN 'orphan' ELSE 'linked' END AS status,
  {{'turn': turn, 'depth': 0::BIGINT, 'own': turn, 'idx': idx}} AS place FROM n),
calls AS (SELECT * FROM s WHERE kind = 'call' AND status IN ('linked', 'unanswered')),
results AS (SELECT * FROM s WHERE kind = 'result' AND status = 'linked'),
e AS (
  SELECT r.conv_id, a.place AS u, r.place AS v FROM results r JOIN calls a USING (conv_id, call_id)
  UNION
  SELECT b.conv_id, coalesce(r.place, a.place), b.place FROM (SELECT conv_id, place, unnest(deps) AS dep FROM calls) b JOIN calls a ON a.conv_id = b.conv_id AND a.call_id = b.dep LEFT JOIN results r ON r.conv_id = b.conv_id AND r.call_id = b.dep
),
walk(conv_id, v, now) AS (
  SELECT conv_id, u, u FROM e UNION SELECT conv_id, v, v FROM e
  UNION
  SELECT w.conv_id, e.v, CASE WHEN e.v > w.now THEN e.v ELSE {{'turn': w.now.turn, 'depth': w.now.depth + 1, 'own': e.v.own, 'idx': e.v.idx}} END FROM walk w JOIN e ON e.conv_id = w.conv_id AND e.u = w.v
),
p AS (SELECT conv_id, v, max(now) AS now FROM walk GROUP BY conv_id, v)
SELECT s.conv_id, turn, idx, kind, role, call_id, name, status, errors, coalesce(p.now.turn, turn) AS order_turn, coalesce(p.now.depth, 0)::INTEGER AS order_depth, false AS on_cycle,
  {_json_sql(arguments="arguments", call_id="to_json(call_id)::VARCHAR", content="to_json(content)::VARCHAR", kind="to_json(kind)::VARCHAR", name="to_json(name)::VARCHAR", role="to_json(role)::VARCHAR")} AS json
FROM s LEFT JOIN p ON p.conv_id = s.conv_id AND p.v = s.place AND s.kind <> 'message'
"""


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_span_dedup(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(table(spark, sf_dir, "documents"), merges=True))
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(chr(0x2581)), F.lit(" "))
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "merge_ids", same.alias("round_trip"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"))
    # one row per row: those that share id and text have the same scores
    return scored.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("_", "rows")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("measures")
    return scored.select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ((m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])).alias("base_failed"),
        "kept",
        F.array_join("failed", ",").alias("failed_rules"),
    )


def _failed_sql() -> str:
    """The threshold table as SQL."""
    parts = []
    for r in RULES:
        tests = [f"{r.sql()} < {r.low}"] * (r.low is not None) + [f"{r.sql()} > {r.high}"] * (r.high is not None)
        parts.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.name}' END")
    return f"concat_ws(',', {', '.join(parts)})"


OP8_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{WS_SQL}'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NOT_WS_SQL}')) AS l FROM t),
win AS (SELECT doc_id, i, w[i:i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(text, '{WS_SQL}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}], x))) AS n_stop_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, {_failed_sql()} AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed_rules = '' AS kept, failed_rules FROM f
"""


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=85)


OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WS_SQL}'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_chat_format": op2_chat_format,
        "op3_sentence_spans": op3_sentence_spans,
        "op4_license_scan": op4_license_scan,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_lm_score": op6_lm_score,
        "op7_suffix_array": op7_suffix_array,
        "op8_quality_rules": op8_quality_rules,
        "op9_minhash_dedup": op9_minhash_dedup,
        "op10_source_mix": op10_source_mix,
    }


def oracle_sql() -> dict:
    return {"op1_exact_dedup": OP1_SQL, "op2_chat_format": OP2_SQL, "op8_quality_rules": OP8_SQL, "op9_minhash_dedup": OP9_SQL}
