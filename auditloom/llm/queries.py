"""The training-data operators as registered queries, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, exact, jaccard, language_model, leaks, main_text, media, mixing, negatives, personal, quality, secrets, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": lambda s, d: secrets.secret_scan(_table(s, d, "documents")),
        "op2_main_text": lambda s, d: main_text.extract(_table(s, d, "pages")),
        "op3_personal_data": lambda s, d: personal.personal_data(_table(s, d, "documents")),
        "op4_language_model": lambda s, d: language_model.language_model_scores(_table(s, d, "documents")),
        "op5_source_mixing": lambda s, d: mixing.mix_sources(_table(s, d, "documents")).drop("source"),
        "op6_jaccard_join": lambda s, d: jaccard.jaccard_components(_table(s, d, "documents")),
        "op7_exact_dedup": lambda s, d: exact.exact_groups(_table(s, d, "documents")),
        "op8_substring_dedup": lambda s, d: substrings.repeated_substrings(_table(s, d, "documents")),
        "op9_quality": lambda s, d: quality.quality_scores(_table(s, d, "documents"), _table(s, d, "labels")),
        "op10_decontamination": lambda s, d: leaks.benchmark_leaks(_table(s, d, "documents"), _table(s, d, "benchmark")),
        "op11_conversation_repair": lambda s, d: conversations.conversation_repair(_table(s, d, "conversations")),
        "op12_hard_negatives": lambda s, d: negatives.hard_negatives(_table(s, d, "embeddings")),
        "op13_media_columns": lambda s, d: media.media_columns(_table(s, d, "documents")),
    }


EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents
), w AS (
  SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM w
"""

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END) AS g
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node) r USING (doc_id)
"""


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""

# A state's best line of edits is one text: the cost in nine digits, then the initials; the least text is the best line.
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Three inserts in a row reach all that inserts can.
_plus = lambda x, cost, edit: f"lpad(CAST(CAST({x}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {x}[10:] || '{edit}'"  # noqa: E731
_insert = lambda t: f"(SELECT conv_id, i, k0, k1, least(k2, {_plus('k0', 2, 'I')}, {_plus('k1', 2, 'I')}, {_plus('k3', 2, 'I')}) AS k2, least(k3, {_plus('k2', 2, 'I')}) AS k3 FROM {t})"  # noqa: E731
_keep = lambda x, initial: f"CASE WHEN fault NOT IN (1, 2) AND initial = '{initial}' THEN {_plus(x, 'late', 'K')} END"  # noqa: E731
_rerole = lambda x: f"CASE WHEN fault NOT IN (1, 2) THEN {_plus(x, '2 + late', 'R')} END"  # noqa: E731
_delete = lambda x: _plus(x, 3, "D")  # noqa: E731

CONVERSATIONS_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda crc, byte: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS way
  FROM conversations
), turns AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN way = 3 THEN 2 ELSE 1 END)) AS again
  FROM keyed WHERE way <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) - 1 AS i, role[1:1] AS initial FROM turns
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
), told AS (SELECT *, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS late FROM judged),
sizes AS (SELECT conv_id, count(*) AS n FROM told GROUP BY conv_id),
states AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS k0, CAST(NULL AS VARCHAR) AS k1, CAST(NULL AS VARCHAR) AS k2, CAST(NULL AS VARCHAR) AS k3 FROM sizes
  UNION ALL
  SELECT s.conv_id, s.i + 1, {_delete("k0")}, least({_delete("k1")}, {_keep("k0", "s")}),
    least({_delete("k2")}, {_keep("k0", "u")}, {_keep("k1", "u")}, {_keep("k3", "u")}, {_rerole("k0")}, {_rerole("k1")}, {_rerole("k3")}),
    least({_delete("k3")}, {_keep("k2", "a")}, {_rerole("k2")})
  FROM {_insert(_insert(_insert("states")))} s JOIN told t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i
), lines AS (
  SELECT s.conv_id, least(s.k0, s.k3) AS line FROM {_insert(_insert(_insert("states")))} s JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM s.conv_id AND z.n = s.i
), edits AS (
  SELECT conv_id, unnest(string_split(line[10:], '')) AS edit, unnest(range(1, len(line) - 8)) AS spot FROM lines WHERE len(line) > 9
), placed AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY spot) - 1 AS i FROM edits),
kept AS (
  SELECT p.conv_id, p.edit, p.spot, t.role, t.text, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.spot) - 1 AS m, first_value(p.edit = 'K' AND t.initial = 's') OVER (PARTITION BY p.conv_id ORDER BY p.spot) AS led
  FROM placed p LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i AND p.edit <> 'I' WHERE p.edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY spot) AS body FROM kept GROUP BY conv_id
), reports AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  coalesce(CAST(l.line[1:9] AS BIGINT), 0) AS cost, coalesce(l.line[10:], '') AS audit, sha256(coalesce(p.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN reports r ON r.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard_join": JACCARD_SQL, "op7_exact_dedup": EXACT_SQL, "op11_conversation_repair": CONVERSATIONS_SQL, "op12_hard_negatives": NEGATIVES_SQL}
