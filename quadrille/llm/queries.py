"""The queries op1 to op13: each operator over its whole table, in the contract's columns; and rows of what SQL can say of op6 and op7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, images, licenses, linededup, mixing, negatives, packing, quality, shingles, tokencounts, toolcalls, topk, toxicity
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0)).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.kept_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toolcalls.link(*toolcalls.conversation_calls(table(spark, sf_dir, "conversations")), toolcalls.CONVERSATION_SCHEMAS)
    return found.select("conv_id", "call_id", "name", "call_turn", "result_turn", "n_calls", "n_results", "status", "order_turn", "order_level", "result_order_turn", "result_order_level", "cyclic", "valid", F.array_join("errors", ",").alias("errors"), "json")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.license_scan(table(spark, sf_dir, "documents")))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6's rows what SQL can say: words and the places of the base phrases."""
    return op6_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.per_row(mixing.mix(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7's rows what SQL can say: sizes and the targets of sources."""
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """component_id joins fingerprints within two bits; near_component_id also joins texts that have half of their shingles in common, which differ in more bits."""
    found = shingles.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "near_component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no image column; each page's picture stands for one (see images.page_image)."""
    found = images.copies(images.page_features(table(spark, sf_dir, "pages")), tables=images.PAGE_TABLES)
    return found.select(F.col("image_id").alias("page_id"), "n_corners", "component_id", "n_links")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    found = negatives.hard_negatives(rows, rows.where(F.col("vec_id") % 50 == 0))
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file (op9 and the pipeline use the one named here); every node has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {f.__name__: f for f in (op1_quality, op2_top_k, op3_line_dedup, op4_toxicity, op5_tool_calls, op6_licenses, op7_mixing, op8_simhash, op9_packing, op10_image_copies, op11_alignment, op12_token_counts, op13_hard_negatives)}
#: Parts of op6's and op7's rows, for which there is SQL.
PARTS = {f.__name__: f for f in (license_base, mixing_targets)}

SQL = {
    "op2_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
pairs AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
              FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM pairs WHERE same) WHERE n <= 5),
found AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
          FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
""",
    "op5_tool_calls": """
WITH RECURSIVE turns AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text, coalesce(length(text), 0) AS n FROM conversations),
calls AS (SELECT *, conv_id || ':' || turn AS call_id FROM turns WHERE role IN ('user', 'system')),
results AS (SELECT conv_id, turn - 1 AS call_turn, conv_id || ':' || (turn - 1) AS call_id, turn, text FROM turns WHERE role = 'assistant'),
asked AS (SELECT conv_id, turn AS b, turn - 2 AS a FROM calls WHERE role = 'user' AND n % 3 <> 0 UNION ALL SELECT conv_id, turn, turn + 2 FROM calls WHERE role = 'user' AND n % 4 = 1),
needs AS (SELECT k.conv_id, k.a, k.b, r.turn AS answered, c.turn IS NOT NULL AS called FROM asked k JOIN results r ON r.conv_id = k.conv_id AND r.call_turn = k.a LEFT JOIN calls c ON c.conv_id = k.conv_id AND c.turn = k.a),
cycles AS (SELECT DISTINCT x.conv_id, x.b FROM needs x JOIN needs y ON x.conv_id = y.conv_id AND x.a = y.b AND x.b = y.a),
steps AS (SELECT n.* FROM needs n LEFT JOIN cycles c ON n.conv_id = c.conv_id AND n.b = c.b WHERE c.b IS NULL),
places AS (
  (SELECT conv_id, turn AS id, turn * 1000000 AS spot FROM calls UNION ALL SELECT conv_id, b, answered * 1000000 + 1 FROM steps WHERE NOT called)
  UNION SELECT s.conv_id, s.b, greatest(s.answered * 1000000 + 1, p.spot + 2) FROM places p JOIN steps s ON s.conv_id = p.conv_id AND s.a = p.id),
placed AS (SELECT conv_id, id, max(spot) AS spot FROM places GROUP BY conv_id, id)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, CASE c.role WHEN 'user' THEN 'respond' WHEN 'system' THEN 'configure' END AS name, c.turn AS call_turn, r.turn AS result_turn,
       CAST(c.call_id IS NOT NULL AS BIGINT) AS n_calls, CAST(r.call_id IS NOT NULL AS BIGINT) AS n_results,
       CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       p.spot // 1000000 AS order_turn, p.spot % 1000000 AS order_level,
       CASE WHEN p.spot IS NULL OR r.turn > p.spot // 1000000 THEN r.turn WHEN r.turn IS NOT NULL THEN p.spot // 1000000 END AS result_order_turn,
       CASE WHEN r.turn IS NULL THEN NULL WHEN p.spot IS NULL OR r.turn > p.spot // 1000000 THEN 0 ELSE p.spot % 1000000 + 1 END AS result_order_level,
       y.b IS NOT NULL AS cyclic,
       c.call_id IS NOT NULL AND NOT (c.role = 'user' AND (c.n % 5 = 4 OR c.n % 4 = 0 OR c.n % 7 = 0 OR c.n % 11 = 0)) AS valid,
       CASE WHEN c.role = 'user' THEN concat_ws(',', CASE WHEN c.n % 5 = 4 THEN 'options.style: not allowed' END, CASE WHEN c.n % 4 = 0 THEN 'options.tags[0]: not string' END, CASE WHEN c.n % 7 = 0 THEN 'chars: missing' END, CASE WHEN c.n % 11 = 0 THEN 'debug: unknown' END) ELSE '' END AS errors,
       '{"arguments":' || CASE c.role WHEN 'system' THEN '{"instructions":' || to_json(c.text) || '}' WHEN 'user' THEN
         '{' || CASE WHEN c.n % 7 <> 0 THEN '"chars":' || c.n || ',' ELSE '' END || CASE WHEN c.n % 11 = 0 THEN '"debug":true,' ELSE '' END
         || '"options":{"style":"' || ['brief', 'plain', 'long', 'plain', 'loud'][c.n % 5 + 1] || '","tags":[' || CASE WHEN c.n % 4 = 0 THEN c.turn || ',' ELSE '' END || '"x"]},"prompt":' || to_json(c.text) || ',"turn":' || c.turn || '}' ELSE 'null' END
       || ',"id":' || to_json(coalesce(c.call_id, r.call_id)) || ',"name":' || CASE c.role WHEN 'user' THEN '"respond"' WHEN 'system' THEN '"configure"' ELSE 'null' END || ',"result":' || coalesce(to_json(r.text), 'null') || '}' AS json
FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
LEFT JOIN placed p ON p.conv_id = c.conv_id AND p.id = c.turn LEFT JOIN cycles y ON y.conv_id = c.conv_id AND y.b = c.turn
""",
    "op3_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
cut AS (SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (SELECT row, doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM cut),
common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT row) >= 5),
marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
""",
}

PARTS_SQL = {
    "license_base": r"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
cut AS (SELECT row, unnest(w) AS a, unnest(range(len(w))) AS pos FROM words),
nearby AS (SELECT row, pos, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM cut WINDOW o AS (PARTITION BY row ORDER BY pos)),
found AS (SELECT row, pos, CASE WHEN a = 'cc' AND b = 'by' THEN 'cc-by' WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' WHEN a = 'all' AND b = 'rights' AND c = 'reserved' THEN 'reserved' END AS label FROM nearby),
places AS (SELECT row, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found WHERE label IS NOT NULL GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM words LEFT JOIN places USING (row)
""",
    "mixing_targets": r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source),
ends AS (SELECT *, 2.0 * source_size / weight AS ends_at FROM sources),
/* One level times its weight for each source, or twice its size: the level at which these sum to the share lies before the first end that exceeds it. */
sums AS (SELECT x.ends_at, sum(least(2.0 * y.source_size, x.ends_at * y.weight)) AS given FROM (SELECT DISTINCT ends_at FROM ends) x CROSS JOIN ends y GROUP BY x.ends_at),
upper AS (SELECT min(ends_at) AS ends_at FROM sums WHERE given >= (SELECT 1.5 * sum(source_size) FROM ends)),
level AS (SELECT ((SELECT 1.5 * sum(source_size) FROM ends) - coalesce(sum(2.0 * e.source_size) FILTER (WHERE e.ends_at < u.ends_at), 0)) / sum(e.weight) FILTER (WHERE e.ends_at >= u.ends_at) AS level FROM ends e, upper u)
SELECT doc_id, size, source_size, round(CAST(least(2.0 * source_size, coalesce(level * weight, 2.0 * source_size)) AS DOUBLE), 3) AS target
FROM sized JOIN ends ON sized.source IS NOT DISTINCT FROM ends.source, level
""",
}
