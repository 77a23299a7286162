"""The operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fmindex, infill, lines, media, mixing, negatives, packing, quality, sharding, simhash, suffixes, topk, toxicity
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), 16)


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(read(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op6_source_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), told AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, text_key) - 1 AS nth FROM sized
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 2.0e0 AS cap,
    [5.0e0, 2.0e0, 1.0e0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sums
), walked AS (
  SELECT *, (sum(source_size) OVER ()) * 1.5e0
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighed
), levels AS (
  SELECT *, max(left_over / rest) OVER () AS level FROM walked
), goals AS (
  SELECT source, source_size, least(cap, weight * level) AS target FROM levels
), rated AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5(concat_ws(':', '42', coalesce(CAST(d.doc_id AS VARCHAR), 'null'), text_key, CAST(nth AS VARCHAR))), 1, 13)) AS BIGINT) / 4503599627370496.0e0 AS draw
  FROM told d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""


@query
def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages as text: first word + number of words, in order."""
    found = suffixes.passages(read(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("passages", lambda p: F.concat_ws("+", p["start"].cast("string"), p["length"].cast("string"))), ",")
    return found.select("doc_id", "other_doc_id", "n_words", listed.alias("passages"))


ORACLES["op3_suffix_array_dedup"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM split WHERE len(w) >= 50)
), shared AS (
  SELECT h, min(doc_id) AS least, max(doc_id) AS most FROM windows GROUP BY h HAVING min(doc_id) <> max(doc_id)
), matched AS (
  SELECT doc_id, i, CASE WHEN least < doc_id THEN least ELSE most END AS other FROM windows JOIN shared USING (h)
), opened AS (
  SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, other ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM matched
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id, other ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM opened
), runs AS (
  SELECT doc_id, other, min(i) - 1 AS start, max(i) - min(i) + 50 AS length FROM numbered GROUP BY doc_id, other, run
)
SELECT doc_id, other AS other_doc_id, CAST(sum(length) AS BIGINT) AS n_words, string_agg(start || '+' || length, ',' ORDER BY start) AS passages FROM runs GROUP BY doc_id, other
"""


@query
def op10_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op10_fm_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM split WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM placed
), firsts AS (
  SELECT h, min(doc_id) AS least FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE least < doc_id) x, range(0, 50) t(j)
), lists AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), kept AS (
  SELECT s.doc_id, len(s.w) AS n, coalesce(len(l.ps), 0) AS r,
    CASE WHEN l.ps IS NULL THEN s.w ELSE list_filter(s.w, lambda e, i: NOT list_contains(l.ps, i)) END AS k
  FROM (SELECT * FROM split) s LEFT JOIN lists l USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


@query
def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "quality", 0.3)


@query
def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "toxic", 0.5)


@query
def op5_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


ORACLES["op5_threshold_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.n <> c.n
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op9_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(read(spark, sf_dir, "documents"))


@query
def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


@query
def op11_vantage_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", turned), F.col("vec_id") % 100 == 0)


ORACLES["op11_vantage_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.n, q.vec_id AS anchor_id, c.vec_id, c.label = q.label AS same, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.n <> c.n
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS nth FROM pairs WHERE same) WHERE nth <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.n, p.nth ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN pairs s ON p.n = s.n AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


@query
def op12_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.dedup(read(spark, sf_dir, "documents"), 10)
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op12_cuckoo_lines"] = r"""
WITH split AS (
  SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), placed AS (
  SELECT n, doc_id, i, lines[i] AS line,
    translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT n, doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM split)
), common AS (
  SELECT key FROM (SELECT DISTINCT doc_id, key FROM placed WHERE key <> '') GROUP BY key HAVING count(*) >= 10
), told AS (
  SELECT p.*, c.key IS NOT NULL AS gone FROM placed p LEFT JOIN common c ON p.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY n, doc_id
"""


@query
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transformed(read(spark, sf_dir, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLES["op13_infill"] = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), drawn AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
    n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 AS plain,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 AS turned FROM hashed
), cut AS (
  SELECT *, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, abs(a - b)) AS m, substr(t, greatest(a, b) + 1) AS s FROM drawn
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN turned THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN least(a, b) END AS prefix_chars, CASE WHEN NOT plain THEN abs(a - b) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN turned THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""
