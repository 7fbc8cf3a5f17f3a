"""The registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, common, hard_negatives, html_text, line_dedup, mixing, ngram_join, packing, passages, pii, quality, spotsigs, topk, toxicity


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, pii.PATTERNS), F.sha2(pii.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.span_list(F.concat("base", "extra")).alias("spans")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs.fingerprint_edits(common.table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), spotsigs.as_text(F.col("signature")).alias("fingerprint"),
        spotsigs.as_text(F.col("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(common.table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    pieces = packing.tokenize(docs, *tokenizer_paths())
    return packing.pack(pieces, packing.about_pieces(docs))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.find(common.table(spark, sf_dir, "documents"))
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_words", words(F.col("repeated")).alias("n_repeated"), words(F.col("dropped")).alias("n_dropped"), listed(F.col("repeated")).alias("spans"), listed(F.col("dropped")).alias("dropped_spans"), "class_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    books = codebooks.train(vectors)
    out = codebooks.with_label_error(codebooks.encode(vectors, books))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(common.table(spark, sf_dir, "embeddings").withColumn("label", moved), "vec_id % 50 = 0")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, (2 * source_size)::DOUBLE AS cap,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum((2 * source_size)::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / w, source IS NULL, source)),
l AS (SELECT min_by(level, cap / w) FILTER (level * w < cap) AS common_level FROM r),
t AS (
  SELECT source, source_size, CASE WHEN level * w < cap THEN common_level * w ELSE cap END AS target FROM r, l),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
c AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, d.source, q.epochs, greatest(round(q.target)::BIGINT - q.epochs * q.source_size, 0) AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken, source FROM c
"""

OP7_SQL = r"""
WITH l AS (
  SELECT rid, doc_id, i, line, regexp_replace(translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '', '') AS key
  FROM (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT key, max(coalesce(doc_id, -9223372036854775808)) AS keep FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.rid, l.doc_id, l.i, l.line, coalesce(coalesce(l.doc_id, -9223372036854775808) < k.keep, false) AS gone FROM l LEFT JOIN k USING (key))
GROUP BY rid
"""

OP9_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, e FROM v WHERE vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY e) = 1),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def _op11_sql(parts: int = codebooks.PARTS, entries: int = codebooks.ENTRIES, rounds: int = codebooks.ROUNDS, scale: int = codebooks.SCALE) -> str:
    """All rounds one after the other: k<r> has the entries before round r, a<r> the parts' entries by them."""
    nearest = """
a{r} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d
  FROM (SELECT x.rid, x.part, k.entry, (x.n + k.n - 2 * list_inner_product(x.v, k.v))::BIGINT AS d FROM x JOIN k{r} k USING (part)) GROUP BY rid, part)"""
    moved = """
k{s} AS MATERIALIZED (
  SELECT part, entry, v, list_inner_product(v, v) AS n FROM (
    SELECT k.part, k.entry, coalesce(m.v, k.v) AS v FROM k{r} k LEFT JOIN (
      SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY pos) AS v
      FROM (SELECT part, entry, pos, sum(c)::BIGINT AS s, count(*)::BIGINT AS n
            FROM (SELECT x.part, a.entry, unnest(x.v)::BIGINT AS c, unnest(range(len(x.v))) AS pos FROM x JOIN a{r} a USING (rid, part)) GROUP BY part, entry, pos)
      GROUP BY part, entry) m USING (part, entry)))"""
    steps = "".join(f"{nearest.format(r=r)},{moved.format(r=r, s=r + 1)}," for r in range(rounds)) + nearest.format(r=rounds)
    return f"""
WITH u AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS rid, vec_id, label, e
  FROM (SELECT vec_id, label, embedding, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)) AS e FROM embeddings)
  WHERE len(e) > 0 AND len(e) % {parts} = 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(e, lambda c: abs(c) > 1048576)) = 0),
w AS (SELECT len(e) AS dim FROM u WHERE rid = 1),
x AS MATERIALIZED (
  SELECT rid, part, v, list_inner_product(v, v) AS n
  FROM (SELECT rid, part, e[part * dim // {parts} + 1 : (part + 1) * dim // {parts}] AS v FROM u JOIN w ON len(e) = dim, (SELECT unnest(range({parts})) AS part))),
k0 AS MATERIALIZED (SELECT part, rank - 1 AS entry, v, n FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY rid) AS rank FROM x WHERE rid <= {entries})),{steps},
h AS (SELECT coalesce(sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)), sha256('')) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS c, unnest(range(len(v))) AS pos FROM k{rounds})),
c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT u.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY u.label))::BIGINT AS label_error, h.codebooks_sha256 FROM c JOIN u USING (rid), h
"""


OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, e) = 1),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score
  FROM a JOIN v ON len(v.e) = len(a.e) AND (a.label <> v.label OR a.vec_id <> v.vec_id)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS p FROM s WHERE same QUALIFY p <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.p ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

QUERIES = {"op1_pii": op1_pii, "op3_toxicity": op3_toxicity, "op4_spotsigs": op4_spotsigs, "op8_html_extraction": op8_html_extraction, "op9_exact_top_k": op9_exact_top_k, "op10_substring_dedup": op10_substring_dedup, "op2_best_fit_packing": op2_best_fit_packing, "op5_ngram_join": op5_ngram_join, "op6_source_mixing": op6_source_mixing, "op7_line_dedup": op7_line_dedup, "op11_vector_codes": op11_vector_codes, "op12_hard_negatives": op12_hard_negatives, "op13_quality": op13_quality}
ORACLE_SQL = {"op9_exact_top_k": OP9_SQL, "op6_source_mixing": OP6_SQL, "op7_line_dedup": OP7_SQL, "op11_vector_codes": _op11_sql(), "op12_hard_negatives": OP12_SQL}
