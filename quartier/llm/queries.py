"""Registered queries of the text operators, and their checking SQL where SQL can express them."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.llm import bpe, bursttrie, centroids, credentials, exact, langid, lm, minhash, mixing, pii, quality, simhash, toxicity
from quartier.llm.common import documents, id_remainder


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_pairs(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir))
    number = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return found.select(
        "doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN, ids=False)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir), digest=True).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def op5_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = id_remainder(3) == 1
    told = langid.predict_languages(docs, langid.fit_languages(docs.where(~held_out)))
    return told.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken")
    )


def op7_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = id_remainder(4) == 2
    given = labels.where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = quality.quality_scores(documents(spark, sf_dir), given)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = id_remainder(7) == 2
    scored = lm.likelihoods(docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    graded = toxicity.toxicity_grades(docs, toxicity.fit_toxicity(docs, labels))
    return graded.select(
        "doc_id", "toxicity.severity", "toxicity.grade", "toxicity.chance", (F.col("toxicity.chance") >= 0.5).cast("int").alias("toxic")
    )


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursttrie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find_secrets(documents(spark, sf_dir))
    number = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return found.select(
        "doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(credentials.KINDS[: credentials.RULES])],
        F.sha2(credentials.span_text(F.col("base")), 256).alias("base_sha256"), credentials.span_text(F.col("spans")).alias("spans"),
    )


def op13_native_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters_with_inertia(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_order_minhash, op2_pii, op3_byte_bpe, op4_exact_dedup, op5_language_codes, op6_source_mix, op7_fourier_quality,
        op8_recurrent_lm, op9_ordinal_toxicity, op10_simhash_bktree, op11_burst_trie, op12_credential_links, op13_native_centroids, pipeline,
    )
}

#: CRC-32 of an id's decimal digits, bit by bit.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
)
_ROUNDS = "".join(
    f"""near{i} AS MATERIALIZED (
  SELECT r, min((d, k)) AS best FROM (
    SELECT v.r, c.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM parts v JOIN c{i} c USING (i) GROUP BY v.r, c.k
  ) GROUP BY r
), """ + (f"""c{i + 1} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT n.best[2] AS k, v.i, floor((sum(v.x) - (sum(v.x) % count(*) + count(*)) % count(*)) / count(*))::BIGINT AS x
    FROM near{i} n JOIN parts v USING (r) GROUP BY 1, 2
  ) m USING (k, i)
), """ if i < 5 else "") for i in range(6)
)

ORACLE = {
    "op11_burst_trie": rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, ({_CRC.format("conv_id")} % 4)::BIGINT AS h FROM turns
), rebuilt AS (
  SELECT i.conv_id, 0 AS part, t.p, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 20 AND t.p <= i.h
  UNION ALL SELECT i.conv_id, 1, t.p, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.p > i.h
), numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, sha256(concat(length(role), ':', role, text)) AS t,
    len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM rebuilt
), members AS (
  SELECT conv_id, d, list(t) OVER w AS path, words FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, [], 0 FROM ids
), ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, d) AS path FROM members GROUP BY conv_id) GROUP BY path
), nodes AS (
  SELECT path, len(path) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM members GROUP BY path
), children AS (
  SELECT path[:-2] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), above AS (
  SELECT n.path, n.path[:i] AS top, (n.n - 1) * n.words AS saved, c.n IS NULL AS leaf
  FROM nodes n LEFT JOIN children c USING (path), unnest(range(0, n.depth + 1)) AS u(i)
), sums AS (
  SELECT top AS path, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM above GROUP BY top
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (path) LEFT JOIN children c USING (path) LEFT JOIN ends e USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:-2]""",
    "op13_native_centroids": f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), parts AS MATERIALIZED (
  SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept
), c0 AS MATERIALIZED (
  SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (
    SELECT v, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k FROM kept
  ) WHERE k < 40
), {_ROUNDS}found AS (
  SELECT k.vec_id, n.best[2] AS cluster, n.best[1] AS distance FROM near5 n JOIN kept k USING (r)
), names AS (
  SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c5 GROUP BY k
)
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM found JOIN names ON names.k = found.cluster""",
    "op4_exact_dedup": r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), groups AS (
  SELECT h, count(*) AS group_size, max(n) AS most FROM rows GROUP BY h
), keep AS (
  SELECT r.h, min(r.doc_id) AS keep_id FROM rows r JOIN groups g ON g.h = r.h AND g.most = r.n GROUP BY r.h
)
SELECT r.doc_id, k.keep_id, g.group_size, r.doc_id = k.keep_id AS kept, r.h AS text_sha256
FROM rows r JOIN groups g ON g.h = r.h JOIN keep k ON k.h = r.h""",
    "op6_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3] AS w FROM sized GROUP BY source
), ordered AS (
  -- sources reach their cap in this order as the common level rises
  SELECT *, 2.0 * n / w AS cap_level,
    coalesce(sum(2.0 * n) OVER (ORDER BY 2.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY 2.0 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM sources
), level AS (
  SELECT max((1.5 * (SELECT sum(n) FROM sources) - capped) / weight_left) FILTER ((1.5 * (SELECT sum(n) FROM sources) - capped) / weight_left <= cap_level) AS level FROM ordered
), budgets AS (
  SELECT source, n, least(2.0 * n, w * level) AS target, CASE WHEN n > 0 THEN floor(least(2.0 * n, w * level) / n) ELSE 0 END AS whole FROM sources, level
), ranked AS (
  SELECT s.*, b.n AS source_size, b.target, b.whole, b.target - b.whole * b.n AS rest,
    sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY s.source, h) AS own
  FROM sized s JOIN budgets b ON b.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND 2 * (rest - (upto - own)) >= own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked""",
}
