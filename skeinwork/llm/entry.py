"""The queries of this subpackage: name -> function of (spark, folder of tables), and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import licenses, lm_scoring, mixing, nb_svm, near_dedup, packing, pii, quality_rules, store, topk
from skeinwork.llm.common import scratch_path

#: Public vocabulary files, by operator; the operators take any path.
PACKING_VOCABULARY, STORE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb_svm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary(PACKING_VOCABULARY))


def op5_gru_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), width=4)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    store.write(table(spark, sf_dir, "documents"), path, vocabulary(STORE_VOCABULARY))
    return store.checksums(spark, path)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_nb_svm_quality, op2_quality_rules, op3_license_scan, op4_best_two_fit, op5_gru_lm_score, op6_mix_sources, op7_exact_top_k, op8_minhash_near_dedup, op9_token_store, op10_personal_data)}

ORACLES = {
    "op6_mix_sources": """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s0),
s2 AS (SELECT *, ((n - 1) % 3) + 1 AS w, source_size * 3 AS cap FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS total_w,
              CAST(coalesce(sum(cap) OVER e, 0) AS BIGINT) AS caps, CAST(coalesce(sum(w) OVER e, 0) AS BIGINT) AS ws
       FROM s2 WINDOW e AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (total - caps) * w > cap * (total_w - ws) AS held FROM s3),
s5 AS (SELECT *, CAST(total - sum(CASE WHEN held THEN cap ELSE 0 END) OVER () AS BIGINT) AS rest,
              CAST(total_w - sum(CASE WHEN held THEN w ELSE 0 END) OVER () AS BIGINT) AS rest_w FROM s4),
s6 AS (SELECT source, source_size, cap, CASE WHEN held THEN CAST(cap AS DOUBLE)
              ELSE CAST(rest * w AS DOUBLE) / CAST(greatest(rest_w, 1) AS DOUBLE) END AS target FROM s5),
s7 AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), cap) AS budget FROM s6),
p AS (SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior FROM d)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE CAST((budget // source_size) * size + greatest(0, least(size, budget % source_size - prior)) AS BIGINT) END AS taken
FROM p JOIN s7 ON p.source IS NOT DISTINCT FROM s7.source""",
    "op7_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
