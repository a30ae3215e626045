"""Queries of vector search: every vector whose id is divisible by 20 is a query, against all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import dense, ranking
from tamarack.plans import sql as S
from tamarack.plans.registry import query, table


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "v", "label")


def exact(spark: SparkSession, d: str, k: int = 10, score: dense.Score = dense.dot_scores) -> DataFrame:
    return dense.search(corpus(spark, d), asked(spark, d), k, score)


@query(f"WITH {S.nearest(S.DOT)} SELECT * FROM run")
def dense_exact_dot(spark, d):
    return exact(spark, d)


@query(f"WITH {S.nearest('list_cosine_similarity(qv, v)')} SELECT * FROM run")
def dense_exact_cosine(spark, d):
    return exact(spark, d, score=dense.cosine_scores)


@query(f"WITH {S.nearest('1 / (1 + list_inner_product(qv, qv) + list_inner_product(v, v) - 2 * list_inner_product(qv, v))')} SELECT * FROM run")
def dense_l2_similarity(spark, d):
    return exact(spark, d, score=dense.l2_scores)


@query(f"WITH {S.nearest('list_inner_product(qv, v) / sqrt(list_inner_product(v, v))')} SELECT * FROM run")
def sgpt_norm_topk(spark, d):
    return exact(spark, d, score=dense.norm_dot_scores)


@query(f"WITH {S.VECTORS}, s AS (SELECT qid, doc_id, round({S.DOT}, 6) AS score FROM qv, v WHERE qid <> doc_id AND label = ql) {S.top('s', 5)}")
def category_filtered_knn(spark, d):
    """Only vectors of the query's own class: one search, with the class as a filter."""
    return dense.search(corpus(spark, d), asked(spark, d), 5, group="label")


@query(
    f"""WITH {S.VECTORS}, c AS (SELECT *, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END) AS code FROM v),
    h AS (SELECT qid, doc_id, qv, c.code, (64 - list_inner_product(list_transform(qv, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END), c.code)) / 2 AS far FROM qv, c WHERE qid <> doc_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY far, doc_id) AS r FROM h),
    s AS (SELECT qid, doc_id, round(list_inner_product(qv, code), 6) AS score FROM n WHERE r <= 1000) {S.top("s", 10)}"""
)
def dense_binary_rerank(spark, d):
    return dense.binary_search(corpus(spark, d), asked(spark, d), 10, 1000)


@query(
    f"""WITH {S.VECTORS}, b AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT unnest(v) AS x FROM v))
    SELECT doc_id, array_to_string(list_transform(v, lambda x: floor((x - lo) / (hi - lo) * 255 + 0.5)::BIGINT), ',') AS code FROM v, b"""
)
def dense_sq8(spark, d):
    c = corpus(spark, d)
    lo, hi = c.select(F.explode("v").alias("x")).select(F.col("x").cast("double").alias("x")).agg(F.min("x"), F.max("x")).first()
    code = dense.sq8(F.col("v"), F.lit(lo), F.lit(hi))
    return c.select("doc_id", F.array_join(F.transform(code, lambda x: x.cast("string")), ",").alias("code"))


@query(f"WITH {S.VECTORS}, m AS (SELECT max(sqrt(list_inner_product(v, v))) AS longest FROM v) SELECT doc_id, round(sqrt(greatest(0, longest * longest - list_inner_product(v, v))), 4) AS extra FROM v, m")
def dense_mips_augment(spark, d):
    c = corpus(spark, d)
    longest = c.agg(F.max(F.sqrt(dense.vector_dot(F.col("v"), F.col("v"))))).first()[0]
    return c.select("doc_id", F.round(F.element_at(dense.augmented(F.col("v"), F.lit(longest)), -1), 4).alias("extra"))


@query(f"WITH {S.VECTORS} SELECT doc_id, pos - 1 AS place, round(v[pos] / sqrt(list_inner_product(v, v)), 5) AS value, CASE WHEN v[pos] > 0 THEN 1 ELSE 0 END::BIGINT AS bit FROM (SELECT *, unnest(range(1, len(v) + 1)) AS pos FROM v)")
def dense_normalize(spark, d):
    both = F.arrays_zip(dense.normalized(F.col("v")).alias("n"), dense.bit_code(F.col("v")).alias("b"))
    c = corpus(spark, d).select("doc_id", F.posexplode(both).alias("place", "x"))
    return c.select("doc_id", F.col("place").cast("long").alias("place"), F.round("x.n", 5).alias("value"), F.col("x.b").cast("long").alias("bit"))


@query(
    f"""WITH {S.VECTORS}, s AS (SELECT qid, label % 3 AS bundle, doc_id, round({S.DOT}, 6) AS score FROM qv, v WHERE qid <> doc_id),
    b AS ({S.top("s", 50, "qid, bundle")}) {S.top("(SELECT qid, doc_id, score FROM b)", 10)}"""
)
def dense_bundle_merge(spark, d):
    """Three indexes searched apart and merged."""
    c, q = corpus(spark, d), asked(spark, d)
    parts = [dense.search(c.where(F.col("label") % 3 == i), q, 50) for i in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("rank")
    return ranking.top_k(merged, ["qid"], [F.desc("score"), F.asc("doc_id")], 10)


@query()
def dense_ivf_topk(spark, d):
    return dense.ivf_search(corpus(spark, d), asked(spark, d), 10, probes=64)


@query()
def dense_pq_topk(spark, d):
    return dense.pq_search(corpus(spark, d), asked(spark, d), 10)


@query()
def dense_pca_topk(spark, d):
    return dense.pca_search(corpus(spark, d), asked(spark, d), 10)


@query(f"WITH {S.VECTORS} SELECT doc_id, pos - 1 AS place, round((v[pos] + 2 * v[pos + 16] + 3 * v[pos + 32] + 4 * v[pos + 48]) / 10, 6) AS pooled FROM (SELECT *, unnest(range(1, 17)) AS pos FROM v)")
def weighted_mean_pooling(spark, d):
    """The whole vector as four states of sixteen components, weighted by their places."""
    states = F.array(*(F.slice("v", 16 * i + 1, 16) for i in range(4)))
    pooled = dense.weighted_mean_pool(states, F.array(*[F.lit(1.0)] * 4))
    return corpus(spark, d).select("doc_id", F.posexplode(pooled).alias("place", "x")).select("doc_id", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("pooled"))
