"""Top-k, deduplication and fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank as ``rank``; partial top-k happens before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def better(metric: str, score: str) -> Column:
    """Order of a score from the best on: distances (l2, hamming) rise, all others fall."""
    return F.asc(score) if metric.lower() in ("l2", "euclidean", "hamming") else F.desc(score)


def shuffled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The first n rows of a shuffle by a hash of seed and key; the same for the same seed."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def first_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    return top_k(df, by, order, 1, "__rank").drop("__rank")


def merge_bundles(hits: DataFrame, k: int, over_fetch: int | None = None, positive: bool = True) -> DataFrame:
    """(qid, rank, doc_id, score, text) from (qid, bundle, doc_id, score, text) of several indexes: the best
    ``over_fetch`` of each bundle, without scores up to 0 where ``positive``, blank texts dropped, of equal texts the best, k in
    all. Queries with fewer hits have fewer rows (see ``padded``)."""
    over = over_fetch or max(20 * k, 50)
    d = top_k(hits, ["qid", "bundle"], [F.desc("score"), F.asc("doc_id")], over, "__r").drop("__r")
    d = d.where(F.length(F.trim("text")) > 0)
    d = d.where("score > 0") if positive else d
    d = first_by(d, ["qid", "text"], [F.desc("score"), F.asc("doc_id")])
    return top_k(d, ["qid"], [F.desc("score"), F.asc("doc_id")], k).select("qid", "rank", "doc_id", "score", "text")


def padded(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Exactly k rows for each query; missing ones have an empty text and score 0."""
    slots = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")).withColumn("rank", F.col("rank").cast("long"))
    return slots.join(hits, ["qid", "rank"], "left").withColumns({"text": F.coalesce("text", F.lit("")), "score": F.coalesce("score", F.lit(0.0))})


def reciprocal_rank_fusion(runs: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """An extension: (qid, doc_id, rank, score) of several runs (qid, doc_id, rank), score = sum of 1 / (constant + rank)."""
    d = runs.groupBy("qid", "doc_id").agg(F.round(F.sum(1.0 / (F.col("rank") + constant)), 8).alias("score"))
    return top_k(d, ["qid"], [F.desc("score"), F.asc("doc_id")], k)


def excluding(run: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
    """A run without excluded (qid, doc_id), ranked anew."""
    d = run.drop("rank").join(excluded, ["qid", "doc_id"], "left_anti")
    return top_k(d, ["qid"], [F.desc("score"), F.asc("doc_id")], k)


def pooled(run: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Documents that are among any query's first k: the pool that all queries are searched on again."""
    return corpus.join(run.where(F.col("rank") <= k).select("doc_id").distinct(), "doc_id", "left_semi")


def judged_sample(corpus: DataFrame, judged: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """All judged documents and, up to n in all, others in the order of a hash of their key. Nothing is sorted as a whole:
    the hash's first digits are counted, and only the documents of the digits in which the quota ends are ranked."""
    flagged = corpus.join(judged.select(key).distinct().withColumn("__judged", F.lit(True)), key, "left")
    digest = F.md5(F.col(key).cast("string"))
    d = flagged.withColumns({"__h": digest, "__b": F.substring(digest, 1, 3)})
    counts = d.groupBy("__b").agg(F.count(F.when(F.col("__judged"), 1)).alias("must"), F.count(F.when(F.col("__judged").isNull(), 1)).alias("rest")).orderBy("__b").collect()
    left, last = n - sum(r["must"] for r in counts), ""
    for r in counts:  # at most 4,096 rows
        last = r["__b"]
        if left <= r["rest"]:
            break
        left -= r["rest"]
    else:
        last = "~"  # the quota holds all
    ends = d.where(F.col("__judged").isNull() & (F.col("__b") == last))
    ends = top_k(ends.withColumn("__g", F.lit(0)), ["__g"], [F.asc("__h"), F.asc(key)], max(0, left), "__r")
    before = d.where(F.col("__judged") | (F.lit(left >= 0) & (F.col("__b") < last)))
    return before.select(*corpus.columns).unionByName(ends.select(*corpus.columns))


def nested(run: DataFrame, corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, question, paragraphs): the hits of each query in rank order with their text and whether they are relevant."""
    d = run.join(corpus.select("doc_id", "text"), "doc_id").join(qrels.select("qid", "doc_id", F.col("score").alias("rel")), ["qid", "doc_id"], "left")
    item = F.struct((F.col("rank") - 1).alias("idx"), F.col("doc_id"), F.col("text").alias("paragraph_text"), F.coalesce(F.col("rel") > 0, F.lit(False)).alias("is_supporting"))
    return d.groupBy("qid").agg(F.sort_array(F.collect_list(item)).alias("paragraphs")).join(queries.select("qid", F.col("text").alias("question")), "qid")
