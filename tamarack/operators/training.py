"""Training pairs, hard negatives and margins from runs and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators.ranking import first_by, top_k


def pairs(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, doc_id, query, passage) of the judgements from grade 1 whose query and document exist."""
    d = qrels.where("score >= 1").join(queries.select("qid", F.col("text").alias("query")), "qid")
    return d.join(corpus.select("doc_id", F.col("text").alias("passage")), "doc_id").select("qid", "doc_id", "query", "passage")


def hard_negatives(run: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, rank): the best k of a run, without positives."""
    return top_k(run, ["qid"], [F.desc("score"), F.asc("doc_id")], k).join(positives.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").select("qid", "doc_id", "rank")


def margin_negatives(scored: DataFrame, positives: DataFrame, margin: float, per_system: int) -> DataFrame:
    """(qid, doc_id, system, ce) from (qid, doc_id, system, place, ce): negatives whose score is at least ``margin`` below the
    lowest positive's, each document under the first system that has it, at most ``per_system`` of each system."""
    low = positives.groupBy("qid").agg((F.min("ce") - margin).alias("limit"))
    d = scored.join(low, "qid").where(F.col("ce") <= F.col("limit")).drop("limit")
    d = first_by(d, ["qid", "doc_id"], [F.asc("system"), F.asc("place")])
    return top_k(d, ["qid", "system"], [F.asc("place"), F.asc("doc_id")], per_system, "__r").drop("__r")


def margin_labels(scored: DataFrame, positives: DataFrame) -> DataFrame:
    """(qid, pos, neg, label): score of the positive less that of the negative."""
    p = positives.select("qid", F.col("doc_id").alias("pos"), F.col("score").alias("ps"))
    n = scored.select("qid", F.col("doc_id").alias("neg"), F.col("score").alias("ns"))
    return p.join(n, "qid").where("pos <> neg").select("qid", "pos", "neg", F.round(F.col("ps") - F.col("ns"), 6).alias("label"))


def margin_mse(delta: Column, label: Column) -> Column:
    return F.avg((delta - label) * (delta - label))


def generated_queries(passages: DataFrame, questions: Column) -> DataFrame:
    """(qid, doc_id, query): distinct trimmed questions of each passage, ids ``genQn`` by document and place."""
    from tamarack.operators.structure import running_ids

    d = passages.select("doc_id", F.posexplode(F.array_distinct(F.filter(F.transform(questions, lambda q: F.trim(q)), lambda q: q != ""))).alias("at", "query"))
    return running_ids(d, ["doc_id", "at"], "n").select(F.concat(F.lit("genQ"), F.col("n").cast("string")).alias("qid"), "doc_id", "query")


def expansion_terms(top: Column, own: Column, stop: Column) -> Column:
    """Terms to add to a passage: the suggested ones less its own and the stop words."""
    return F.array_except(F.array_except(top, own), stop)


def without_repeats(df: DataFrame, order: list[str]) -> DataFrame:
    """Triplets (query, pos, neg), each once; the first in the order stays."""
    return first_by(df, ["query", "pos", "neg"], [F.asc(c) for c in order])


def batches_without_duplicates(df: DataFrame, size: int, key: str) -> DataFrame:
    """Add ``batch``: rows of equal ``key`` are in different batches, at most about ``size`` in each (by hash)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*df.columns))) - 1
    total = max(1, df.count() // size)
    return df.withColumn("batch", F.pmod(F.xxhash64(key) + n, F.lit(total)))
