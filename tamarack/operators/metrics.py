"""Ranking and answer metrics, all cut-offs at once.

A run is (qid, doc_id, score) with one row for each pair, judgements are (qid, doc_id, score) with whole grades. Ranks go by
falling score; ties by falling id as a string in ``rank_metrics``, as the standard evaluation program has it, else by
rising id. ``ks`` are the cut-offs; values are rounded to five places. Queries without a
judgement are left out (and those without a relevant one where a metric would divide by their number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import normalize_answer
from tamarack.operators.ranking import top_k


def _ranked(run: DataFrame, qrels: DataFrame, ks: list[int], tie: Column | None = None) -> DataFrame:
    r = top_k(run.select("qid", "doc_id", "score"), ["qid"], [F.desc("score"), F.asc("doc_id") if tie is None else tie], max(ks))
    r = r.join(qrels.select("qid").distinct(), "qid", "left_semi")
    return r.join(qrels.select("qid", "doc_id", F.col("score").alias("rel")), ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def _by_k(d: DataFrame, ks: list[int]) -> DataFrame:
    return d.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).withColumn("in_k", F.col("rank") <= F.col("k"))


def rank_metrics(run: DataFrame, qrels: DataFrame, ks: list[int], ignore_identical_ids: bool = True) -> DataFrame:
    """(k, ndcg, map, recall, precision): means over the queries that are both in the run and judged. A document with the
    query's own id is no hit, unless ``ignore_identical_ids`` is off."""
    if ignore_identical_ids:
        run = run.where(F.col("qid").cast("string") != F.col("doc_id").cast("string"))
    r = _ranked(run, qrels, ks, F.desc(F.col("doc_id").cast("string")))
    w = Window.partitionBy("qid").orderBy("rank")
    r = r.withColumn("hits", F.sum((F.col("rel") >= 1).cast("int")).over(w))
    ideal = qrels.where("score >= 1").withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"))))
    best = ideal.select("qid", "i", F.explode(F.array(*(F.lit(k) for k in ks))).alias("k"), "score")
    best = best.groupBy("qid", "k").agg(F.sum(F.when(F.col("i") <= F.col("k"), F.col("score") / F.log2(F.col("i") + 1.0))).alias("idcg"), F.count("*").alias("relevant"))
    rel = F.col("in_k") & (F.col("rel") >= 1)
    q = _by_k(r, ks).groupBy("qid", "k").agg(
        F.coalesce(F.sum(F.when(F.col("in_k"), F.col("rel") / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.sum(F.when(rel, F.col("hits") / F.col("rank"))), F.lit(0.0)).alias("ap"), F.sum(rel.cast("int")).alias("found"),
    )
    q = q.join(best, ["qid", "k"], "left")
    mean = lambda x: F.round(F.avg(F.coalesce(x, F.lit(0.0))), 5)
    return q.groupBy(F.col("k").cast("long").alias("k")).agg(
        mean(F.try_divide("dcg", "idcg")).alias("ndcg"), mean(F.try_divide("ap", "relevant")).alias("map"),
        mean(F.try_divide("found", "relevant")).alias("recall"), mean(F.col("found") / F.col("k")).alias("precision"),
    )


def judged_metrics(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """(k, mrr, r_cap, accuracy): sums divided by the number of all judged queries."""
    n = qrels.select("qid").distinct().count()
    relevant = qrels.where("score >= 1").groupBy("qid").agg(F.count("*").alias("relevant"))
    rel = F.col("in_k") & (F.col("rel") >= 1)
    q = _by_k(_ranked(run, qrels, ks), ks).groupBy("qid", "k").agg(F.min(F.when(rel, F.col("rank"))).alias("first"), F.sum(rel.cast("int")).alias("found")).join(relevant, "qid", "left")
    part = lambda x: F.round(F.sum(F.coalesce(x, F.lit(0.0))) / max(1, n), 5)
    return q.groupBy(F.col("k").cast("long").alias("k")).agg(
        part(F.try_divide(F.lit(1.0), "first")).alias("mrr"), part(F.try_divide("found", F.least("relevant", "k"))).alias("r_cap"),
        part((F.col("found") > 0).cast("double")).alias("accuracy"),
    )


def hole(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """(k, hole): share of the first k documents that nobody judged for any query, divided by k even where there are fewer."""
    n = qrels.select("qid").distinct().count()
    r = top_k(run.select("qid", "doc_id", "score"), ["qid"], [F.desc("score"), F.asc("doc_id")], max(ks)).join(qrels.select("qid").distinct(), "qid", "left_semi")
    r = r.join(qrels.select("doc_id").distinct().withColumn("judged", F.lit(True)), "doc_id", "left")
    d = _by_k(r, ks).where("in_k")
    return d.groupBy(F.col("k").cast("long").alias("k")).agg(F.round(F.sum(F.when(F.col("judged").isNull(), 1.0).otherwise(0.0)) / F.max("k") / max(1, n), 5).alias("hole"))


#: Names under which a metric can be asked for, and the column that holds it.
ALIASES = {
    "mrr": "mrr", "mrr@k": "mrr", "mrr_cut": "mrr", "recall_cap": "r_cap", "r_cap": "r_cap", "r_cap@k": "r_cap",
    "hole": "hole", "hole@k": "hole", "acc": "accuracy", "top_k_acc": "accuracy", "accuracy": "accuracy", "accuracy@k": "accuracy", "top_k_accuracy": "accuracy",
}


def custom_metric(run: DataFrame, qrels: DataFrame, ks: list[int], name: str) -> DataFrame | None:
    """(k, value) of the metric of that name in any case; null where there is none."""
    column = ALIASES.get(name.lower())
    if column is None:
        return None
    return (hole if column == "hole" else judged_metrics)(run, qrels, ks).select("k", F.col(column).alias("value"))


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("long")


def token_f1(prediction: Column, gold: Column) -> Column:
    """struct(f1, precision, recall) of the normalised tokens, as multisets. All 0 where nothing is shared, or where one side is
    yes, no or noanswer and the other differs."""
    both = F.struct(normalize_answer(F.coalesce(prediction, F.lit(""))).alias("p"), normalize_answer(F.coalesce(gold, F.lit(""))).alias("g"))
    # bound to a variable by an outer transform, else the texts would be normalised again for each token
    return F.transform(F.array(both), lambda x: F.transform(F.array(F.struct(x["p"].alias("p"), x["g"].alias("g"), F.split(x["p"], " ").alias("wp"), F.split(x["g"], " ").alias("wg"))), _f1)[0])[0]


def _f1(x: Column) -> Column:
    p, g = x["p"], x["g"]
    words = lambda t: F.filter(t, lambda x: x != "")
    n = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    wp, wg = words(x["wp"]), words(x["wg"])
    same = F.aggregate(F.array_distinct(wp), F.lit(0), lambda s, x: s + F.least(n(wp, x), n(wg, x)))
    flag = ("yes", "no", "noanswer")
    off = (p.isin(*flag) | g.isin(*flag)) & (p != g)
    share = lambda a: F.when(off | (same == 0), 0.0).otherwise(F.try_divide(same, F.size(a)))
    pr, re = share(wp), share(wg)
    return F.struct(F.coalesce(F.try_divide(2 * pr * re, pr + re), F.lit(0.0)).alias("f1"), pr.alias("precision"), re.alias("recall"))


def best_answer(df: DataFrame, by: list[str], prediction: str, gold: str) -> DataFrame:
    """Over several golds for each key: the best match, f1, precision and recall, each for itself."""
    f = token_f1(F.col(prediction), F.col(gold))
    d = df.select(*by, exact_match(F.col(prediction), F.col(gold)).alias("em"), f.alias("f"))
    return d.groupBy(*by).agg(F.max("em").alias("em"), *(F.round(F.max(f"f.{x}"), 5).alias(x) for x in ("f1", "precision", "recall")))
