"""Ranking and answer metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamarack.functions.text import normalize_answer
from tamarack.operators import metrics
from tamarack.plans import sql as S
from tamarack.plans import vectors
from tamarack.plans.composition import qrels
from tamarack.plans.registry import query, table

KS = [1, 3, 5, 10]
_R = f"""WITH {S.nearest(S.DOT)}, {S.QRELS}, ks AS (SELECT unnest([1, 3, 5, 10])::BIGINT AS k),
    r AS (SELECT run.qid, run.doc_id, rank, row_number() OVER (PARTITION BY run.qid ORDER BY run.score DESC, CAST(run.doc_id AS VARCHAR) DESC) AS trec, coalesce(qrels.score, 0) AS rel FROM run LEFT JOIN qrels USING (qid, doc_id) WHERE run.qid IN (SELECT qid FROM qrels)),
    h AS (SELECT *, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM r),
    n AS (SELECT count(DISTINCT qid) AS n FROM qrels)"""
_IDEAL = """i AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS i FROM qrels),
    best AS (SELECT qid, k, sum(CASE WHEN i <= k THEN score / log2(i + 1) END) AS idcg, count(*) AS relevant FROM i, ks GROUP BY qid, k)"""


@query(f"""{_R.replace("ORDER BY rank) AS hits", "ORDER BY trec) AS hits")}, {_IDEAL}, q AS (SELECT qid, k, coalesce(sum(CASE WHEN trec <= k THEN rel / log2(trec + 1) END), 0) AS dcg,
    coalesce(sum(CASE WHEN trec <= k AND rel >= 1 THEN hits / trec::DOUBLE END), 0) AS ap, sum(CASE WHEN trec <= k AND rel >= 1 THEN 1 ELSE 0 END) AS found FROM h, ks GROUP BY qid, k)
    SELECT k, round(avg(coalesce(dcg / idcg, 0)), 5) AS ndcg, round(avg(coalesce(ap / relevant, 0)), 5) AS map, round(avg(coalesce(found / relevant::DOUBLE, 0)), 5) AS recall, round(avg(found / k::DOUBLE), 5) AS precision
    FROM q LEFT JOIN best USING (qid, k) GROUP BY k""")
def ndcg_map_recall_precision(spark, d):
    return metrics.rank_metrics(vectors.exact(spark, d), qrels(spark, d), KS)


@query(f"""{_R}, re AS (SELECT qid, count(*) AS relevant FROM qrels GROUP BY qid),
    q AS (SELECT qid, k, min(CASE WHEN rank <= k AND rel >= 1 THEN rank END) AS first, sum(CASE WHEN rank <= k AND rel >= 1 THEN 1 ELSE 0 END) AS found FROM h, ks GROUP BY qid, k)
    SELECT k, round(sum(coalesce(1.0 / first, 0)) / any_value(n), 5) AS mrr, round(sum(coalesce(found / least(relevant, k)::DOUBLE, 0)) / any_value(n), 5) AS r_cap, round(sum(CASE WHEN found > 0 THEN 1.0 ELSE 0 END) / any_value(n), 5) AS accuracy
    FROM q LEFT JOIN re USING (qid), n GROUP BY k""")
def mrr_recall_cap_accuracy(spark, d):
    return metrics.judged_metrics(vectors.exact(spark, d), qrels(spark, d), KS)


@query(f"""{_R}, j AS (SELECT DISTINCT doc_id FROM qrels WHERE score = 2)
    SELECT k, round(sum(CASE WHEN doc_id NOT IN (SELECT doc_id FROM j) THEN 1.0 ELSE 0 END) / k / any_value(n.n), 5) AS hole FROM run, ks, (SELECT count(DISTINCT qid) AS n FROM qrels WHERE score = 2) n
    WHERE rank <= k AND qid IN (SELECT qid FROM qrels WHERE score = 2) GROUP BY k""")
def hole_at_k(spark, d):
    return metrics.hole(vectors.exact(spark, d), qrels(spark, d).where("score = 2"), KS)


_PAIRS = """p AS (SELECT query_id, question AS gold, lag(question) OVER (PARTITION BY set_no, persona, difficulty ORDER BY idx, query_id) AS prediction
    FROM (SELECT DISTINCT query_id, set_no, persona, difficulty, idx, question FROM cdn_rag_queries))"""
_GONE = r"regexp_replace({}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(a|an|the)($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1 \3', 'g')"
#: Articles that follow one another share a boundary, hence twice.
_NORM = "list_filter(string_split_regex(" + _GONE.format(_GONE.format("regexp_replace(lower(coalesce({}, '')), '[[:punct:]]', '', 'g')").replace("{{", "{").replace("}}", "}")).replace("{L}", "{{L}}").replace("{M}", "{{M}}").replace("{N}", "{{N}}") + r", '\s+'), lambda w: w <> '')"


def answer_pairs(spark, d):
    """A question as the gold of the one before it in its list."""
    q = table(spark, d, "cdn_rag_queries", "query_id", "set_no", "persona", "difficulty", "idx", "question").distinct()
    w = Window.partitionBy("set_no", "persona", "difficulty").orderBy("idx", "query_id")
    return q.select("query_id", F.col("question").alias("gold"), F.lag("question").over(w).alias("prediction"))


@query(f"WITH {_PAIRS} SELECT query_id, CASE WHEN array_to_string({_NORM.format('prediction')}, ' ') = array_to_string({_NORM.format('gold')}, ' ') THEN 1 ELSE 0 END::BIGINT AS em FROM p WHERE prediction IS NOT NULL AND gold IS NOT NULL")
def exact_match(spark, d):
    return answer_pairs(spark, d).where("prediction is not null and gold is not null").select("query_id", metrics.exact_match(F.col("prediction"), F.col("gold")).alias("em"))


@query(f"""WITH {_PAIRS}, w AS (SELECT query_id, {_NORM.format("prediction")} AS a, {_NORM.format("gold")} AS b FROM p),
    t AS (SELECT query_id, unnest(a) AS x FROM w), ta AS (SELECT query_id, x, count(*) AS n FROM t GROUP BY ALL),
    u AS (SELECT query_id, unnest(b) AS x FROM w), tb AS (SELECT query_id, x, count(*) AS n FROM u GROUP BY ALL),
    c AS (SELECT query_id, sum(least(ta.n, tb.n)) AS same FROM ta JOIN tb USING (query_id, x) GROUP BY query_id),
    m AS (SELECT query_id, len(a) AS na, len(b) AS nb, CASE WHEN (array_to_string(a, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(b, ' ') IN ('yes', 'no', 'noanswer')) AND a <> b THEN 0 ELSE coalesce(same, 0) END AS same FROM w LEFT JOIN c USING (query_id))
    SELECT query_id, round(CASE WHEN same = 0 THEN 0.0 ELSE 2 * (same / na) * (same / nb) / (same / na + same / nb) END, 5) AS f1, round(CASE WHEN same = 0 THEN 0.0 ELSE same / na END, 5) AS precision, round(CASE WHEN same = 0 THEN 0.0 ELSE same / nb END, 5) AS recall FROM m""")
def token_f1(spark, d):
    f = metrics.token_f1(F.col("prediction"), F.col("gold"))
    return answer_pairs(spark, d).select("query_id", f.alias("f")).select("query_id", *(F.round(f"f.{x}", 5).alias(x) for x in ("f1", "precision", "recall")))


@query(f"SELECT query_id, array_to_string({_NORM.format('question')}, ' ') AS normal FROM (SELECT DISTINCT query_id, question FROM cdn_rag_queries WHERE question IS NOT NULL)")
def normalize_answers(spark, d):
    return table(spark, d, "cdn_rag_queries", "query_id", "question").where("question is not null").distinct().select("query_id", normalize_answer(F.col("question")).alias("normal"))
