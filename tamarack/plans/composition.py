"""Queries on runs: pooling, filters, fusion, nesting, samples, training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators import dense, models, ranking, sparse, training
from tamarack.plans import lexical, vectors
from tamarack.plans import sql as S
from tamarack.plans.registry import query, table
from tamarack.sources import writers

RUN = f"WITH {S.nearest(S.DOT)}, {S.QRELS}"


def qrels(spark, d):
    """Same label is relevant, of grade 2 where the id ends like the query's."""
    q, c = vectors.asked(spark, d), vectors.corpus(spark, d)
    grade = F.when(F.col("doc_id") % 10 == F.col("qid") % 10, 2).otherwise(1)
    return q.select("qid", "label").join(c.select("doc_id", "label"), "label").where("qid <> doc_id").select("qid", "doc_id", grade.alias("score"))


@query(f"{RUN}, p AS (SELECT DISTINCT doc_id FROM run WHERE rank <= 3), s2 AS (SELECT qid, doc_id, round({S.DOT}, 6) AS score FROM qv, v WHERE qid <> doc_id AND doc_id IN (SELECT doc_id FROM p)) {S.top('s2', 10)}")
def rerank_pool(spark, d):
    pool = ranking.pooled(vectors.exact(spark, d), vectors.corpus(spark, d), 3)
    return dense.search(pool, vectors.asked(spark, d), 10)


@query(f"{RUN}, x AS (SELECT qid, doc_id, score FROM run ANTI JOIN (SELECT qid, doc_id FROM qrels WHERE score = 2) USING (qid, doc_id)) {S.top('x', 10)}")
def run_exclude_filter(spark, d):
    return ranking.excluding(vectors.exact(spark, d), qrels(spark, d).where("score = 2"), 10)


@query(f"""WITH {S.index()}, {S.terms()}, {S.scored()}, f AS ({S.top("s", 5)})
    SELECT qid, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS ids, any_value(q.text) AS question, sum(length(documents.text))::BIGINT AS chars FROM f JOIN documents USING (doc_id) JOIN q USING (qid) GROUP BY qid""")
def nested_rerank_file(spark, d):
    none = spark.createDataFrame([], "qid long, doc_id long, score int")
    n = ranking.nested(lexical.best(lexical.okapi(spark, d), 5), lexical.docs(spark, d), lexical.items(spark, d), none)
    text = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda s, x: s + F.length(x["paragraph_text"]))
    return n.select("qid", F.size("paragraphs").cast("long").alias("n"), F.array_join(F.transform("paragraphs", lambda x: x["doc_id"].cast("string")), ",").alias("ids"), "question", text.alias("chars"))


@query(f"{RUN}, j AS (SELECT DISTINCT doc_id FROM qrels WHERE score = 2), r AS (SELECT doc_id FROM v ANTI JOIN j USING (doc_id) ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT greatest(0, 300 - (SELECT count(*) FROM j))) SELECT doc_id FROM j UNION ALL SELECT doc_id FROM r")
def judged_plus_sample(spark, d):
    return ranking.judged_sample(vectors.corpus(spark, d).select("doc_id"), qrels(spark, d).where("score = 2").select("doc_id"), 300)


@query("SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_first(spark, d):
    return ranking.first_by(table(spark, d, "documents", "text", "doc_id").where("text is not null"), ["text"], [F.asc("doc_id")])


@query("SELECT text, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY collected_at DESC NULLS LAST, doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1")
def dedup_best(spark, d):
    docs = table(spark, d, "documents", "text", "doc_id", "n_chars", "collected_at").where("text is not null")
    return ranking.first_by(docs, ["text"], [F.desc_nulls_last("collected_at"), F.asc("doc_id")]).drop("collected_at")


_TWO = f"""b1 AS ({S.top("s", 10)}), f2 AS (SELECT qid, doc_id, score FROM (WITH {S.index()}, {S.terms()}, {S.scored("lucene", 0.9, 0.4)} SELECT * FROM s)), b2 AS ({S.top("f2", 10)})"""


@query(f"WITH {S.index()}, {S.terms()}, {S.scored()}, {_TWO} SELECT *, 'okapi' AS source FROM b1 UNION ALL SELECT *, 'lucene' AS source FROM b2")
def hybrid_union(spark, d):
    """Two systems side by side, not fused."""
    other = lexical.best(sparse.bm25(lexical.index_of(spark, d), sparse.query_terms(lexical.items(spark, d)), "lucene", 0.9, 0.4))
    return lexical.bm25_topk(spark, d).withColumn("source", F.lit("okapi")).unionByName(other.withColumn("source", F.lit("lucene")))


@query(f"WITH {S.index()}, {S.terms()}, {S.scored()}, {_TWO}, g AS (SELECT qid, doc_id, round(sum(1.0 / (rank + 60)), 8) AS score FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) GROUP BY ALL) {S.top('g', 10)}")
def rrf_fusion(spark, d):
    return ranking.reciprocal_rank_fusion(hybrid_union(spark, d).select("qid", "doc_id", "rank"), 10)


@query(f"""WITH {S.index()}, {S.terms()}, {S.scored()}, f AS ({S.top("s", 11)}), pos AS (SELECT qid, doc_id FROM f WHERE rank = 1)
    SELECT qid, doc_id, rank FROM f ANTI JOIN pos USING (qid, doc_id)""")
def hard_negatives_bm25(spark, d):
    run = lexical.best(lexical.okapi(spark, d), 11)
    return training.hard_negatives(run, run.where("rank = 1"), 11)


@query(f"""WITH {S.index()}, {S.terms()}, {S.scored()}, f AS ({S.top("s", 11)}), p AS (SELECT qid, doc_id AS pos, score AS ps FROM f WHERE rank = 1)
    SELECT qid, pos, doc_id AS neg, round(ps - score, 6) AS label FROM f JOIN p USING (qid) WHERE doc_id <> pos""")
def margin_labels(spark, d):
    run = lexical.best(lexical.okapi(spark, d), 11)
    return training.margin_labels(run, run.where("rank = 1"))


@query(f"""WITH {S.index()}, {S.terms()}, {S.scored()}, f AS ({S.top("s", 2)})
    SELECT qid, f.doc_id, q.text AS query, documents.text AS passage FROM f JOIN q USING (qid) JOIN documents USING (doc_id)""")
def train_pairs(spark, d):
    top = lexical.best(lexical.okapi(spark, d), 2).select("qid", "doc_id", F.lit(1).alias("score"))
    return training.pairs(top, lexical.items(spark, d), lexical.docs(spark, d))


@query(f"{RUN}, p AS (SELECT qid, doc_id, score AS ce FROM run WHERE rank = 1), l AS (SELECT qid, ce - 0.05 AS lim FROM p), t AS (SELECT r.*, row_number() OVER (PARTITION BY qid ORDER BY rank, doc_id) AS n FROM run r JOIN l USING (qid) WHERE score <= lim) SELECT qid, doc_id, score AS ce FROM t WHERE n <= 5")
def margin_negatives(spark, d):
    run = vectors.exact(spark, d).withColumnsRenamed({"score": "ce", "rank": "place"}).withColumn("system", F.lit("dot"))
    return training.margin_negatives(run, run.where("place = 1"), 0.05, 5).select("qid", "doc_id", "ce")


@query(f"{RUN} SELECT concat_ws(chr(9), qid::VARCHAR, 'Q0', doc_id::VARCHAR, rank::VARCHAR, printf('%.6f', score), 'dot') AS line FROM run")
def trec_run_lines(spark, d):
    return vectors.exact(spark, d).select(writers.run_line("dot").alias("line"))


@query(
    f"""WITH {S.index()}, {S.terms()}, {S.scored()}, f AS ({S.top("s", 20)}),
    w AS (SELECT qid, f.doc_id, {S.TOKENS.format("q.text")} AS a, {S.TOKENS.format("trim(concat_ws(' ', documents.title, documents.text))")} AS b FROM f JOIN q USING (qid) JOIN documents USING (doc_id)),
    s2 AS (SELECT qid, doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS score FROM w) {S.top("s2", 20)}"""
)
def rerank_by_model(spark, d):
    """The best twenty ranked again by the stand-in for a cross-encoder."""
    run = lexical.best(lexical.okapi(spark, d), 20)
    return models.rerank(run, lexical.items(spark, d), lexical.docs(spark, d), models.OverlapReranker(), 20)


@query()
def encoded_topk(spark, d):
    """Dense search over vectors of the stand-in encoder: items against all documents."""
    model = models.HashEncoder()
    c = lexical.docs(spark, d).select("doc_id", model.encode(models.passage_text(F.col("title"), F.col("text"))).alias("v"))
    q = lexical.items(spark, d).select("qid", model.encode(F.col("text")).alias("v"))
    return dense.search(c, q, 10, dense.cosine_scores, exclude_self=False)


@query()
def analyzed_topk(spark, d):
    """Scoring without stop words."""
    t = sparse.analyzed("english")
    return lexical.best(sparse.bm25(lexical.index_of(spark, d, "analyzed", tokenizer=t), sparse.query_terms(lexical.items(spark, d), tokenizer=t), "lucene", 1.2, 0.75))


@query()
def retrieval_rounds(spark, d):
    """Two rounds of retrieve and append: each adds the first sentence of the best document for what there is so far."""
    index, corpus = lexical.index_of(spark, d), lexical.docs(spark, d).select("doc_id", F.col("text").alias("t"))

    def step(state):
        asked = state.select("qid", F.concat_ws(" ", "text", "answer").alias("text"))
        top = lexical.best(sparse.bm25(index, sparse.query_terms(asked)), 1).join(corpus, "doc_id").select("qid", T.first_sentence(F.col("t")).alias("more"))
        nxt = state.join(top, "qid", "left")
        return nxt.select("qid", "text", F.trim(F.concat_ws(" ", "answer", "more")).alias("answer"), (F.col("round") + 1).alias("round"))

    start = lexical.items(spark, d).select("qid", "text", F.lit("").alias("answer"), F.lit(0).alias("round"))
    return models.rounds(start, step, F.col("round") >= 2, 4).select("qid", "answer", "round")
