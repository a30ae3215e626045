"""One way to ask any retriever: by name, with the query's language found out where the retriever needs it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import query_language
from tamarack.operators import dense, letters, ranking, sparse
from tamarack.plans import lexical, vectors
from tamarack.plans import sql as S
from tamarack.plans.registry import query, table

Retriever = Callable[[SparkSession, str, DataFrame, int], DataFrame]


def by_terms(spark: SparkSession, d: str, queries: DataFrame, k: int) -> DataFrame:
    """Okapi over the one index of all documents; of a query's words only the last 64 count."""
    return lexical.best(sparse.bm25(lexical.index_of(spark, d), sparse.query_terms(queries, last=64)), k)


def by_language(spark: SparkSession, d: str, queries: DataFrame, k: int) -> DataFrame:
    """Okapi over the index of the query's language and the one of unknown language."""
    return ranking.merge_bundles(lexical.bundle_hits(spark, d, queries).drop("ql"), k, 200).select("qid", "doc_id", "score", "rank")


def by_vectors(spark: SparkSession, d: str, queries: DataFrame, k: int) -> DataFrame:
    """Products divided by the document's length, over all vectors; ``queries`` have (qid, v)."""
    return dense.search(vectors.corpus(spark, d), queries, k, dense.norm_dot_scores)


def by_vectors_and_language(spark: SparkSession, d: str, queries: DataFrame, k: int) -> DataFrame:
    """Products over the vectors of documents in the query's language and in none: (qid, v, text). The best 20 k (50 at least) of each
    language are merged, of equal texts the best stays; scores may be of any sign."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang").select("doc_id", "text", F.coalesce("lang", F.lit("unknown")).alias("bundle"))
    routed = queries.withColumn("bundle", F.explode(F.array(query_language(F.col("text")), F.lit("unknown"))))
    corpus = vectors.corpus(spark, d).select("doc_id", "v").join(docs.select("doc_id", "bundle"), "doc_id")
    # a query meets each of its languages as a query of its own
    twice = routed.select(F.struct("qid", "bundle").alias("q"), "bundle", "v").withColumn("qid", F.to_json("q"))
    near = dense.search(corpus, twice.select("qid", "v", "bundle"), max(20 * k, 50), exclude_self=False, group="bundle")
    kind = dict(queries.dtypes)["qid"]
    near = near.select(F.from_json("qid", f"qid {kind}, bundle string").alias("q"), "doc_id", "score").select("q.qid", "q.bundle", "doc_id", "score").where("qid <> doc_id")
    hits = near.join(docs.select("doc_id", "text"), "doc_id").select("qid", "bundle", "doc_id", "score", "text")
    return ranking.merge_bundles(hits, k, positive=False).select("qid", "doc_id", "score", "rank")


RETRIEVERS: dict[str, Retriever] = {"BM25": by_terms, "SPARSE": by_language, "SGPT": by_vectors, "FAISS": by_vectors_and_language}


def retrieve(kind: str, spark: SparkSession, d: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, doc_id, score, rank) of the retriever of that name in any case; another name raises."""
    if (found := RETRIEVERS.get(kind.upper())) is None:
        raise NotImplementedError(kind)
    return found(spark, d, queries, k)


def asked(spark: SparkSession, d: str) -> DataFrame:
    """(qid, v, text): every vector whose id is divisible by 20, with the text of the document of that id."""
    return vectors.asked(spark, d).select("qid", "v").join(table(spark, d, "documents").select(F.col("doc_id").alias("qid"), "text"), "qid")


@query(f"WITH {S.index()}, {S.terms()}, {S.scored(qt='(SELECT qid, term, count(*) AS qn FROM (SELECT qid, unnest(w[greatest(1, len(w) - 63):]) AS term FROM (SELECT qid, ' + S.TOKENS.format('text') + ' AS w FROM q)) GROUP BY ALL)')} {S.top('s', 5)}")
def dispatch_terms(spark, d):
    return retrieve("bm25", spark, d, lexical.items(spark, d), 5)


@query(f"{lexical._merged(S.ITEMS)} SELECT qid, doc_id, score, rank FROM m WHERE rank <= 5")
def dispatch_language(spark, d):
    return retrieve("sparse", spark, d, lexical.items(spark, d), 5)


@query(f"WITH {S.nearest('list_inner_product(qv, v) / sqrt(list_inner_product(v, v))')} SELECT * FROM run WHERE rank <= 5")
def dispatch_vectors(spark, d):
    return retrieve("sgpt", spark, d, vectors.asked(spark, d), 5)


@query(
    f"""WITH {S.VECTORS}, q AS (SELECT qid, qv, text FROM qv JOIN documents ON doc_id = qid), {lexical.ROUTED},
    c AS (SELECT v.doc_id, v, text, coalesce(lang, 'unknown') AS bundle FROM v JOIN documents USING (doc_id)),
    s AS (SELECT q.qid, c.bundle, c.doc_id, c.text, round({S.DOT}, 6) + 0.0 AS score FROM q JOIN ql USING (qid) JOIN c ON c.bundle = ql OR c.bundle = 'unknown'),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid, bundle ORDER BY score DESC, doc_id) AS r FROM s),
    u AS (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY score DESC, doc_id) AS n FROM o WHERE r <= 100 AND qid <> doc_id AND length(trim(text)) > 0)
    {S.top("(SELECT * FROM u WHERE n = 1)", 5)}"""
)
def dispatch_vectors_and_language(spark, d):
    return retrieve("faiss", spark, d, asked(spark, d), 5)


@query()
def query_languages(spark, d):
    """Languages of all questions, with the letters of documents in English and French as the fallback."""
    model = letters.fit_letters(table(spark, d, "documents", "text", "lang"), "text", "lang")
    q = table(spark, d, "cdn_rag_queries", "query_id", "question").distinct()
    return q.select("query_id", query_language(F.col("question"), model.column(F.col("question"))).alias("lang"))


@query(f"WITH {S.index('SELECT CAST(NULL AS VARCHAR) AS n, * FROM (SELECT chr(32) AS bundle, doc_id, coalesce(text, chr(32)) || chr(32) || coalesce(title, chr(32)) AS text FROM documents)')}, {S.terms()}, {S.scored('lucene', 1.2, 0.75)} {S.top('s', 5)}")
def generated_queries_topk(spark, d):
    """Documents with generated questions added to their text; titles stand in for what a model would generate."""
    made = table(spark, d, "documents", "doc_id", "title").select("doc_id", F.col("title").alias("query"))
    corpus = sparse.with_generated(lexical.docs(spark, d), made)
    return lexical.best(sparse.bm25(sparse.build(corpus), sparse.query_terms(lexical.items(spark, d)), "lucene", 1.2, 0.75), 5)


@query("SELECT query_id, question FROM (SELECT DISTINCT query_id, question FROM cdn_rag_queries WHERE question IS NOT NULL) ORDER BY md5('7|' || query_id), query_id LIMIT 40")
def shuffled_sample(spark, d):
    """The first 40 of a seeded shuffle: the sample is the feature."""
    q = table(spark, d, "cdn_rag_queries", "query_id", "question").where("question is not null").distinct()
    return ranking.shuffled(q, "query_id", 40, 7)


@query(f"WITH {S.VECTORS}, s AS (SELECT qid, doc_id, round(list_inner_product(qv, qv) + list_inner_product(v, v) - 2 * list_inner_product(qv, v), 6) AS score FROM qv, v WHERE qid <> doc_id) SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, doc_id) AS rank FROM s) WHERE rank <= 5")
def dense_distance_topk(spark, d):
    """Squared distances, smaller is better."""
    run = dense.search(vectors.corpus(spark, d), vectors.asked(spark, d), 30, lambda q, x: -((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T))
    run = run.select("qid", "doc_id", (-F.col("score")).alias("score"))
    return ranking.top_k(run, ["qid"], [ranking.better("l2", "score"), F.asc("doc_id")], 5)
