"""Inverted index as plain tables and sparse scoring over it.

``build`` tokenises a corpus once and writes the postings; document frequencies, lengths and collection statistics are
derived from them for each bundle (an index of its own within the table). Scoring joins the terms of all
queries at once with the postings; only postings of query terms reach the join on the document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import tokens
from tamarack.operators.ranking import top_k
from tamarack.runtime import cut


@dataclass
class SparseIndex:
    """postings: bundle, doc_id, term, tf, dl; docs: bundle, doc_id, dl, of all documents; derived from these, terms: bundle, term, df,
    and stats: bundle, n, avgdl, and mean_idf (of the Okapi form)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    docs: DataFrame


def build(corpus: DataFrame, text: str = "text", bundle: Column | None = None, tokenizer=tokens) -> SparseIndex:
    """Index of (doc_id, ``text``). Documents without a token count in n but have no postings. Texts aren't shuffled, only the
    terms counted within a task are."""
    d = corpus.select((F.lit("") if bundle is None else bundle).alias("bundle"), "doc_id", tokenizer(F.col(text)).alias("w"))
    d = d.select("bundle", "doc_id", F.size("w").cast("long").alias("dl"), "w")
    postings = d.select("bundle", "doc_id", "dl", F.explode("w").alias("term")).groupBy("bundle", "doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    return derived(cut(postings.select("bundle", "doc_id", "term", "tf", "dl"), "postings"), cut(d.drop("w"), "docs"))


def derived(postings: DataFrame, docs: DataFrame) -> SparseIndex:
    """The index of given postings and documents: frequencies and statistics are counted from them."""
    df = cut(postings.groupBy("bundle", "term").agg(F.count("*").alias("df")), "terms")
    lengths = docs.groupBy("bundle").agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    mean = df.join(lengths, "bundle").groupBy("bundle").agg(F.avg(okapi_idf0()).alias("mean_idf"))
    return SparseIndex(postings, df, cut(lengths.join(mean, "bundle", "left"), "stats"), docs)


def without(index: SparseIndex, gone: DataFrame) -> SparseIndex:
    """The index after documents (doc_id) were deleted; frequencies and statistics follow."""
    ids = gone.select("doc_id").distinct()
    return derived(cut(index.postings.join(ids, "doc_id", "left_anti").select(*index.postings.columns), "postings"), cut(index.docs.join(ids, "doc_id", "left_anti").select(*index.docs.columns), "docs"))


def upsert(index: SparseIndex, changed: DataFrame, text: str = "text", bundle: Column | None = None, tokenizer=tokens) -> SparseIndex:
    """The index after documents were added or replaced, the last version of each id winning. Only the changed documents are
    tokenised; frequencies and statistics follow."""
    new, ids = build(changed, text, bundle, tokenizer), changed.select("doc_id").distinct()
    kept = lambda d, n: cut(d.join(ids, "doc_id", "left_anti").select(*d.columns).unionByName(n), "merged")
    return derived(kept(index.postings, new.postings), kept(index.docs, new.docs))


def with_generated(corpus: DataFrame, generated: DataFrame, text: str = "text") -> DataFrame:
    """``corpus`` with the generated questions (doc_id, query) of each document added to its text, in their order."""
    made = generated.where("query is not null").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("query")), " ").alias("__made"))
    return corpus.join(made, "doc_id", "left").withColumn(text, F.concat_ws(" ", F.col(text), F.col("__made"))).drop("__made")


def analyzed(language: str = "english", stem: Callable[[Column], Column] | None = None):
    """A tokeniser without the stop words of a language; ``stem`` maps a token to its stem (an expression or a vectorised function)."""
    from pyspark.ml.feature import StopWordsRemover

    stop = StopWordsRemover.loadDefaultStopWords(language)
    kept = lambda text: F.filter(tokens(F.regexp_replace(text, r"[\p{Punct}]", " ")), lambda x: ~x.isin(*stop))
    return kept if stem is None else lambda text: F.transform(kept(text), stem)


def weighted_terms(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """Postings with their term frequencies replaced by given weights (doc_id, term, weight); terms without one are left out and
    lengths are the sums of weights."""
    d = postings.drop("tf", "dl").join(weights.where("weight > 0"), ["doc_id", "term"]).withColumnRenamed("weight", "tf")
    return d.join(d.groupBy("bundle", "doc_id").agg(F.sum("tf").alias("dl")), ["bundle", "doc_id"])


def okapi_idf0() -> Column:
    return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def idf(kind: str) -> Column:
    """okapi: negative values become a quarter of the mean over all terms; lucene: never negative; smooth: of TF-IDF vectors."""
    if kind == "okapi":
        return F.when(okapi_idf0() < 0, 0.25 * F.col("mean_idf")).otherwise(okapi_idf0())
    if kind == "lucene":
        return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1


def query_terms(queries: DataFrame, text: str = "text", tokenizer=tokens, last: int | None = None) -> DataFrame:
    """(qid, term, qn): a query's terms with how often they occur in it; ``last`` keeps only its last tokens."""
    w = tokenizer(F.col(text))
    w = w if last is None else F.slice(w, F.greatest(F.lit(1), F.size(w) - last + 1), F.lit(last))
    return queries.select("qid", F.explode(w).alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("qn"))


def bm25(index: SparseIndex, terms: DataFrame, kind: str = "okapi", k1: float = 1.5, b: float = 0.75, saturation: bool = True) -> DataFrame:
    """(qid, bundle, doc_id, score) of every document that shares a term with a query (qid, term, qn)."""
    w = index.terms.join(terms.select("term").distinct(), "term", "left_semi").join(index.stats, "bundle")
    w = w.select("bundle", "term", idf(kind).alias("idf"), "avgdl")
    hits = terms.join(w, "term").join(index.postings, ["bundle", "term"])
    part = F.col("qn") * F.col("idf") * F.col("tf") * ((k1 + 1) if saturation else 1.0) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("qid", "bundle", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def tfidf_vectors(index: SparseIndex, features: int = 10000) -> DataFrame:
    """(bundle, doc_id, term, weight, idf): L2-normalised TF-IDF rows over the ``features`` terms of the largest frequency."""
    total = index.postings.groupBy("bundle", "term").agg(F.sum("tf").alias("cf"))
    kept = top_k(total, ["bundle"], [F.desc("cf"), F.asc("term")], features, "__r").select("bundle", "term")
    w = index.terms.join(kept, ["bundle", "term"]).join(index.stats, "bundle").select("bundle", "term", idf("smooth").alias("idf"))
    d = index.postings.join(w, ["bundle", "term"]).withColumn("raw", F.col("tf") * F.col("idf"))
    norm = d.groupBy("bundle", "doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return d.join(norm, ["bundle", "doc_id"]).select("bundle", "doc_id", "term", (F.col("raw") / F.col("norm")).alias("weight"), "idf")


def tfidf(vectors: DataFrame, terms: DataFrame) -> DataFrame:
    """Cosine of queries and documents."""
    known = vectors.select("bundle", "term", "idf").distinct().join(terms, "term").withColumn("raw", F.col("qn") * F.col("idf"))
    norm = known.groupBy("bundle", "qid").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("qnorm"))
    q = known.join(norm, ["bundle", "qid"]).select("bundle", "qid", "term", (F.col("raw") / F.col("qnorm")).alias("qw"))
    return q.join(vectors, ["bundle", "term"]).groupBy("qid", "bundle", "doc_id").agg(F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score"))


def impact(weights: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, doc_id, score) from (doc_id, term, weight): the sum of qn * weight. ``qn`` is a query term's own weight, or how often
    it occurs where queries have none."""
    return terms.join(weights, "term").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("qn") * F.col("weight")), 6).alias("score"))


def pruned(weights: DataFrame, n: int) -> DataFrame:
    """The n heaviest positive terms of each document."""
    return top_k(weights.where("weight > 0"), ["doc_id"], [F.desc("weight"), F.asc("term")], n, "__r").drop("__r")


def best_fields(parts: list[DataFrame], tie: float = 0.5) -> DataFrame:
    """The best field's score plus ``tie`` times the others'."""
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return d.groupBy("qid", "doc_id").agg(F.round(F.max("score") + tie * (F.sum("score") - F.max("score")), 6).alias("score"))


def rm3(index: SparseIndex, terms: DataFrame, first: DataFrame, fb_docs: int = 10, fb_terms: int = 10, weight: float = 0.5) -> DataFrame:
    """(qid, term, qn): the queries expanded by the terms of their best documents. ``first`` is a scored run; document scores
    are taken as shares; the ``fb_terms`` heaviest terms are mixed with the original query."""
    top = top_k(first, ["qid"], [F.desc("score"), F.asc("doc_id")], fb_docs).where("score > 0")
    share = top.join(top.groupBy("qid").agg(F.sum("score").alias("all")), "qid").select("qid", "doc_id", (F.col("score") / F.col("all")).alias("p"))
    model = share.join(index.postings, "doc_id").groupBy("qid", "term").agg(F.round(F.sum(F.col("p") * F.col("tf") / F.col("dl")), 9).alias("w"))
    model = top_k(model, ["qid"], [F.desc("w"), F.asc("term")], fb_terms)
    model = model.join(model.groupBy("qid").agg(F.sum("w").alias("all")), "qid").select("qid", "term", ((1 - weight) * F.col("w") / F.col("all")).alias("w"))
    own = terms.join(terms.groupBy("qid").agg(F.sum("qn").alias("all")), "qid").select("qid", "term", (weight * F.col("qn") / F.col("all")).alias("w"))
    return own.unionByName(model).groupBy("qid", "term").agg(F.round(F.sum("w"), 9).alias("qn"))
