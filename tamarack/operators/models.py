"""Interfaces of models and deterministic stand-ins for them. A model is an expression or an iterator pandas UDF over columns,
so that it is loaded once by each worker; the stand-ins need no files and are meant for tests and plumbing only."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import tokens
from tamarack.operators.ranking import top_k
from tamarack.runtime import cut


class Encoder(Protocol):
    def encode(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def predict(self, query: Column, passage: Column) -> Column: ...


class Tagger(Protocol):
    def spans(self, text: Column) -> Column: ...


class HashEncoder:
    """Stand-in: counts of tokens by hash, ``dims`` numbers."""

    def __init__(self, dims: int = 32) -> None:
        self.dims = dims

    def encode(self, text: Column) -> Column:
        bins = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(self.dims)))
        return F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda i: F.size(F.filter(bins, lambda b: b == i)).cast("double"))


class OverlapReranker:
    """Stand-in: shared distinct tokens divided by all distinct tokens; 0 where there are none."""

    def predict(self, query: Column, passage: Column) -> Column:
        a, b = tokens(query), tokens(passage)
        return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


class CapitalTagger:
    """Stand-in: runs of capitalised words are entities."""

    def spans(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{L}\p{M}'’-]*(?: \p{Lu}[\p{L}\p{M}'’-]*)*"), F.lit(0))


def passage_text(title: Column, text: Column) -> Column:
    return F.trim(F.concat_ws(" ", title, text))


def rerank(run: DataFrame, queries: DataFrame, corpus: DataFrame, model: Reranker, k: int) -> DataFrame:
    """The first k of each query scored again by a model over (query, title and text)."""
    d = run.where(F.col("rank") <= k).select("qid", "doc_id").join(queries.select("qid", F.col("text").alias("q")), "qid")
    d = d.join(corpus.select("doc_id", passage_text(F.col("title"), F.col("text")).alias("p")), "doc_id")
    return top_k(d.select("qid", "doc_id", F.round(model.predict(F.col("q"), F.col("p")), 6).alias("score")), ["qid"], [F.desc("score"), F.asc("doc_id")], k)


def unsure_entities(entities: Column, words: Column, logprobs: Column, threshold: float) -> Column:
    """Entities (strings) whose words are too unsure on average: mean of 1 - exp(logprob) over the words they consist of."""
    pairs = F.arrays_zip(words.alias("w"), logprobs.alias("p"))

    def unsure(e: Column) -> Column:
        own = F.filter(pairs, lambda x: F.array_contains(F.split(e, " "), x["w"]))
        return F.coalesce(F.aggregate(own, F.lit(0.0), lambda s, x: s + 1 - F.exp(x["p"])) / F.nullif(F.size(own), F.lit(0)), F.lit(0.0)) > threshold

    return F.filter(entities, unsure)


def rounds(state: DataFrame, step: Callable[[DataFrame], DataFrame], done: Column, most: int) -> DataFrame:
    """Iterated generation: ``step`` maps the open rows of a state to the next state; rows for which ``done`` holds stay as they
    are. At most ``most`` rounds, each written as a table; it ends early when no row is open."""
    finished = state.where(done)
    open_ = state.where(~F.coalesce(done, F.lit(False)))
    for _ in range(most):
        if open_.isEmpty():
            break
        nxt = cut(step(open_), "round")
        finished = finished.unionByName(nxt.where(done))
        open_ = nxt.where(~F.coalesce(done, F.lit(False)))
    return finished.unionByName(open_)
