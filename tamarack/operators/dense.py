"""Vector search: exact, binary, quantised, projected, and by cells.

A stated set of queries goes out in blocks of bounded size; each task scores its batches with matrix products and keeps
the best k of every query, and one ranking of those partial lists ends the search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.ranking import top_k
from tamarack.runtime import cut

Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def dot_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q @ x.T


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def cosine_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return unit(q) @ unit(x).T


def l2_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 / (1 + squared distance)."""
    d = (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T
    return 1 / (1 + np.maximum(d, 0))


def norm_dot_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Dot product by the document's length only."""
    return q @ unit(x).T


def flat(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of those lists of an Arrow column that have ``size`` numbers; taken from the flat buffer."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    return np.nonzero(ok.to_numpy(zero_copy_only=False))[0], column.filter(ok).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def best_of(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best finite scores of each row, and of what ties with the last."""
    n = min(k, s.shape[1])
    cut_at = -np.partition(-s, n - 1, axis=1)[:, n - 1]
    return np.nonzero((s >= cut_at[:, None]) & np.isfinite(s))


def blocks_of(queries: DataFrame, block: int, *more: str) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(ids, vectors, further columns) of at most ``block`` queries at a time; null vectors are left out."""
    held: list = []
    for r in queries.select("qid", "v", *more).where("v is not null").toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield np.array([r[0] for r in held]), np.array([r[1] for r in held], float), [tuple(r[2:]) for r in held]
            held = []
    if held:
        yield np.array([r[0] for r in held]), np.array([r[1] for r in held], float), [tuple(r[2:]) for r in held]


def merged(parts: list[DataFrame], corpus: DataFrame, schema: str, k: int) -> DataFrame:
    if not parts:
        return corpus.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0).cast("long"))
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return top_k(d, ["qid"], [F.desc("score"), F.asc("doc_id")], k)


def search(corpus: DataFrame, queries: DataFrame, k: int, score: Score = dot_scores, exclude_self: bool = True, block: int = 4096, group: str | None = None) -> DataFrame:
    """(qid, doc_id, score, rank) of (doc_id, v) for (qid, v). Null vectors and those of another length are left out; ties go to
    the smaller id; scores are rounded to six places before ranking. With ``group``, a column of both sides, a query only meets
    rows of its own group (none where that is null). Queries go out in blocks, each a pass over the corpus."""
    schema, q_type = _found(corpus, queries)
    more = [group] if group else []

    def scan(ids: np.ndarray, vectors: np.ndarray, groups: list) -> DataFrame:
        sent = corpus.sparkSession.sparkContext.broadcast((ids, vectors, np.array([g[0] for g in groups]) if more else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, groups = sent.value
            for b in batches:
                at, x = flat(b.column(1), q.shape[1])
                if not len(at):
                    continue
                keys = b.column(0).take(pa.array(at))
                docs = keys.to_numpy(zero_copy_only=False)
                s = np.round(score(q, x), 6)
                if exclude_self:
                    s[ids[:, None] == docs[None, :]] = -np.inf
                if more:
                    s[groups[:, None] != b.column(2).to_numpy(zero_copy_only=False)[at][None, :]] = -np.inf
                row, col = best_of(s, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row], q_type), keys.take(pa.array(col)), pa.array(s[row, col])], ["qid", "doc_id", "score"])

        return corpus.select("doc_id", "v", *more).mapInArrow(run, schema)

    return merged([scan(*x) for x in blocks_of(queries, block, *more)], corpus, schema, k)


def _found(corpus: DataFrame, queries: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return f"qid {dict(queries.dtypes)['qid']}, doc_id {dict(corpus.dtypes)['doc_id']}, score double", to_arrow_type(queries.schema["qid"].dataType)


def hamming_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Minus the number of differing bits of the codes x > 0."""
    return -(q.shape[1] - np.where(q > 0, 1.0, -1.0) @ np.where(x > 0, 1.0, -1.0).T) / 2


def binary_search(corpus: DataFrame, queries: DataFrame, k: int, candidates: int = 1000) -> DataFrame:
    """The ``candidates`` nearest by bits, ranked by the product of the query with the code of plus and minus ones."""
    near = search(corpus, queries, candidates, hamming_scores).select("qid", "doc_id")
    d = near.join(corpus.select("doc_id", "v"), "doc_id").join(queries.select("qid", F.col("v").alias("qv")), "qid")
    code = F.transform("v", lambda x: F.when(x.cast("double") > 0, 1.0).otherwise(-1.0))
    d = d.select("qid", "doc_id", F.round(vector_dot(F.col("qv"), code), 6).alias("score"))
    return top_k(d, ["qid"], [F.desc("score"), F.asc("doc_id")], k)


def reranked(near: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, cosine: bool = False) -> DataFrame:
    """The best ``k`` of the pairs (qid, doc_id) by their exact product, or cosine; zero vectors have cosine 0."""
    d = near.join(corpus.select("doc_id", "v"), "doc_id").join(queries.select("qid", F.col("v").alias("qv")), "qid")
    s = vector_dot(F.col("qv"), F.col("v"))
    if cosine:
        s = F.coalesce(F.try_divide(s, F.sqrt(vector_dot(F.col("qv"), F.col("qv")) * vector_dot(F.col("v"), F.col("v")))), F.lit(0.0))
    return top_k(d.select("qid", "doc_id", F.round(s, 6).alias("score")), ["qid"], [F.desc("score"), F.asc("doc_id")], k)


def candidates(corpus: DataFrame, share: float, least: int) -> int:
    """How many are reranked: a share of the table, so that recall doesn't fall as it grows."""
    return max(least, int(np.ceil(share * corpus.count())))


def vector_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Of length 1; null where the length is 0."""
    n = F.sqrt(vector_dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def bit_code(v: Column, threshold: float = 0.0) -> Column:
    """Array of 0 and 1: x > threshold."""
    return F.transform(v, lambda x: F.when(x.cast("double") > threshold, 1).otherwise(0))


def sq8(v: Column, low: Column, high: Column) -> Column:
    """Uniform 8-bit codes of a vector between bounds of the whole collection; 0 where the bounds are equal."""
    return F.transform(v, lambda x: F.coalesce(F.floor(F.try_divide(x.cast("double") - low, high - low) * 255 + 0.5), F.lit(0)).cast("long"))


def augmented(v: Column, longest: Column) -> Column:
    """v with one more element, so that the nearest by distance is the largest by product: sqrt(longest^2 - |v|^2)."""
    return F.concat(F.transform(v, lambda x: x.cast("double")), F.array(F.sqrt(F.greatest(F.lit(0.0), longest * longest - vector_dot(v, v)))))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def sample_of(corpus: DataFrame, most: int = 20_000) -> np.ndarray:
    """About ``most`` vectors at most, by a hash of the id: the documented bound of what quantisers are fitted on."""
    n = corpus.count()
    part = min(1.0, most / max(1, n))
    rows = corpus.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))).orderBy("doc_id").select("v").where("v is not null").collect()
    return np.array([r[0] for r in rows], float)


@dataclass
class Cells:
    """An index by cells: centroids, and the table (doc_id, v, cell), written in the order of cells so that a cell is in few files."""

    centroids: np.ndarray
    table: DataFrame


def build_cells(corpus: DataFrame, cells: int | None = None) -> Cells:
    """Centroids are fitted on a bounded sample; their number follows the square root of the table's size. Every row with a
    vector gets its nearest cell."""
    x = sample_of(corpus)
    n = corpus.count()
    c = kmeans(x, min(len(x), cells or max(1, min(8192, int(2 * n**0.5))))) if len(x) else np.zeros((1, 1))
    sent = corpus.sparkSession.sparkContext.broadcast(c)
    kinds = dict(corpus.dtypes)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            at, x = flat(b.column(1), c.shape[1])
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(l2_scores(x, c).argmax(1) if len(at) else np.zeros(0, int), pa.int32())], ["doc_id", "v", "cell"])

    d = corpus.select("doc_id", "v").mapInArrow(placed, f"doc_id {kinds['doc_id']}, v {kinds['v']}, cell int")
    return Cells(c, cut(d.repartitionByRange("cell", "doc_id").sortWithinPartitions("cell"), "cells"))


def search_cells(index: Cells, queries: DataFrame, k: int, probes: int = 8, score: Score = l2_scores, exclude_self: bool = True, block: int = 4096) -> DataFrame:
    """(qid, doc_id, score, rank): a query is scored against the rows of its ``probes`` nearest cells only; cells that no query of a
    block probes aren't read."""
    schema, q_type = _found(index.table, queries)

    def scan(ids: np.ndarray, q: np.ndarray, _: list) -> DataFrame:
        near = np.argsort(-l2_scores(q, index.centroids), axis=1)[:, :probes]
        asking = {int(c): np.nonzero((near == c).any(1))[0] for c in np.unique(near)}
        sent = index.table.sparkSession.sparkContext.broadcast((ids, q, asking))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, asking = sent.value
            for b in batches:
                at, x = flat(b.column(1), q.shape[1])
                cell = b.column(2).to_numpy(zero_copy_only=False)[at]
                for c in np.unique(cell).tolist():
                    if (who := asking.get(c)) is None:
                        continue
                    mine = np.nonzero(cell == c)[0]
                    keys = b.column(0).take(pa.array(at[mine]))
                    s = np.round(score(q[who], x[mine]), 6)
                    if exclude_self:
                        s[ids[who][:, None] == keys.to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                    row, col = best_of(s, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who][row], q_type), keys.take(pa.array(col)), pa.array(s[row, col])], ["qid", "doc_id", "score"])

        table = index.table
        if len(asking) < len(index.centroids):
            table = table.where(F.col("cell").isin(*asking))
        return table.mapInArrow(run, schema)

    return merged([scan(*x) for x in blocks_of(queries, block)], index.table, schema, k)


@dataclass
class Codes:
    """An index by product quantisation: a book of centroids for each sub-vector, and the table (doc_id, code), a byte for each."""

    books: list[np.ndarray]
    table: DataFrame


def build_codes(corpus: DataFrame, parts: int = 16, bits: int = 8) -> Codes:
    """Books are fitted on a bounded sample; every row with a vector gets a code. ``parts`` must divide the vectors' length, and a
    book has at most 256 centroids."""
    x = sample_of(corpus)
    books = [kmeans(s, min(1 << min(bits, 8), len(s))) for s in np.split(x, parts, axis=1)] if len(x) else []
    sent = corpus.sparkSession.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for b in batches:
            if not books:
                continue
            at, x = flat(b.column(1), sum(k.shape[1] for k in books))
            code = np.stack([l2_scores(xs, k).argmax(1) for k, xs in zip(books, np.split(x, len(books), axis=1))], 1).astype(np.uint8) if len(at) else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([r.tobytes() for r in code], pa.binary())], ["doc_id", "code"])

    return Codes(books, cut(corpus.select("doc_id", "v").mapInArrow(coded, f"doc_id {dict(corpus.dtypes)['doc_id']}, code binary"), "codes"))


def search_codes(index: Codes, queries: DataFrame, k: int, exclude_self: bool = True, block: int = 512) -> DataFrame:
    """(qid, doc_id, score, rank) by the sum of the query's products with the centroids of a code; vectors aren't read."""
    schema, q_type = _found(index.table, queries)

    def scan(ids: np.ndarray, q: np.ndarray, _: list) -> DataFrame:
        tables = [part @ book.T for book, part in zip(index.books, np.split(q, len(index.books), axis=1))]
        sent = index.table.sparkSession.sparkContext.broadcast((ids, tables))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, tables = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                s = np.zeros((len(ids), b.num_rows))
                for j, t in enumerate(tables):
                    s += t[:, code[:, j]]
                s = np.round(s, 6)
                if exclude_self:
                    s[ids[:, None] == b.column(0).to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                row, col = best_of(s, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row], q_type), b.column(0).take(pa.array(col)), pa.array(s[row, col])], ["qid", "doc_id", "score"])

        return index.table.mapInArrow(run, schema)

    return merged([scan(*x) for x in blocks_of(queries, block)] if index.books else [], index.table, schema, k)


def ivf_search(corpus: DataFrame, queries: DataFrame, k: int, cells: int | None = None, probes: int = 8, score: Score = l2_scores) -> DataFrame:
    """An index by cells is built and searched; see ``build_cells`` and ``search_cells`` for one that is kept."""
    return search_cells(build_cells(corpus, cells), queries, k, probes, score)


def pq_search(corpus: DataFrame, queries: DataFrame, k: int, parts: int = 16, bits: int = 8, share: float = 0.05, least: int = 100) -> DataFrame:
    """Codes choose candidates (``share`` of the table, at least ``least``), the exact product ranks them; see ``build_codes`` and
    ``search_codes`` for an index that is kept."""
    near = search_codes(build_codes(corpus, parts, bits), queries, candidates(corpus, share, max(k, least))).select("qid", "doc_id")
    return reranked(near, corpus, queries, k)


def pca_search(corpus: DataFrame, queries: DataFrame, k: int, dims: int = 32, share: float = 0.15, least: int = 300) -> DataFrame:
    """Cosine search: the first ``dims`` principal directions choose candidates (``share`` of the table, at least ``least``), the
    exact cosine ranks them. Means and products are summed over all rows."""
    size = corpus.where("v is not null").select(F.size("v")).first()
    if size is None:
        return search(corpus, queries, k)
    n = size[0]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, p, m = np.zeros(n), np.zeros((n, n)), 0
        for b in batches:
            x = np.array([v for v in b.column(0).to_pylist() if v is not None and len(v) == n], float).reshape(-1, n)
            s, p, m = s + x.sum(0), p + x.T @ x, m + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), pa.array([np.concatenate((s, p.ravel())).tolist()], pa.list_(pa.float64()))], ["m", "x"])

    rows = corpus.select("v").mapInArrow(sums, "m long, x array<double>").select("m", F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("x"), F.sum("m").alias("m")).orderBy("pos").collect()
    m, all_ = rows[0]["m"], np.array([r["x"] for r in rows])
    mean = all_[:n] / m
    _, v = np.linalg.eigh(all_[n:].reshape(n, n) / m - np.outer(mean, mean))
    turn = v[:, ::-1][:, :dims]
    near = search(corpus, queries, candidates(corpus, share, max(k, least)), lambda q, x: cosine_scores((q - mean) @ turn, (x - mean) @ turn)).select("qid", "doc_id")
    return reranked(near, corpus, queries, k, cosine=True)


def weighted_mean_pool(states: Column, mask: Column) -> Column:
    """Position-weighted mean of token vectors (array of arrays): sum i * m * h / sum i * m, i from 1."""
    w = F.transform(mask, lambda m, i: (i + 1) * m)
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    dims = F.sequence(F.lit(1), F.size(states[0]))
    return F.transform(dims, lambda j: F.aggregate(F.zip_with(states, w, lambda h, x: F.element_at(h, j).cast("double") * x), F.lit(0.0), lambda s, x: s + x) / total)


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each query vector the best product with a document vector, summed."""
    best = F.transform(query, lambda a: F.array_max(F.transform(document, lambda b: vector_dot(a, b))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
