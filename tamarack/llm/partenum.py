"""Groups of near-duplicate texts by an exact prefix filter (problem 3).

A text is the set of its runs of ``width`` words, hashed. All runs stand in one order, rare ones first; any order is right, a
sample of the texts only makes it a good one. Where two sets are similar enough, their first common run stands so early in both
that what follows it can still hold the overlap their sizes ask for. So a set goes out under those of its first runs
after which a set of an allowed size could still be similar (about half of the runs at similarity 0.5), each with the
largest size a partner may have there; within a run, every two sets whose sizes allow each other are compared. No similar pair is
left out at any size or frequency; the only loss is at the sketches, which are set ``sigmas`` below the wanted similarity.

Equal sets are one class, told apart by 128 bits. Entries travel grouped by a prefix of their run, 8 bytes each and a head for each
set. A run that is on very many texts (by the sample) is split: its sets fall into blocks, and each two blocks are compared
in a group of their own, so no task holds them all. Pairs are pruned by size, place and sketches, then confirmed by exact
similarity, and closed to groups. The number of pairs looked at grows with the square of a run's frequency.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators.components import connected_components
from tamarack.runtime import cut

_WORD = re.compile(r"\w+")
#: Words of 64 sketch bits for each set.
WORDS = 5
BITS = 64 * WORDS
#: Members of one of two blocks of a hot run, and the bits of a limit that say on which side of such a pair an entry is.
BLOCK, SIDE, LIMIT = 50_000, 30, (1 << 30) - 1
#: Odd constants that mix 64-bit hashes.
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
_S = np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _C
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> _S)


class _Hash(dict):
    """Word -> 64-bit hash, forgotten when it has grown too large."""

    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def shingle_hashes(text: str | None, width: int, least_words: int, table: dict[str, int]) -> np.ndarray | None:
    """Sorted distinct hashes of the runs of words; null for null texts and those of fewer words."""
    w = _WORD.findall(text.lower()) if text else ()
    if len(w) < max(least_words, width):
        return None
    a = np.fromiter(map(table.__getitem__, w), np.uint64, len(w))
    h = np.zeros(len(w) - width + 1, np.uint64)
    for k in range(width):
        h = h * _A + a[k : len(w) - width + 1 + k]
    return np.unique(mixed(h))


def similarity(a: set, b: set) -> float:
    c = len(a & b)
    return c / (len(a) + len(b) - c) if a or b else 0.0


def rare_first(h: np.ndarray, row: np.ndarray, sizes: np.ndarray, common: np.ndarray, often: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, row, limit) of the runs that each set goes out under. ``h`` is sorted within each row; ``common`` are the sorted hashes
    of runs known to be frequent and ``often`` their counts. ``limit`` is the size of the largest set that can be
    similar when this is the first common run."""
    count = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        count = np.where(common[at] == h, often[at], 0)
    order = np.argsort((row << 32) + count, kind="stable")
    z = sizes[row]
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    limit = np.floor((z - place) * (1 + threshold) / threshold - z + 1e-6).astype(np.int64)
    keep = limit >= threshold * z - 1e-6
    return h[order][keep], row[keep], limit[keep]


def sketches(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """``WORDS`` words of 64 bits for each of n sets: a bit is the lowest bit of the smallest hash in one of 64 bins."""
    out = np.zeros((n, WORDS), np.uint64)
    for k in range(WORDS):
        g = mixed(h + _B * np.arange(k + 11, k + 12, dtype=np.uint64))
        low = np.full(n * 64, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(low, row * 64 + (g & np.uint64(63)).astype(np.int64), g >> np.uint64(6))
        bits = ((low & np.uint64(1)) * (low != np.iinfo(np.uint64).max)).reshape(n, 64)
        out[:, k] = (bits << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


def digests(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Two independent 64-bit sums over the hashes of each of n sets, as (2, n): equal sets have equal ones."""
    out = np.zeros((2, n), np.uint64)
    for k, salt in enumerate((_C, _A)):
        np.add.at(out[k], row, mixed(h + salt))
    return mixed(out)


def split_hot(run: np.ndarray, row: np.ndarray, limit: np.ndarray, node: np.ndarray, common: np.ndarray, often: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of runs expected on more than ``block`` sets, once for each pair of blocks that theirs is in, as runs of their own;
    the others as they are. How often a run is expected only decides how much is split, not what is compared."""
    if not len(common) or often.max() <= block:
        return run, row, limit
    at = np.minimum(np.searchsorted(common, run), len(common) - 1)
    m = np.where(common[at] == run, -(-often[at] // block), 1).astype(np.int64)
    out = [(run[m == 1], row[m == 1], limit[m == 1])]
    hr, hw, hl, hm = run[m > 1], row[m > 1], limit[m > 1], m[m > 1]
    own = (mixed(node[hw] + _A) % hm.astype(np.uint64)).astype(np.int64)
    for other in range(int(hm.max(initial=0))):
        k = other < hm
        lo, hi = np.minimum(own[k], other), np.maximum(own[k], other)
        side = np.where(lo == hi, 0, np.where(own[k] == lo, 1, 2))
        out.append((mixed(hr[k] ^ mixed((lo * 1_000_003 + hi + 1).astype(np.uint64) * _B)), hw[k], hl[k] | side << SIDE))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(run: np.ndarray, row: np.ndarray, limit: np.ndarray, heads: np.ndarray, prefixes: int) -> tuple[list[int], list[bytes]]:
    """Blobs by prefix: the number of sets, their heads (node, size, sketches), their numbers of runs, the upper 32 bits of the
    runs, the limits with their sides."""
    p = (run % np.uint64(prefixes)).astype(np.int64)
    order = np.lexsort((row, p))
    p, row, top, limit = p[order], row[order], (run[order] >> _S).astype(np.uint32), limit[order].astype(np.uint32)
    starts = np.concatenate((np.nonzero(np.concatenate(([True], p[1:] != p[:-1])))[0], [len(p)])) if len(p) else np.zeros(0, np.int64)
    keys, blobs = [], []
    for s, e in zip(starts[:-1], starts[1:]):
        rows, n = np.unique(row[s:e], return_counts=True)
        keys.append(int(p[s]))
        blobs.append(np.array([len(rows)], np.uint32).tobytes() + heads[:, rows].tobytes() + n.astype(np.uint32).tobytes() + top[s:e].tobytes() + limit[s:e].tobytes())
    return keys, blobs


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(heads, row, top, limit) of all blobs of a prefix; equal sets of several blobs come once."""
    heads, counts, top, limit = [], [], [], []
    for x in blobs:
        n = int(np.frombuffer(x, np.uint32, 1)[0])
        size = 8 * (WORDS + 2) * n
        heads.append(np.frombuffer(x, np.uint64, size // 8, 4).reshape(-1, n))
        counts.append(np.frombuffer(x, np.uint32, n, 4 + size))
        rest = np.frombuffer(x, np.uint32, -1, 4 + size + 4 * n).reshape(2, -1)
        top.append(rest[0])
        limit.append(rest[1])
    h, n = np.concatenate(heads, 1), np.concatenate(counts)
    row = np.repeat(np.arange(len(n)), n)
    _, first, back = np.unique(h[0], return_index=True, return_inverse=True)
    once = first[back][row] == row
    return h, row[once], np.concatenate(top)[once], np.concatenate(limit)[once]


def similar_pairs(heads: np.ndarray, row: np.ndarray, top: np.ndarray, limit: np.ndarray, least_bits: int, at_once: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes (a, b) that share a run, allow each other's sizes there and agree in ``least_bits`` of ``BITS`` sketch bits."""
    z = heads[1][row]
    order = np.lexsort((z, top))
    row, z, side, limit, top = row[order], z[order], limit[order] >> SIDE, (limit[order] & LIMIT).astype(np.uint64), top[order].astype(np.uint64) << _S
    upto = np.searchsorted(top | z, top | limit, side="right")
    many = np.maximum(0, upto - np.arange(len(row)) - 1)
    ends = np.cumsum(many)
    node, n, begin = heads[0], np.int64(heads.shape[1]), 0
    words = heads[2:][::-1]
    found = [np.zeros(0, np.int64)]
    while begin < len(row):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + at_once, side="right")))
        m = many[begin:end]
        i = np.repeat(np.arange(begin, end), m)
        j = np.arange(len(i)) - np.repeat(ends[begin:end] - m - done, m) + i + 1
        ok = (limit[j] >= z[i]) & (row[i] != row[j]) & ((side[i] == 0) | (side[i] != side[j]))
        a, b = row[i[ok]], row[j[ok]]
        differ = np.zeros(len(a), np.int64)
        for w in words:
            differ += np.bitwise_count(w[a] ^ w[b])
            near = differ <= BITS - least_bits
            a, b, differ = a[near], b[near], differ[near]
        found.append(np.unique(np.minimum(a, b) * n + np.maximum(a, b)))
        begin = end
    pair = np.unique(np.concatenate(found))
    a, b = node[pair // n], node[pair % n]
    return np.minimum(a, b), np.maximum(a, b)


def common_runs(d: DataFrame, part: float, width: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the runs that are on more than one text of a sample, and on how many. It only serves the order of runs."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Hash()
        for b in batches:
            sets = [h for t in b.column(0).to_pylist() if (h := shingle_hashes(t, width, least_words, table)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in sets], pa.binary())], ["blob"])

    chosen = d.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(part * (1 << 20))).where(F.length("t") < 20_000).select("t")
    blobs = [np.frombuffer(r[0], np.uint64) for r in chosen.mapInArrow(hashed, "blob binary").collect()]
    values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *blobs]), return_counts=True)
    return values[n > 1], n[n > 1]


def candidate_links(
    df: DataFrame, key: str, text: str, threshold: float = 0.5, width: int = 3, least_words: int = 20, sigmas: float = 4.0, prefixes: int | None = None, sample: int = 8_000, block: int = BLOCK
) -> DataFrame:
    """A written table (kind, a, b, c): kind 1 has a row for each text, a its key, b and c the digests of its set; kind 0 has the links
    between first digests. ``prefixes`` follows the number of rows, so that the entries of one prefix are about a million
    whatever the corpus; the order of runs comes from about ``sample`` texts."""
    d = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    rows = d.count()
    if prefixes is None:
        prefixes = max(16, rows // 10_000)
    part = min(1.0, sample / max(1, rows))
    order = d.sparkSession.sparkContext.broadcast(common_runs(d, part, width, least_words))
    least_bits = bits_needed(threshold, BITS, sigmas)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = _Hash(), set()
        common, often = order.value
        expected = np.ceil(often / part).astype(np.int64)

        def packed_up(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            both = digests(h, row, len(sets))
            new = np.zeros(len(sets), bool)
            if len(seen) > 500_000:  # what is forgotten comes twice to its group and is dropped there
                seen.clear()
            for i, x in enumerate(both[0].tolist()):
                if x not in seen:
                    seen.add(x)
                    new[i] = True
            place, keep = np.cumsum(new) - 1, new[row]
            h, row = h[keep], place[row[keep]]
            heads = np.stack((both[0][new], sizes[new].astype(np.uint64), *sketches(h, row, int(new.sum())).T))
            entries = split_hot(*rare_first(h, row, sizes[new], common, often, threshold), heads[0], common, expected, block)
            ps, blobs = _pack(*entries, heads, prefixes)
            ps.append(-1 - int(both[0][0] % np.uint64(prefixes)))
            blobs.append(np.array(keys, np.int64).tobytes() + both.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), pa.array(blobs, pa.binary())], ["p", "blob"])

        for b in batches:
            keys, sets, held = [], [], 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (h := shingle_hashes(t, width, least_words, table)) is not None:
                    keys.append(k)
                    sets.append(h)
                    held += len(h)
                    if held > 2_500_000:  # long texts: the arrays of one round stay small
                        yield packed_up(keys, sets)
                        keys, sets, held = [], [], 0
            if keys:
                yield packed_up(keys, sets)

    def link(group: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in group.column("blob")]
        if group.column("p")[0].as_py() < 0:
            a, b, c = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in blobs], 1)
            kind = np.ones(len(a), np.int32)
        else:
            a, b = (x.view(np.int64) for x in similar_pairs(*_unpack(blobs), least_bits))
            kind, c = np.zeros(len(a), np.int32), np.zeros(len(a), np.int64)
        return pa.table({"kind": kind, "a": a, "b": b, "c": c})

    packed = d.mapInArrow(emit, "p int, blob binary")
    return cut(packed.groupBy("p").applyInArrow(link, "kind int, a long, b long, c long"), "partenum")


def bits_needed(threshold: float, bits: int, sigmas: float) -> int:
    """Equal sketch bits that a pair of just the wanted similarity falls below in one of many cases (``sigmas``)."""
    p = (1 + threshold) / 2
    return int(np.floor(bits * p - sigmas * np.sqrt(bits * p * (1 - p))))


def near_duplicate_groups(df: DataFrame, key: str = "page_id", text: str = "text", threshold: float = 0.5, width: int = 3, least_words: int = 20, sigmas: float = 4.0, block: int = BLOCK) -> DataFrame:
    """(``key``, group_id, links): a row for each text of at least ``least_words`` words. ``group_id`` is the same for all
    members of a group (of one, where nothing is similar); ``links`` counts all other
    sets of runs that are similar to the text's. Null and shorter texts have no row; keys must be whole numbers.

    Two texts are linked when they share at least ``threshold`` of their distinct runs of ``width`` words; groups are
    closed under links. Texts with equal sets are always in one group.
    """
    found = candidate_links(df, key, text, threshold, width, least_words, sigmas, block=block)
    nodes = found.where("kind = 1").select(F.col("a").alias("k"), F.col("b").alias("node"), F.col("c").alias("more"))
    links = found.where("kind = 0").select("a", "b").distinct()
    # sets are equal where both digests are; a first digest that two sets share only brings more pairs to confirm
    own = cut(nodes.groupBy("node", "more").agg(F.min("k").alias("first")), "classes")
    side = lambda n: own.select(F.col("node").alias(n), F.col("first").alias(f"k{n}"))
    links = cut(links.join(side("a"), "a").join(side("b"), "b").select("ka", "kb"), "links")
    wanted = links.select(F.col("ka").alias("k")).union(links.select("kb")).distinct()
    texts = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(wanted, "k", "left_semi")
    texts = cut(texts, "texts")
    pairs = links.join(texts.select(F.col("k").alias("ka"), F.col("t").alias("ta")), "ka").join(texts.select(F.col("k").alias("kb"), F.col("t").alias("tb")), "kb")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, set] = {}

        def runs(k: int, t: str) -> set:
            if k not in kept:
                if len(kept) > 2000:
                    kept.clear()
                w = _WORD.findall(t.lower())
                kept[k] = set(zip(*(w[i:] for i in range(width))))
            return kept[k]

        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("ka", "kb", "ta", "tb")}
            yes = [i for i in range(b.num_rows) if similarity(runs(c["ka"][i], c["ta"][i]), runs(c["kb"][i], c["tb"][i])) >= threshold - 1e-12]
            yield pa.RecordBatch.from_arrays([pa.array([c[n][i] for i in yes], pa.int64()) for n in ("ka", "kb")], ["a", "b"])

    edges = cut(pairs.select("ka", "kb", "ta", "tb").mapInArrow(confirm, "a long, b long"), "edges")
    groups = connected_components(edges, "a", "b")
    degree = edges.select(F.col("a").alias("first")).union(edges.select("b")).groupBy("first").agg(F.count("*").alias("links"))
    classes = own.join(groups.withColumnRenamed("id", "first"), "first", "left").join(degree, "first", "left")
    classes = classes.select("node", "more", F.coalesce("component", "first").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return nodes.join(classes, ["node", "more"]).select(F.col("k").alias(key), "group_id", "links")


def pairs_within_groups(groups: DataFrame, key: str = "page_id") -> DataFrame:
    """(``key``_a, ``key``_b), a < b: all pairs within groups. Their number is the result's own size."""
    several = groups.groupBy("group_id").count().where("count > 1").select("group_id")
    g = groups.select("group_id", F.col(key).alias("k")).join(several, "group_id", "left_semi")
    a, b = g.alias("a"), g.alias("b")
    return a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.k") < F.col("b.k"))).select(F.col("a.k").alias(f"{key}_a"), F.col("b.k").alias(f"{key}_b"))
