"""Subject areas of documents (problem 2).

Sentences are embedded: their words and pairs of words are weighted by rarity and by how unevenly they occur under the labels
there are, and projected by a truncated singular value decomposition of a page-term matrix. Seed centroids are the means of
labelled pages; they are refined by assigning sentences by cosine similarity and taking the means again. A page treats
the subjects that enough of its sentences are assigned to, whatever its own label says.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"(?<=[.!?…])[\"»”)]*\s+|\n\s*\n")
_LINK = re.compile(r"(?:https?://|www\.)\S*")
_BREAK = re.compile(r"\s+[-–—*•|/]+\s+(?=[^\W\d_a-zà-ÿ]|¿)|[,;]\s+(?=[A-ZÀ-ÖØ-Þ¿])")
#: A page is read as one without full stops when its sentences have more words than this on average.
LONG = 35


def line_key(line: str) -> str:
    """What two printings of one standing line have in common; empty for lines of fewer than three words."""
    w = _WORD.findall(line.lower())
    return " ".join(w) if len(w) >= 3 else ""


def _without_standing(lines: list[str], standing: frozenset[str]) -> list[str]:
    """Lines without those standing lines that interrupt a sentence: the line before has no end and the next goes on in
    lower case."""
    out: list[str] = []
    for k, x in enumerate(lines):
        before, after = out[-1].rstrip() if out else "", lines[k + 1].lstrip() if k + 1 < len(lines) else ""
        if before and after[:1].islower() and before[-1] not in ".!?…:" and line_key(x) in standing:
            continue
        out.append(x)
    return out


def statements(text: str, starts: frozenset[tuple[str, str]] = frozenset(), standing: frozenset[str] = frozenset()) -> list[str]:
    """Sentences of a text. Lines are joined, as they may be broken anywhere; header lines (two words at most before a colon)
    at the begin are left out. Where full stops are missing, statements are parted by dashes and by commas before a capital,
    and before two words of which ``starts`` knows that sentences begin with them."""
    lines = text.split("\n")
    k = 0
    while k < min(4, len(lines) - 1) and re.match(r"^[ \t]*[^\W\d_]+(?: [^\W\d_]+)? ?(?:\d+ ?)?:", lines[k]):
        k += 1
    rest = _without_standing(lines[k:], standing) if standing else lines[k:]
    body = _LINK.sub(" ", "\n".join(rest))
    parts = [s for s in _STOP.split(body) if s and not s.isspace()]
    out = []
    for s in parts:
        if len(s.split()) <= LONG:
            out.append(s)
            continue
        for x in _BREAK.split(s.replace("\n", " ")):
            out += _at_starts(x, starts) if len(x.split()) > LONG // 2 else [x]
    return out


def _at_starts(s: str, starts: frozenset[tuple[str, str]]) -> list[str]:
    words, out, at = s.split(), [], 0
    for k in range(3, len(words) - 2):
        if words[k][:1].isupper() and k - at >= 3 and start_of(words[k : k + 2]) in starts:
            out.append(" ".join(words[at:k]))
            at = k
    return [*out, " ".join(words[at:])]


def start_of(words: list[str]) -> tuple[str, str]:
    return tuple(w if w.isalpha() or not any(c.isdigit() for c in w) else "0" for w in words[:2])  # type: ignore[return-value]


def terms(sentence: str) -> list[str]:
    """Words and pairs of words, in lower case, without numbers."""
    w = _WORD.findall(sentence.lower())
    return w + [*map(" ".join, zip(w, w[1:]))]


@dataclass
class Model:
    """terms: term -> row of ``vectors`` (its weighted projection); weights: by term; centroids: (subjects, k), of length 1;
    subjects: their ids; starts, standing: see ``statements``. ``least_dot`` and ``least_mass`` are what a sentence that
    treats a subject reaches; ``also`` is the part of the best subject's similarity at which a second one counts too."""

    terms: dict[str, int]
    vectors: np.ndarray
    weights: np.ndarray
    centroids: np.ndarray
    subjects: list[int]
    starts: frozenset[tuple[str, str]] = frozenset()
    standing: frozenset[str] = frozenset()
    least_dot: float = 0.1
    least_mass: float = 6.0
    also: float = 0.5

    def ready(self) -> "Model":
        """Similarities are sums over a sentence's terms, so each term's own share of them is worked out once; pairs are looked up
        by their first word."""
        self.own = np.concatenate((self.vectors @ self.centroids.T, self.weights[:, None]), 1).astype(np.float32) if self.terms else np.zeros((0, len(self.subjects) + 1), np.float32)
        self.words, self.pairs = {}, {}
        for t, i in self.terms.items():
            a, _, b = t.partition(" ")
            if b:
                self.pairs.setdefault(a, {})[b] = i
            else:
                self.words[a] = i
        return self

    def places(self, sentence: str) -> set[int]:
        """Rows of the terms of a sentence that are known."""
        w = _WORD.findall(sentence.lower())
        words, pairs = self.words, self.pairs
        at = {words[x] for x in w if x in words}
        at.update(pairs[a][b] for a, b in zip(w, w[1:]) if a in pairs and b in pairs[a])
        return at

    def pages(self, texts: list[str | None]) -> list[tuple[dict[int, int], int]]:
        """For each text (subject -> sentences that treat it, sentences that treat any)."""
        col: list[int] = []
        sizes: list[int] = []
        owner: list[int] = []
        for k, text in enumerate(texts):
            for s in statements(text, self.starts, self.standing) if text else ():
                if at := self.places(s):
                    col.extend(at)
                    sizes.append(len(at))
                    owner.append(k)
        out: list[tuple[dict[int, int], int]] = [({}, 0) for _ in texts]
        if not sizes:
            return out
        start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        total = np.add.reduceat(self.own[np.array(col)], start)
        sim, top = total[:, :-1], total[:, :-1].max(1)
        some = (total[:, -1] >= self.least_mass) & (top >= self.least_dot)
        of = np.array(owner)
        treating = np.bincount(of[some], minlength=len(texts))
        row, subject = np.nonzero((sim >= self.also * top[:, None]) & some[:, None])
        pair, n = np.unique(of[row] * len(self.subjects) + subject, return_counts=True)
        for p, c in zip(pair.tolist(), n.tolist()):
            k, j = divmod(p, len(self.subjects))
            out[k][0][self.subjects[j]] = c
        return [(found, int(treating[k])) for k, (found, _) in enumerate(out)]

    def page(self, text: str | None) -> tuple[dict[int, int], int]:
        return self.ready().pages([text])[0]


def csr_dot(start: np.ndarray, col: np.ndarray, val: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix, in slices of bounded memory."""
    n, out, step = len(start) - 1, np.zeros((len(start) - 1, x.shape[1]), np.float32), 2000
    for a in range(0, n, step):
        b = min(n, a + step)
        s, e = start[a], start[b]
        if s < e:
            rows = np.nonzero(start[a + 1 : b + 1] > start[a:b])[0]
            out[a + rows] = np.add.reduceat(x[col[s:e]] * val[s:e, None], start[a + rows] - s)
    return out


def truncated_svd(start: np.ndarray, col: np.ndarray, val: np.ndarray, columns: int, k: int, rounds: int = 3, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns x k) of a sparse matrix, by randomised subspace iteration."""
    n = len(start) - 1
    row = np.repeat(np.arange(n), np.diff(start))
    order = np.argsort(col, kind="stable")
    t_start, t_row, t_val = np.searchsorted(col[order], np.arange(columns + 1)), row[order], val[order]
    k = max(1, min(k, n, columns))
    q = np.random.default_rng(seed).standard_normal((columns, min(columns, k + 10))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(csr_dot(t_start, t_row, t_val, csr_dot(start, col, val, q)))
    b = csr_dot(start, col, val, q)
    _, s, vt = np.linalg.svd(b, full_matrices=False)
    return s[:k], (q @ vt[:k].T).astype(np.float32)


def term_weights(count: Iterable[tuple[str, list[int]]], base: list[int]) -> dict[str, float]:
    """Weight of each term from its page counts under every label (and, last, without): rarity times the divergence of its labels from
    all pages' labels, less what chance alone would make of so few pages. Terms that say nothing get none."""
    labelled, documents = np.array(base[:-1], float), max(1, sum(base))
    prior = labelled / max(1, labelled.sum())
    out = {}
    for t, c in count:
        lab = np.array(c[:-1], float)
        m, n = lab.sum(), sum(c)
        if m < 3 or n > 0.3 * documents:
            continue
        p = lab / m
        seen = p > 0
        gain = float((p[seen] * np.log(p[seen] / np.maximum(prior[seen], 1e-6))).sum()) - (len(prior) - 1) / (2 * m)
        if gain > 0.12:
            out[t] = gain * math.log(1 + documents / n)
    return out


def fit_model(pages: list[tuple[str, int | None]], weights: dict[str, float], subjects: list[int], starts: frozenset[tuple[str, str]] = frozenset(), standing: frozenset[str] = frozenset(), k: int = 120, refine: int = 3) -> Model:
    """Fit on sample pages (text, subject named by the label or null)."""
    vocabulary = {t: i for i, t in enumerate(sorted(weights))}
    w = np.array([weights[t] for t in sorted(weights)], np.float32)
    sents = [[np.fromiter({vocabulary[t] for t in terms(s) if t in vocabulary}, np.int64) for s in statements(text, starts, standing)] for text, _ in pages]
    rows = [np.concatenate([np.zeros(0, np.int64), *x]) for x in sents]
    start = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    col = np.concatenate([np.zeros(0, np.int64), *rows])
    if not len(col) or not subjects:
        return Model({}, np.zeros((1, 1), np.float32), np.zeros(1, np.float32), np.zeros((len(subjects), 1), np.float32), subjects, starts, standing)
    val = w[col]
    norm = np.sqrt(np.maximum(1e-9, np.add.reduceat(np.concatenate((val**2, [0])), np.minimum(start[:-1], len(val)))))
    val = (val / np.repeat(norm, np.diff(start))).astype(np.float32)
    _, v = truncated_svd(start, col, val, len(vocabulary), k)
    vectors = v * w[:, None]
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)
    flat = [x for p in sents for x in p if len(x)]
    owner = np.array([i for i, p in enumerate(sents) for x in p if len(x)])
    e = unit(np.stack([vectors[x].sum(0) for x in flat]))
    mass = np.array([w[x].sum() for x in flat])
    label = np.array([subjects.index(l) if l in subjects else -1 for _, l in pages])[owner]
    c = np.stack([e[label == j].mean(0) if (label == j).any() else np.zeros(e.shape[1]) for j in range(len(subjects))])
    c = unit(c - c.mean(0))
    for _ in range(refine):
        sim = e @ c.T
        best = sim.argmax(1)
        top2 = np.partition(sim, -2, axis=1)[:, -2] if len(subjects) > 1 else np.zeros(len(sim))
        good = (sim.max(1) - top2 > 0.02) & (mass > np.quantile(mass, 0.1))
        c = unit(np.stack([(e[good & (best == j)].mean(0) if (good & (best == j)).any() else c[j]) for j in range(len(subjects))]))
    # What a sentence must reach is set against what the sample's sentences that say something reach.
    dots = (np.stack([vectors[x].sum(0) for x in flat]) @ c.T).max(1)
    least_dot, least_mass = 0.024 * float(np.quantile(dots, 0.75)), 0.12 * float(np.quantile(mass, 0.75))
    return Model(vocabulary, vectors.astype(np.float32), w, c.astype(np.float32), subjects, starts, standing, least_dot, least_mass)


def label_subject(categories: DataFrame, name: Column, number: Column, part: Column) -> tuple[list[int], Column]:
    """(ids, the subject that a row's labels name): by the name in any case and spelling of "and", else the id, else the
    subcategory; null where none of them is known. The category tree is a configuration and is collected."""
    rows = [r for r in categories.select("category_id", "category_name", "subcategory").distinct().collect() if r[0] is not None]
    ids = sorted({r[0] for r in rows})
    plain = lambda x: " ".join(x.lower().replace("&", " and ").split())
    names, parts = {plain(r[1]): r[0] for r in rows if r[1]}, {plain(r[2]): r[0] for r in rows if r[2]}

    def lookup(table: dict[str, int], c: Column) -> Column:
        if not table:
            return F.lit(None).cast("int")
        key = F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), r"\s+", " "))
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)

    return ids, F.coalesce(lookup(names, name), F.when(number.isin(*ids), number) if ids else F.lit(None).cast("int"), lookup(parts, part))


@dataclass
class Fitting:
    """Bounds of the fit. pages: at most about so many sample pages (by a hash of their key); share: a term, a standing line or a
    sentence begin must be on one of so many pages, which bounds the vocabulary whatever the corpus; least: and on so many."""

    pages: int = 8000
    share: int = 2500
    least: int = 6


def fit(df: DataFrame, categories: DataFrame, key: str = "page_id", text: str = "text", bounds: Fitting = Fitting()) -> Model:
    """Counts over all pages, then the model on a bounded sample of them. Pages come with category_name, category_id and
    subcategory, any of which may be null, wrong or empty."""
    ids, subject = label_subject(categories, F.col("category_name"), F.col("category_id"), F.col("subcategory"))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, ids)), subject) - 1, F.lit(-1)).cast("int") if ids else F.lit(-1)
    d = df.select(F.col(key).alias("k"), F.col(text).alias("t"), place.alias("l")).where(F.length("t") > 0)
    n = len(ids) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, str] = {}
        for b in batches:
            total = [[Counter() for _ in range(n)] for _ in range(4)]
            for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = l if l >= 0 else n - 1
                total[3][at][""] += 1
                sents = statements(t)
                seen: set = set()
                for s in sents:
                    w = _WORD.findall(s.lower())
                    seen.update(w)
                    seen.update(zip(w, w[1:]))  # pairs are joined to terms once for a batch
                total[0][at].update(seen)
                if len(keys) > 100_000:
                    keys.clear()
                lines = set()
                for x in t.split("\n"):
                    if (k := keys.get(x)) is None:
                        k = keys[x] = line_key(x)
                    lines.add(k)
                lines.discard("")
                total[1][at].update(lines)
                begins = total[2][at]
                for s in sents:
                    w = s.split()
                    if 3 < len(w) <= LONG:
                        begins["\t".join(("s", *start_of(w)))] += 1
                        begins.update(["\t".join(("a", *start_of(w[i : i + 2]))) for i in range(len(w) - 1) if w[i][:1].isupper()])
            for kind, by in enumerate(total):
                what, c = [*set().union(*by)], []
                c = [[x[w] for x in by] for w in what]
                what = [x if isinstance(x, str) else " ".join(x) for x in what]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(what), pa.int32()), pa.array(what, pa.string()), pa.array(c, pa.list_(pa.int64()))], ["kind", "what", "c"])

    counted = d.select("t", "l").mapInArrow(count, "kind int, what string, c array<long>")
    sums = counted.groupBy("kind", "what").agg(F.array(*(F.sum(F.col("c")[j]) for j in range(n))).alias("c"))
    pages = d.count()
    often = F.aggregate("c", F.lit(0).cast("long"), lambda x, y: x + y) >= max(bounds.least, pages // bounds.share)
    kept: dict[int, list[tuple[str, list[int]]]] = {0: [], 1: [], 2: [], 3: []}
    for r in sums.where(often | (F.col("kind") == 3)).toLocalIterator():
        kept[r["kind"]].append((r["what"], list(r["c"])))
    base = kept[3][0][1] if kept[3] else [0] * n
    begins = {tuple(x.split("\t")): sum(c) for x, c in kept[2]}
    starts = frozenset(x[1:] for x, c in begins.items() if x[0] == "s" and c >= 0.5 * begins.get(("a", *x[1:]), 0))
    standing = frozenset(x for x, _ in kept[1])
    part = min(1.0, bounds.pages / max(1, pages))
    sample = d.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(part * (1 << 20)) if part < 1 else F.lit(True)).select("k", "t", "l").collect()
    rows = [(r["t"], ids[r["l"]] if r["l"] >= 0 else None) for r in sorted(sample, key=lambda r: (r["k"] is None, r["k"], r["t"]))]
    return fit_model(rows, term_weights(sorted(kept[0]), base), ids, starts, standing)


def assigned(df: DataFrame, model: Model, key: str = "page_id", text: str = "text") -> DataFrame:
    """(``key``, category_id, sentences, treating): a row for each page and subject, ``sentences`` being those of the page that
    treat the subject and ``treating`` those that treat any. Null, empty and subjectless texts have no row; equal rows of the
    input give equal rows. No shuffle; the model that goes out is bounded by ``Fitting``."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value.ready()
        for b in batches:
            rows = [(k, j, n, every) for k, (found, every) in enumerate(m.pages(b.column(1).to_pylist())) for j, n in sorted(found.items())]
            at, *columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int32()) for c in columns)], [key, "category_id", "sentences", "treating"])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, category_id int, sentences int, treating int")


def subjects_of(df: DataFrame, model: Model, key: str = "page_id", text: str = "text", least: int = 2, share: float = 0.25) -> DataFrame:
    """(``key``, category_id), each once: the subjects that at least ``least`` sentences and at least ``share`` of those that
    treat any subject are about."""
    d = assigned(df, model, key, text).where((F.col("sentences") >= least) & (F.col("sentences") >= share * F.col("treating") - 1e-9))
    return d.select(key, "category_id").distinct()
