"""Evaluation items inside training documents (problem 6).

Items and documents are brought to words: look-alikes folded, case and accents dropped, runs of letters and digits, one
blank between them. Of each item the rarest words become test strings; by counting, a passage with the wanted share of the
item's words must hold at least ``least`` of them (see ``test_strings``). A Wu-Manber search finds the test strings in
one pass over many documents laid end to end: it jumps as far as no string can be missed, a table over blocks of three
characters tells which of the places it lands on are possible at which shifts, a hash of the window selects a bucket of
strings, and a direct comparison confirms. Documents with enough test strings of an item are confirmed exactly by the
longest common subsequence of words within one passage.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.lookalike import rewriting

_WORDS = re.compile(r"[^\W_]+")


class _Fold(dict):
    """Code point -> what it is read as: its class's plain form, decomposed, without accents and invisible characters, without
    case. Made on demand; there are no more entries than code points."""

    def __init__(self) -> None:
        super().__init__()
        self.plain = rewriting({})

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", self.plain.get(chr(code), chr(code)))
        kept = "".join(self.plain.get(c, c) for c in parts if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        self[code] = out = kept.casefold()
        return out


_FOLD: list[_Fold] = []


def words_of(text: str | None) -> list[str]:
    """Words without case, accents, punctuation, line breaks and look-alike characters; none for null."""
    if not text:
        return []
    if text.isascii():
        return _WORDS.findall(text.lower())
    if not _FOLD:
        _FOLD.append(_Fold())
    return _WORDS.findall(text.translate(_FOLD[0]))


class WuManber:
    """All occurrences of many strings in a text. Blocks have three characters; strings must have at least three.

    All strings are known by their windows, their first ``least`` characters. A window holds ``jump`` blocks, so one of them ends at a
    multiple of ``jump`` wherever the window stands, and only those places are looked at. ``shift`` has for each block (by
    its hash) a bit for each distance from the block's end to a window's end; a place without a bit is passed over.
    """

    BLOCK, BITS = 3, 18

    def __init__(self, strings: list[str]) -> None:
        self.least = m = min(map(len, strings), default=0)
        if strings and m < self.BLOCK:
            raise ValueError("a test string has fewer than three characters")
        self.strings = [*dict.fromkeys(strings)]
        self.jump = max(1, min(16, m - self.BLOCK + 1))
        self.shift = np.zeros(1 << self.BITS, np.uint16)
        self.windows = np.zeros(1 << self.BITS, bool)
        self.bucket: dict[str, list[int]] = defaultdict(list)
        for n, s in enumerate(self.strings):
            code = self._codes(s[:m])
            for far in range(self.jump):
                self.shift[self._hash(code, np.array([m - far]), self.BLOCK)] |= 1 << far
            self.windows[self._hash(code, np.array([m]), m)] = True
            self.bucket[s[:m]].append(n)

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _hash(self, code: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the ``size`` characters before each of the places ``end``."""
        h = np.zeros(len(end), np.uint32)
        for k in range(size, 0, -1):
            h = (h ^ code[end - k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return h >> np.uint32(32 - self.BITS)

    def search(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(begins, numbers of strings) of all occurrences, in no certain order."""
        m, code = self.least, self._codes(text)
        if not m or len(code) < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.arange(self.BLOCK + (-self.BLOCK % self.jump), len(code) + 1, self.jump)
        bits = self.shift[self._hash(code, place, self.BLOCK)]
        place, bits = place[bits > 0], bits[bits > 0]
        begins, numbers = [], []
        for far in range(self.jump):
            end = place[(bits >> far & 1) > 0] + far
            end = end[(end >= m) & (end <= len(code))]
            for b in (end[self.windows[self._hash(code, end, m)]] - m).tolist():
                for n in self.bucket.get(text[b : b + m], ()):
                    if text.startswith(self.strings[n], b):
                        begins.append(b)
                        numbers.append(n)
        return np.array(begins, np.int64), np.array(numbers, np.int64)


def common_length(masks: dict[str, int], words: list[str], size: int) -> int:
    """Length of the longest common subsequence of an item (bit masks of its words) and ``words``, bit by bit."""
    row, full = (1 << size) - 1, (1 << size) - 1
    for w in words:
        if m := masks.get(w):
            x = row & m
            row = ((row + x) | (row - x)) & full
    return size - row.bit_count()


class Items:
    """Test items made ready. share: part of an item's words that a passage must hold; longer: a passage may have so many
    times as many words as the item."""

    def __init__(self, items: list[tuple[int, str | None]], share: float = 0.55, longer: float = 1.3) -> None:
        self.share, self.longer = share, longer
        self.words = {i: w for i, t in items if (w := words_of(t))}
        spread = Counter(x for w in self.words.values() for x in set(w))
        self.masks, self.need, self.least, self.of = {}, {}, {}, defaultdict(list)
        self.spread = {i: Counter(w) for i, w in self.words.items()}
        for i, w in self.words.items():
            self.masks[i] = defaultdict(int)
            for k, x in enumerate(w):
                self.masks[i][x] |= 1 << k
            self.need[i] = math.ceil(share * len(w) - 1e-9)
            for x in self.test_strings(i, spread):
                self.of[f" {x} "].append(i)
        self.search = WuManber(list(self.of))
        self.ids = list(self.words)
        at = {i: k for k, i in enumerate(self.ids)}
        lists = [[at[i] for i in self.of[s]] for s in self.search.strings]
        self.item = np.array([k for x in lists for k in x], np.int64)
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        self.least_of = np.array([self.least[i] for i in self.ids], np.int64)

    def test_strings(self, i: int, spread: Counter) -> set[str]:
        """Of an item of n words a passage must hold k = ceil(share * n). Any set of its word places that has n - k + t
        places is hit t times at least. Places are taken by rarity among the items, then length, until t is 3 (less where the item is
        short); ``least[i]`` is the smallest number of different strings that t hits can be."""
        w = self.words[i]
        places = sorted(range(len(w)), key=lambda k: (len(w[k]) < 5, len(w[k]) < 4, spread[w[k]], -len(w[k]), k))
        miss = len(w) - self.need[i]
        # words of fewer than four letters would shorten all jumps, so they are only taken where they are needed
        taken = places[: min(len(w), max(miss + 1, min(miss + 3, sum(len(x) > 3 for x in w))))]
        hits, counts, self.least[i] = len(taken) - miss, sorted(Counter(w[k] for k in taken).values(), reverse=True), 0
        while hits > 0:
            hits -= counts[self.least[i]]
            self.least[i] += 1
        return {w[k] for k in taken}

    #: Characters that are searched at a time.
    AT_ONCE = 3_000_000

    def in_texts(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(number of the text, item, share of its words in the best passage) of the items found."""
        found: list[tuple[int, int, float]] = []
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, t in enumerate(texts):
            if words := words_of(t):
                held.append((k, words))
                size += len(t)  # type: ignore[arg-type]
            if size > self.AT_ONCE or k == len(texts) - 1:
                found += self._among(held)
                held, size = [], 0
        return found

    def _among(self, held: list[tuple[int, list[str]]]) -> list[tuple[int, int, float]]:
        if not held or not self.ids:
            return []
        lines = [" " + " ".join(w) + " " for _, w in held]
        begins, numbers = self.search.search("".join(lines))
        ends = np.cumsum([len(x) for x in lines])
        # each test string once for each text, then for each item that has it
        hit = np.unique(np.searchsorted(ends, begins, side="right") * len(self.search.strings) + numbers)
        doc, number = np.divmod(hit, len(self.search.strings))
        n = self.first[number + 1] - self.first[number]
        at = np.repeat(self.first[number] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pair, hits = np.unique(np.repeat(doc, n) * len(self.ids) + self.item[at], return_counts=True)
        doc, item = np.divmod(pair, len(self.ids))
        enough = hits >= self.least_of[item]
        out, last, there = [], -1, set()
        for d, k in zip(doc[enough].tolist(), item[enough].tolist()):
            i, words = self.ids[k], held[d][1]
            if d != last:
                last, there = d, set(words)
            own = self.spread[i]
            if sum(own[x] for x in own.keys() & there) < self.need[i]:  # too few of its words anywhere
                continue
            if (best := self.best_passage(i, words)) >= self.need[i]:
                out.append((held[d][0], i, best / len(self.words[i])))
        return out

    def best_passage(self, i: int, words: list[str]) -> int:
        masks, n = self.masks[i], len(self.words[i])
        if (top := common_length(masks, words, n)) < self.need[i]:
            return top
        size = max(n, int(self.longer * n))
        return max((common_length(masks, words[k : k + size], n) for k, w in enumerate(words) if w in masks), default=0)


_READY: dict[tuple, Items] = {}


def made_ready(name: object, items: list[tuple[int, str | None]], share: float, longer: float) -> Items:
    """The items of a broadcast, made ready once for each Python worker; only the last ones are kept."""
    if (key := (name, len(items), share, longer)) not in _READY:
        _READY.clear()
        _READY[key] = Items(items, share, longer)
    return _READY[key]


def leaked(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = 0.55, longer: float = 1.3, block: int = 20_000) -> DataFrame:
    """(``key``, ``item_key``, share_found): every document that holds an item fully or for the most part.

    Items go out to all tasks in blocks of at most ``block`` items, each a pass over the documents, so what is sent
    is bounded whatever the number of items; the usual test set is one block. No shuffle. Null and empty documents and items
    without a word give no row; equal items are found each under its own id.
    """
    rows = items.select(item_key, item_text).where(F.col(item_text).isNotNull())
    kind, out = dict(df.dtypes)[key], []
    item_kind = dict(items.dtypes)[item_key]
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, share_found double"
    part: list[tuple[int, str | None]] = []

    def scan(chunk: list[tuple[int, str | None]]) -> DataFrame:
        sent, name = df.sparkSession.sparkContext.broadcast(chunk), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = made_ready(name, sent.value, share, longer)
            for b in batches:
                at, ids, shares = [*zip(*ready.in_texts(b.column(1).to_pylist()))] or ([], [], [])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(ids, items_type), pa.array(shares, pa.float64())], [key, item_key, "share_found"])

        return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    items_type = to_arrow_type(items.schema[item_key].dataType)
    for r in rows.toLocalIterator():
        part.append((r[0], r[1]))
        if len(part) == block:
            out.append(scan(part))
            part = []
    if part or not out:
        out.append(scan(part))
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    return done
