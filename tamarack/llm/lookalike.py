"""One form for texts that look the same (problem 8).

Characters and short strings are nodes; an edge says that two of them look the same. Edges come from rules over the
Unicode tables (composition, width, blanks, invisible characters, ligatures) and from one fixed list of letters of other
scripts that are drawn like Latin ones. Union-find makes transitive classes of them, each class takes its most frequent
member in the corpus as representative (ties: the smallest string), and a multi-pattern automaton rewrites texts
greedily, longest match first, from left to right. The result is composed (NFC).
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters they are drawn like.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "ѕ": "s", "і": "i",
    "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j",
}
CHEROKEE = {
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
ARMENIAN = {"ո": "n", "օ": "o", "ս": "u", "հ": "h", "յ": "j", "Օ": "O", "Տ": "S", "Լ": "L"}
OTHER = {"ɡ": "g", "ⅼ": "l", "‐": "-", "‑": "-", "…": "...", "․": ".", "‚": ",", "ʹ": "'"}
#: Compatibility tags of the Unicode tables under which both sides are drawn alike.
TAGS = ("<wide>", "<narrow>", "<noBreak>")
#: Ligatures of the block U+FB00 to U+FB06 look like the letters they join.
LIGATURES = range(0xFB00, 0xFB07)
#: Invisible characters besides those of category Cf.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0xFE00, 0xFE10)}


#: Parts into which the rows of one text are spread when pairs of rows are made.
SALTS = 16


class Classes:
    """Union-find over strings; the root of a class is arbitrary, members are kept."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return out


def edges() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look the same. The empty string stands for what can't be seen."""
    for table in (CYRILLIC, GREEK, CHEROKEE, ARMENIAN, OTHER):
        yield from table.items()
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Cf" or code in INVISIBLE:
            yield ch, ""
        elif kind == "Zs":
            yield ch, " "
        elif (form := unicodedata.decomposition(ch)) and kind != "Cn":
            if form.split()[0] in TAGS or code in LIGATURES:
                yield ch, unicodedata.normalize("NFKC", ch)
            elif form[0] != "<":
                if (one := unicodedata.normalize("NFC", ch)) != ch:
                    yield ch, one
                yield ch, unicodedata.normalize("NFD", ch)


@cache
def classes() -> dict[str, tuple[str, ...]]:
    """Root -> members, of the classes of more than one member."""
    uf = Classes()
    for a, b in edges():
        uf.union(a, b)
    # an accented letter of another script looks like the Latin letter with that accent
    bases = CYRILLIC | GREEK | CHEROKEE | ARMENIAN
    for x in list(uf.up):
        form = unicodedata.normalize("NFD", x)
        if len(form) > 1 and form[0] in bases:
            uf.union(x, unicodedata.normalize("NFC", bases[form[0]] + form[1:]))
    return {r: tuple(sorted(m)) for r, m in uf.members().items() if len(m) > 1}


def rewriting(counts: dict[str, int]) -> dict[str, str]:
    """member -> representative, for members that aren't their own representative. Members of several characters count
    as the rarest of their characters; what can't be seen is always removed, and blanks become the plain blank."""
    out: dict[str, str] = {}
    for members in classes().values():
        if "" in members:
            best = ""
        else:
            # only composed forms: the rewritten text is composed, and a representative has to survive that
            weight = {m: min(counts.get(c, 0) for c in m) for m in members if unicodedata.normalize("NFC", m) == m}
            top = max(weight.values(), default=0)
            best = min((m for m in weight if weight[m] == top), key=lambda m: (len(m), m), default=unicodedata.normalize("NFC", members[0]))
        out |= {m: best for m in members if m != best and m}
    return out


class Rewriter:
    """Leftmost, longest replacement by a table, then canonical composition."""

    def __init__(self, table: dict[str, str]) -> None:
        import ahocorasick

        self.table = table
        self.plain = not any(k.isascii() for k in table)
        # Where no member is plain ASCII, each holds one of these, and a composed text without any of them stays as it is.
        self.needs = frozenset(c for k in table for c in k if not c.isascii())
        self.auto = ahocorasick.Automaton()
        for k, v in table.items():
            self.auto.add_word(k, (len(k), v))
        if table:
            self.auto.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        if not text or not self.table:
            return text
        if self.plain and (text.isascii() or self.needs.isdisjoint(text) and unicodedata.is_normalized("NFC", text)):
            return text
        # Composing may make a new member, such as a look-alike letter that took an accent; each further round needs one.
        for _ in range(len(text) + 2):
            if (done := self._once(text)) == text:
                return text
            text = done
        raise RuntimeError("a text didn't settle")

    def _once(self, text: str) -> str:
        out, at = [], 0
        for end, (n, to) in self.auto.iter_long(text):
            start = end - n + 1
            if start > at:
                out.append(text[at:start])
            out.append(to)
            at = end + 1
        out.append(text[at:])
        return unicodedata.normalize("NFC", "".join(out))


def corpus_counts(df: DataFrame, text: str) -> dict[str, int]:
    """Counts over all rows of the characters that belong to a class: at most one number for each code point in a class,
    whatever the size of the corpus."""
    wanted = {c for m in classes().values() for x in m for c in x}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            total.update("".join(x for x in b.column(0).to_pylist() if x))
        rows = [(c, n) for c, n in total.items() if c in wanted]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["ch", "n"])

    rows = df.select(F.col(text)).mapInArrow(count, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n")).collect()
    return {r["ch"]: r["n"] for r in rows}


def rewriter_for(df: DataFrame, text: str) -> dict[str, str]:
    return rewriting(corpus_counts(df, text))


def canonical_udf(table: dict[str, str]):
    """A pandas UDF string -> string. The table goes out once for each executor; its size is bounded by Unicode."""
    from pyspark.sql import SparkSession

    sent = SparkSession.getActiveSession().sparkContext.broadcast(table)

    @F.pandas_udf("string")
    def rewrite(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = Rewriter(sent.value)
        for s in texts:
            yield s.map(run, na_action="ignore")

    return rewrite


def canonicalise(df: DataFrame, text: str = "text", into: str = "canonical", table: dict[str, str] | None = None) -> DataFrame:
    """Add ``into``: ``text`` with every look-alike replaced by its class's representative.

    Null stays null and empty stays empty; a column named ``into`` that exists is replaced; other columns are kept.
    """
    table = rewriter_for(df, text) if table is None else table
    return df.withColumn(into, canonical_udf(table)(F.col(text)))


def _digest(c: Column) -> Column:
    return F.sha2(c, 256)


def same_looking_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``_a, ``key``_b), a < b: rows whose texts differ in their characters but have one canonical form.

    Rows with null or blank text or a null key are in no pair; rows that are repeated with their key count once. Only digests
    are shuffled. Pairs are made of the distinct texts of a form, and rows come in afterwards, so exact copies never meet
    each other; the rows of each text are salted into ``SALTS`` parts, as one text may hold most rows.
    """
    d = canonicalise(df.select(key, text).where(F.length(F.trim(F.col(text))) > 0), text, "canonical")
    d = d.select(F.col(key).alias("k"), _digest(F.col(text)).alias("raw"), _digest(F.col("canonical")).alias("form")).where("k is not null")
    from tamarack.runtime import cut

    d = cut(d, "lookalike")
    texts = d.select("form", "raw").distinct()
    several = texts.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo < hi").select("form")
    texts = texts.join(several, "form", "left_semi")
    a, b = texts.alias("a"), texts.alias("b")
    pairs = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.raw") < F.col("b.raw"))).select(F.col("a.raw").alias("raw_a"), F.col("b.raw").alias("raw_b"))
    salt = F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")
    rows = d.join(texts.select("raw"), "raw", "left_semi").select("raw", "k", salt.alias("salt")).distinct()
    pairs = pairs.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    half = pairs.join(rows.select(F.col("raw").alias("raw_a"), F.col("k").alias("ka"), "salt"), ["raw_a", "salt"]).drop("salt")
    half = half.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    both = half.join(rows.select(F.col("raw").alias("raw_b"), F.col("k").alias("kb"), "salt"), ["raw_b", "salt"])
    return both.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
