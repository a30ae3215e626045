"""True languages of texts and of their segments (problem 5), by compression.

Each language has a raw-content dictionary for zstandard, made of sample sentences; the language whose dictionary gives the
smallest encoding of a piece of text is its language, and pieces with a narrow margin are rejected (they take their
neighbours' language, or none). Dictionaries are fitted on a bounded sample of labelled rows, after
sentences that don't speak their label's language have been moved or left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of languages as they occur in labels, in ISO codes, English, French and the language itself.
NAMES = {
    "en": "en eng english anglais inglés ingles inglês englisch", "fr": "fr fra fre french français francais francés frances francês französisch",
    "es": "es spa spanish espagnol español espanol espanhol spanisch", "pt": "pt por portuguese portugais portugués portugues português portugiesisch",
    "de": "de deu ger german allemand alemán aleman alemão deutsch", "ar": "ar ara arabic arabe árabe arabisch العربية عربي",
    "it": "it ita italian italien italiano italienisch", "nl": "nl nld dut dutch néerlandais neerlandés holandês nederlands niederländisch",
}
#: Label values that name no language.
UNNAMED = ("", "und", "unknown", "auto", "none", "null", "nan", "n/a", "mul", "zxx", "?", "-")


def label_language(label: Column) -> Column:
    """ISO code of a label in any spelling (case, region, name of the language); null where it names none; a name that
    isn't known comes out as it is, as a label that names some other language."""
    from itertools import chain as flat

    t = F.lower(F.trim(label))
    table = F.create_map(*flat.from_iterable((F.lit(n), F.lit(code)) for code, names in NAMES.items() for n in names.split()))
    base = F.regexp_extract(t, r"^(\p{L}+)(?:[-_].*)?$", 1)
    return F.when(label.isNull() | t.isin(*UNNAMED), F.lit(None)).otherwise(F.coalesce(F.try_element_at(table, t), F.try_element_at(table, base), t))


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HEAD = re.compile(r"[^\W\d_]+(?: [^\W\d_]+)? ?(?:\d+ ?)?: ?[^\n]{0,200}")
_DEAD = re.compile(r"[\d@]|://|www\.")
_ARABIC = re.compile(r"[\u0600-\u06ff]")
_STOP, _MARKS = frozenset(".!?…؟。,;:،؛)"), frozenset(("*", "•", ">", ">>", "|", "/", "—", "-", "·"))


def _body(text: str) -> str:
    """A text in lower case without the header lines at its begin; blank lines hold a mark."""
    lines = text.lower().split("\n")
    k = 0
    while k < len(lines) - 1 and (_HEAD.fullmatch(lines[k].strip()) or not lines[k].strip()):
        k += 1
    return "\n".join(x if x and not x.isspace() else "*" for x in lines[k:])


def units(text: str, shortest: int = 4, longest: int = 20) -> list[str]:
    """Clauses in lower case, each on one line, without header lines at the begin; words with digits and links become
    ``0``. A clause ends at punctuation, a blank line, a bullet or a change of script; one of fewer than ``shortest`` words joins
    the next one of its script (the last the one before); a stretch without punctuation is cut after ``longest`` words."""
    arabic = bool(_ARABIC.search(text))
    all_words = _body(text).split()
    out: list[str] = []
    words: list[str] = []
    real = script = at = 0

    def close() -> None:
        nonlocal words, real
        if real >= shortest:
            out.append(" ".join(words))
            words, real = [], 0

    def plain(upto: int) -> None:
        """Words of letters only: they need no closer look."""
        nonlocal real, at
        while upto - at >= longest - real:
            take = at + longest - real
            words.extend(all_words[at:take])
            at, real = take, longest
            close()
        words.extend(all_words[at:upto])
        real += upto - at

    for i in [i for i, w in enumerate(all_words) if arabic or not w.isalpha()]:
        w = all_words[i]
        plain(i)
        at = i + 1
        if w in _MARKS:
            close()
            continue
        if not w.isalpha() and _DEAD.search(w):
            w = "0" + (w[-1] if w[-1] in _STOP else "")
        elif arabic:
            if (now := 1 if _ARABIC.search(w) else 2 if w[0].isalpha() else script) != script and words:
                if script:
                    if real < shortest and out and bool(_ARABIC.search(out[-1])) == (script == 1):
                        out[-1] += " " + " ".join(words)
                    elif real >= shortest - 1:
                        out.append(" ".join(words))
                    words, real = [], 0
            script = now
            real += 1
        else:
            real += w[0].isalpha() or len(w) > 1
        words.append(w)
        if w[-1] in _STOP or real >= longest:
            close()
    plain(len(all_words))
    close()
    if words and out and bool(_ARABIC.search(out[-1])) == bool(_ARABIC.search(" ".join(words))):
        out[-1] += " " + " ".join(words)
    elif real >= shortest - 1:
        out.append(" ".join(words))
    return out


class Dictionaries:
    """Compressors by language. raw: language -> dictionary content."""

    LEVEL = 3
    #: Sizes of so many pieces are remembered; the memory is emptied when it is full.
    KNOWN = 200_000

    def __init__(self, raw: dict[str, bytes]) -> None:
        import zstandard as z

        self.langs = sorted(raw)
        self.arabic = self.langs.index("ar") if "ar" in raw and len(raw) > 1 else None
        self.known: dict[str, list[int]] = {}
        self.by = []
        for lang in self.langs:
            d = z.ZstdCompressionDict(raw[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.LEVEL)
            self.by.append(z.ZstdCompressor(level=self.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, pieces: Iterable[str]) -> dict[str, list[int]]:
        """Encoded sizes of pieces in every language, in the order of ``langs``. Pieces go through one dictionary after the other,
        so that its tables stay in the processor's cache."""
        if len(self.known) > self.KNOWN:
            self.known = {}
        known = self.known
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        coded = [p.encode("utf-8", "replace") for p in new]
        columns = []
        for k, c in enumerate(self.by):
            if k == self.arabic:  # what doesn't hold a letter of its script can't be it
                columns.append([len(c(b)) if len(b) > len(p) and _ARABIC.search(p) else len(b) + 16 for p, b in zip(new, coded)])
            else:
                columns.append([*map(len, map(c, coded))])
        known.update(zip(new, map(list, zip(*columns))))
        return known


class Detector:
    """Segments of a text with their languages.

    switch: bytes that a change of language between two sentences has to save; split: bytes that a change within a sentence
    has to save; narrow: relative margin under which a segment's language is rejected; words: a segment of another
    language has at least so many.
    """

    #: Bytes that any encoding has besides its content, and that any has at least.
    FRAME, LEAST = 5, 13

    def __init__(self, raw: dict[str, bytes], switch: float = 8, split: float = 8, narrow: float = 0.06, words: int = 4) -> None:
        self.d, self.switch, self.split, self.narrow, self.words = Dictionaries(raw), switch, split, narrow, words
        self.done: dict[str, list[tuple[str, list[int]]]] = {}

    def pieces(self, units: Iterable[str]) -> dict[str, list[tuple[str, list[int]]]]:
        """Each clause cut where its language changes: clause -> pieces with their sizes. All clauses go through a round together,
        and what is cut comes again in the next one. Clauses seen before are remembered within bounds."""
        halves: dict[str, tuple[str, str]] = {}
        if len(self.done) > self.d.KNOWN:
            self.done = {}
        all_units = now = [u for u in dict.fromkeys(units) if u not in self.done]
        size = self.d.sizes(now)
        own = {u: size[u] for u in now}
        low = self.words - 1
        while now:
            probes: dict[str, list[str]] = {}
            for u in now:
                if min(own[u]) >= 2 * self.LEAST - self.FRAME + self.split:  # else no cut can save enough
                    words = u.split(" ")
                    if (n := len(words)) >= 2 * self.words:
                        m = max(2, n // 5)
                        probes[u] = [" ".join(words[n * k // m : n * (k + 1) // m]) for k in range(m)]
            # a change has to show in stretches of a few words before all places are tried
            size = self.d.sizes(p for ps in probes.values() for p in ps)
            open_ = []
            for u, ps in probes.items():
                main = own[u].index(min(own[u]))
                if any(size[p][main] - min(size[p]) >= 3 for p in ps):
                    words = u.split(" ")
                    open_.append((u, [(" ".join(words[:k]), " ".join(words[k:])) for k in range(low, len(words) - low + 1)]))
            size = self.d.sizes(x for _, ways in open_ for way in ways for x in way)
            now = []
            for u, ways in open_:
                best, top, at = min(own[u]), 0.0, None
                for way in ways:
                    left, right = size[way[0]], size[way[1]]
                    a, b = min(left), min(right)
                    if best - a - b + self.FRAME > top and left.index(a) != right.index(b):
                        top, at = best - a - b + self.FRAME, way
                if at and top >= self.split:
                    halves[u] = at
                    for x in at:
                        own[x] = size[x]
                        if x not in halves:
                            now.append(x)
        for u in all_units:
            row, todo = [], [u]
            while todo:
                x = todo.pop()
                if x in halves:
                    todo += reversed(halves[x])
                else:
                    row.append((x, own[x]))
            self.done[u] = row
        return self.done

    def _path(self, pieces: list[tuple[str, list[int]]]) -> list[int]:
        """The cheapest row of languages, where a change costs ``switch`` bytes."""
        n, (first, *rest) = len(self.d.langs), [s for _, s in pieces]
        i = first.index(min(first))
        if all(s.index(min(s)) == i for s in rest):
            return [i] * len(pieces)
        cost, back = [float(x) for x in first], []
        for s in rest:
            low = min(range(n), key=cost.__getitem__)
            stay = [cost[i] <= cost[low] + self.switch for i in range(n)]
            back.append([i if stay[i] else low for i in range(n)])
            cost = [(cost[i] if stay[i] else cost[low] + self.switch) + s[i] for i in range(n)]
        i = min(range(n), key=cost.__getitem__)
        path = [i]
        for b in reversed(back):
            path.append(i := b[i])
        path.reverse()
        return path

    def segments(self, texts: list[str | None]) -> list[list[tuple[str, str, float]]]:
        """For each text (language, segment, confidence); confidence is the relative margin to the second best language. Empty
        for null texts and for those without a sentence."""
        every = [units(t) if t else [] for t in texts]
        cut = self.pieces(u for us in every for u in us)
        return [self._runs([p for u in us for p in cut[u]]) if us else [] for us in every]

    def _runs(self, pieces: list[tuple[str, list[int]]]) -> list[tuple[str, str, float]]:
        runs: list[list] = []
        for (t, s), i in zip(pieces, self._path(pieces)):
            if runs and runs[-1][0] == i:
                runs[-1][1].append(t)
                runs[-1][2].append(s)
            else:
                runs.append([i, [t], [s]])
        out = []
        for i, ts, ss in runs:
            s = [*map(sum, zip(*ss))]
            t = " ".join(ts)
            second = min((x for k, x in enumerate(s) if k != i), default=s[i])
            margin = (second - s[i]) / max(1, second)
            if t.count(" ") + 1 >= self.words - 1 and margin >= self.narrow:
                out.append((self.d.langs[i], t, round(margin, 4)))
        return out

    def languages(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """For each text its languages with their confidence, the one of most words first."""
        return [self._languages(found) for found in self.segments(texts)]

    def _languages(self, found: list[tuple[str, str, float]]) -> list[tuple[str, float]]:
        size: Counter = Counter()
        sure: dict[str, float] = {}
        for lang, t, m in found:
            size[lang] += t.count(" ") + 1
            sure[lang] = max(sure.get(lang, 0.0), m)
        return [(lang, sure[lang]) for lang, n in size.most_common() if n >= self.words or len(size) == 1]


def _content(sentences: Iterable[str], most: int) -> bytes:
    """Dictionary content of at most ``most`` bytes: sentences that bring new runs of words. The most useful content
    comes last, where references are cheapest."""
    seen: set = set()
    chosen, total = [], 0
    for s in sentences:
        w = s.split(" ")
        runs = set(zip(w, w[1:])) or {(s,)}
        if len(runs - seen) < 0.3 * len(runs):
            continue
        seen |= runs
        b = (s + "\n").encode("utf-8", "replace")
        if total + len(b) > most:
            break
        chosen.append(b)
        total += len(b)
    return b"".join(reversed(chosen))


def fit_dictionaries(rows: Iterable[tuple[str | None, str | None]], langs: tuple[str, ...], most: int = 160_000, rounds: int = 3) -> dict[str, bytes]:
    """Dictionaries from (language named by the label, text). A language without rows has no dictionary."""
    sentences = [(lang, s) for lang, text in rows if lang in langs and text for s in units(text)]
    by: dict[str, list[str]] = defaultdict(list)
    scripts: dict[str, Counter] = defaultdict(Counter)
    done = [(lang, s, bool(_ARABIC.search(s))) for lang, s in cleaned(sentences, rounds)]
    for lang, _, script in done:
        scripts[lang][script] += 1
    for lang, s, script in done:
        if script == scripts[lang].most_common(1)[0][0]:
            by[lang].append(s)
    return {lang: _content(s, most) for lang, s in by.items()}


def cleaned(sentences: list[tuple[str, str]], rounds: int = 3, margin: float = 8.0) -> list[tuple[str, str]]:
    """Sentences under the language that their words speak for, whatever their label; unclear ones are left out. Dictionaries
    match word for word, so a single wrong sentence in one would draw every sentence like it. Words are weighed by
    how much more often they occur under one language than under the others, at first by label, then by the outcome."""
    words = [sorted(set(_WORD.findall(s))) for _, s in sentences]
    now: list[str | None] = [lang for lang, _ in sentences]
    for last in (*[False] * (rounds - 1), True):
        count: dict[str, Counter] = defaultdict(Counter)
        for lang, w in zip(now, words):
            if lang:
                count[lang].update(w)
        total = {lang: sum(c.values()) for lang, c in count.items()}
        weight: dict[str, dict[str, float]] = {}
        for w in set().union(*words) if words else ():
            weight[w] = {lang: math.log(c[w] / max(1, total[lang]) + 2e-6) for lang, c in count.items()}
        now = []
        for w in words:
            score = sorted(((sum(weight[x][lang] for x in w), lang) for lang in count), reverse=True)
            best = score[0][1] if score else None
            if last and best:  # only now, so that an unclear sentence's words stay in the counts until then
                sure = len(score) == 1 or score[0][0] - score[1][0] >= min(margin, 1 + 0.75 * len(w))
                other = sum(max(weight[x].values()) - weight[x][best] > 3 for x in w)  # in two languages, of no use
                best = best if sure and other <= max(1, 0.12 * len(w)) else None
            now.append(best)
    return [(lang, s) for lang, (_, s) in zip(now, sentences) if lang]


def training_rows(df: DataFrame, key: str, text: str, label: str, langs: tuple[str, ...], each: int = 800) -> list[tuple[str, str]]:
    """About ``each`` labelled rows of every language at most, chosen and ordered by a hash of their key: the bound of what the
    classifier is fitted on, whatever the size of the table."""
    d = df.select(F.xxhash64(key).alias("h"), label_language(F.col(label)).alias("lang"), F.col(text).alias("t")).where(F.col("lang").isin(*langs) & (F.length("t") > 0))
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * min(1.0, each / n))))
    return [(r["lang"], r["t"]) for r in sorted(d.where(chosen).collect(), key=lambda r: (r["h"], r["t"]))]


LANGUAGES = ("en", "fr", "es", "pt", "de", "ar")


def fit(tables: list[tuple[DataFrame, str, str, str]], langs: tuple[str, ...] = LANGUAGES, each: int = 800) -> dict[str, bytes]:
    """Dictionaries from (table, key, text, label) of several tables; at most 160 kB for each language."""
    rows: list[tuple[str, str]] = []
    for df, key, text, label in tables:
        rows += training_rows(df, key, text, label, langs, each)
    rows.sort(key=lambda r: hash_of(r[1]))
    return fit_dictionaries(rows, langs)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def detected(df: DataFrame, raw: dict[str, bytes], key: str, text: str, segments: bool = False, label: Column | None = None, **settings: float) -> DataFrame:
    """One row for each language of a text: (``key``, lang, confidence, languages), the last being how many there are; with
    ``segments`` one for each segment: (``key``, segment_no, lang, confidence, segment), the segment in lower case with
    links and numbers as 0. ``label`` is a string that travels along and comes out as the last column, ``label``. Texts
    that are null or hold no sentence have no row. No shuffle; the dictionaries that go out are bounded."""
    from pyspark.sql.pandas.types import to_arrow_type

    sent = df.sparkSession.sparkContext.broadcast(raw)
    kind, labelled = dict(df.dtypes)[key], label is not None
    fields = [("segment_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("segment", pa.string())] if segments else [("lang", pa.string()), ("confidence", pa.float64()), ("languages", pa.int32())]
    schema = pa.schema([(key, to_arrow_type(df.schema[key].dataType)), *fields, *([("label", pa.string())] if labelled else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(sent.value, **settings) if len(sent.value) > 1 else None
        for b in batches:
            if detector is None:
                continue
            texts = b.column(1).to_pylist()
            if segments:
                found = [[(i + 1, lang, m, t) for i, (lang, t, m) in enumerate(one)] for one in detector.segments(texts)]
            else:
                found = [[(*x, len(one)) for x in one] for one in detector.languages(texts)]
            at = pa.array([k for k, one in enumerate(found) for _ in one], pa.int64())
            columns = list(zip(*(x for one in found for x in one))) or [()] * len(fields)
            last = [b.column(2).take(at)] if labelled else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array(c, t) for c, (_, t) in zip(columns, fields)), *last], schema=schema)

    names = {pa.int32(): "int", pa.string(): "string", pa.float64(): "double"}
    ddl = ", ".join([f"`{key}` {kind}", *(f"{n} {names[t]}" for n, t in [*fields, *([("label", pa.string())] if label is not None else [])])])
    return df.select(key, text, *([label.alias("label")] if label is not None else [])).where(F.col(text).isNotNull()).mapInArrow(run, ddl)


def mislabelled(df: DataFrame, raw: dict[str, bytes], key: str, text: str, label: str) -> DataFrame:
    """(``key``, lang, confidence): the languages of those texts whose label is missing or wrong, or that mix languages. The
    label travels with the key, so nothing is joined; equal rows give one case."""
    d = detected(df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l")), raw, "k", "t", label=label_language(F.col("l")))
    case = F.col("label").isNull() | (F.col("label") != F.col("lang")) | (F.col("languages") > 1)
    return d.where(case).groupBy(F.col("k").alias(key), "lang").agg(F.max("confidence").alias("confidence"))
