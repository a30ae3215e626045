"""Cutting long texts into pieces at natural boundaries (problem 1).

One regular expression takes a piece at a time: its alternatives, strongest boundary first, each take as many characters as
fit, and the last takes characters. Everything runs in the JVM: pattern extraction and array functions, no Python and no
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries, strongest first.
BOUNDARIES = ("paragraph", "line", "sentence", "word", "character")


def piece_pattern(limit: int, overlap: int = 0) -> str:
    """Pattern of one piece: blanks before it, then code points that begin and end with a character that can be seen, up to the
    last paragraph end that fits, else line end, else sentence end, else word end, else just as many characters as fit.

    What fits is ``limit`` at the begin of a text and ``limit - overlap`` after it; there, where no end of a kind fits, the
    first one that is within ``limit`` is taken, so that a unit within the limit isn't cut to make room for an overlap."""
    ends = (r"(?=[^\S\n]*\n[ \t\r]*\n|\s*\z)", r"(?=[^\S\n]*\n)", r"(?<=[.!?…])(?=\s)", r"(?=\s)")

    def body(most: int, least: int = 2, lazy: str = "") -> str:
        inner = rf"\S.{{{least - 2},{most - 2}}}{lazy}\S" if most > 1 else ""
        return inner if least > 2 else rf"(?:{inner}|\S)" if inner else r"\S"

    def ways(most: int, upto: int) -> str:
        tried = [x + e for e in ends for x in (body(most), *([body(upto, max(most + 1, 2), "?")] if upto > most else []))]
        return rf"(?:{'|'.join(tried)}|\S{{1,{most}}})"

    first = ways(limit, limit)
    return rf"(?sU)\s*+{first}" if not overlap else rf"(?sU)\A\s*+{first}|\s*+{ways(limit - overlap, limit)}"


def cut_plan(text: Column, limit: int, overlap: int = 0) -> Column:
    """array<struct<lead, body, boundary>>: ``lead`` the blanks before a piece, ``body`` the piece, ``boundary`` the
    number of the boundary (index in BOUNDARIES) at which it ends. Pieces after the first leave room for ``overlap``."""
    found = F.regexp_extract_all(text, F.lit(piece_pattern(limit, overlap)), F.lit(0))
    parts = F.transform(found, lambda p: F.struct(F.regexp_extract(p, r"(?sU)\A(\s*)", 1).alias("lead"), F.regexp_replace(p, r"(?U)\A\s+", "").alias("body")))

    def end(parts: Column, p: Column, i: Column) -> Column:
        then = F.try_element_at(parts, (i + 2).cast("int"))["lead"]
        return F.struct(
            p["lead"].alias("lead"), p["body"].alias("body"),
            F.when(then.isNull() | then.rlike(r"\n[ \t\r]*\n"), 0).when(F.contains(then, F.lit("\n")), 1).when(F.length(then) == 0, 4).when(p["body"].rlike(r"[.!?…]\z"), 2).otherwise(3).alias("boundary"),
        )

    # bound to a variable by an outer transform, else the extraction would run again for each piece
    return F.transform(F.array(parts), lambda ps: F.transform(ps, lambda p, i: end(ps, p, i)))[0]


def weakest_boundary(text: Column, limit: int) -> Column:
    """Name of the weakest boundary at which the text has to be cut; null for null and blank texts."""
    worst = F.array_max(F.transform(cut_plan(text, limit), lambda p: p["boundary"]))
    return F.element_at(F.array(*map(F.lit, BOUNDARIES)), (worst + 1).cast("int"))


def split_oversized(df: DataFrame, text: str = "text", limit: int = 2000, overlap: int = 200, keep: list[str] | None = None) -> DataFrame:
    """One row for each piece: the columns ``keep`` (default: all but ``text``), ``piece_no`` from 1, ``boundary`` at
    which the piece ends, ``overlap_chars`` and ``piece``.

    A piece has at most ``limit`` code points, of which the first ``overlap_chars`` (at most ``overlap``) repeat the end
    of the piece before, from a word's begin where there is one. Pieces are cut short enough to leave room for it; only a
    single paragraph, line, sentence or word longer than ``limit - overlap`` leaves less, as a unit that fits is not cut, and
    of a shorter piece before no more than the whole can be repeated. A text within the limit comes out as one piece,
    unchanged; null, empty and blank texts have no row. Kept columns of the same names as the new ones are replaced by them.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    new = {"piece_no", "boundary", "overlap_chars", "piece"}
    keep = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c not in new]
    t = F.col(f"`{text}`")
    whole = F.array(F.struct(F.lit("").alias("lead"), t.alias("body"), F.lit(0).alias("boundary")))
    parts = F.when(F.length(t) > limit, cut_plan(t, limit, overlap)).when(t.rlike(r"(?U)\S"), whole)
    d = df.select(*(F.col(f"`{c}`") for c in keep), parts.alias("__parts"))
    d = d.select(*(F.col(f"`{c}`") for c in keep), "__parts", F.posexplode("__parts").alias("__i", "__p"))
    before = "try_element_at(__parts, int(nullif(__i, 0))).body"  # __i counts from 0, so this is the piece before
    room = f"int(greatest(0, least({overlap}, {limit} - length(__p.body) - length(__p.lead))))"
    tail = F.expr(f"right({before}, {room})")
    at_word = F.when(F.length(tail) < F.expr(f"length({before})"), F.regexp_replace(tail, r"(?U)\A\S*\s+(?=\S)", "")).otherwise(tail)
    back = F.coalesce(at_word, F.lit(""))
    lead = F.when(F.length(back) > 0, F.col("__p.lead")).otherwise(F.lit(""))
    return d.select(
        *(F.col(f"`{c}`") for c in keep), (F.col("__i") + 1).alias("piece_no"),
        F.element_at(F.array(*map(F.lit, BOUNDARIES)), (F.col("__p.boundary") + 1).cast("int")).alias("boundary"),
        F.length(back).alias("overlap_chars"), F.concat(back, lead, F.col("__p.body")).alias("piece"),
    )
