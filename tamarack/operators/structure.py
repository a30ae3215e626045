"""Categorising, chunking and packing of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST_PAGE = 10000


def page_intervals(categories: DataFrame) -> DataFrame:
    """(category_id, category_name, subcategory, start_page, end_page): each part of the tree up to the page before the next
    one's start. The tree is one small table, so the window over all of it is bounded."""
    w = Window.partitionBy(F.lit(0)).orderBy("start_page", "category_id", "subcategory")
    return categories.withColumn("end_page", F.coalesce(F.lead("start_page").over(w) - 1, F.lit(LAST_PAGE)))


def categorise(pages: DataFrame, intervals: DataFrame, page: str = "page_number") -> DataFrame:
    """Left join with the first interval that holds the page; nulls where none does. Each interval is unrolled into its pages
    up to the last page that occurs, which turns the range join into an equi-join."""
    last = pages.agg(F.max(page)).first()[0] or 0
    unrolled = intervals.where(F.col("start_page") <= F.least(F.col("end_page"), F.lit(last))).withColumn("__p", F.explode(F.sequence("start_page", F.least(F.col("end_page"), F.lit(last)))))
    one = unrolled.groupBy("__p").agg(F.min_by(F.struct("category_id", "category_name", "subcategory"), F.struct("start_page", "category_id", "subcategory")).alias("c"))
    return pages.join(one, F.col(page) == F.col("__p"), "left").select(*(f"`{c}`" for c in pages.columns), "c.category_id", "c.category_name", "c.subcategory")


def split_recursive(text: str | None, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", "。", "！", "？", ". ", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters: cut at the first separator that occurs (it stays at the begin of the piece
    after it), longer pieces cut again by the later ones, short ones joined greedily with ``overlap``. Without the empty separator
    a longer word stays whole. Null and blank texts give none."""
    if not text:
        return []
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, later = separators[level], separators[level + 1 :]
    if sep == "":
        parts = list(text)
    else:
        first, *rest = text.split(sep)
        parts = [p for p in [first, *(sep + r for r in rest)] if p]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        window: list[str] = []
        total = 0
        for p in held:
            if window and total + len(p) > size:
                if piece := "".join(window).strip():
                    out.append(piece)
                while window and (total > overlap or total + len(p) > size):
                    total -= len(window.pop(0))
            window.append(p)
            total += len(p)
        if piece := "".join(window).strip():
            out.append(piece)
        held.clear()

    for p in parts:
        if len(p) < size:
            held.append(p)
            continue
        flush()
        out += split_recursive(p, size, overlap, later) if later else [p]
    flush()
    return out


def chunk_recursive(df: DataFrame, text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of ``df`` with (chunk_index from 0, chunk, chunk_size, total_chunks) in place of ``text``."""
    settings = (size, overlap, *([separators] if separators else []))

    @F.pandas_udf("array<string>")
    def cut_up(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: split_recursive(t, *settings))

    d = df.withColumn("__c", cut_up(F.col(text))).drop(text)
    return d.select(*d.columns, F.posexplode("__c").alias("chunk_index", "chunk")).withColumns({"chunk_size": F.length("chunk").cast("long"), "total_chunks": F.size("__c").cast("long"), "chunk_index": F.col("chunk_index").cast("long")}).drop("__c")


def running_ids(chunks: DataFrame, order: list[str], name: str = "chunk_id") -> DataFrame:
    """Number rows from 1 in an order, without one task for all: rows are sorted by ranges, and a range's rows are numbered after those
    of the ranges before it, whose counts are the only thing that is gathered."""
    d = chunks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    from tamarack.runtime import cut

    d = cut(d, "ordered")
    n = d.groupBy("__p").agg(F.count("*").alias("__n"))
    before = n.withColumn("__b", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inner = F.row_number().over(Window.partitionBy("__p").orderBy("__i"))
    return d.join(F.broadcast(before), "__p").withColumn(name, inner + F.col("__b")).drop("__p", "__i", "__b")


def fixed_windows(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters; none for null and empty."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text), F.lit(size)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def token_windows(words: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens with ``overlap``, joined by blanks."""
    starts = F.sequence(F.lit(1), F.size(words), F.lit(size - overlap))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))


def organisation_blocks(text: Column) -> Column:
    """array<struct<name, block>>: what follows each header ``===== Organisation n: name =====``, trimmed; what comes before
    the first one is left out; none where there is no such header."""
    header = r"(?s)\A=====\s*(?:Organisation|Organization)\s+\d+:\s*(.+?)\s*====="
    trimmed = lambda x: F.regexp_replace(x, r"\A[\s\p{Z}]+|[\s\p{Z}]+\z", "")
    blocks = F.slice(F.split(text, r"(?======\s*(?:Organisation|Organization)\s+\d+:)"), 1, 2147483647)
    blocks = F.filter(blocks, lambda b: b.rlike(r"\A=====\s*(?:Organisation|Organization)\s+\d+:"))
    return F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(b, header, 1)).alias("name"), trimmed(F.regexp_replace(b, header, "")).alias("block")))


#: Separators of what is cut within a block and of documents without headers; fixed values.
BLOCK_SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def chunk_organisations(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50, recursive: bool = False) -> DataFrame:
    """(``key``, chunk_id, organization_name, chunk_index, content): a chunk for each organisation; a block of more than twice
    ``size`` is cut into fixed pieces, or at separators where ``recursive``, and their ids end in ``_sub_n``. The index counts
    all chunks of a document. A document without a header has no organisation: it is one chunk, or cut at separators
    where ``recursive``, with ids ``_chunk_n``. Null texts have no row."""

    @F.pandas_udf("array<string>")
    def at_separators(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: split_recursive(t, size, overlap, BLOCK_SEPARATORS))

    d = df.select(key, F.col(text).alias("__t")).where("__t is not null").withColumn("__o", organisation_blocks(F.col("__t")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("__t").alias("block")))
    d = d.select(key, (F.size("__o") > 0).alias("org"), F.posexplode(F.when(F.size("__o") > 0, F.col("__o")).otherwise(whole)).alias("at", "o"))
    long = F.when(F.col("org"), F.length("o.block") > 2 * size).otherwise(F.lit(recursive))
    pieces = at_separators(F.when(long, F.col("o.block"))) if recursive else fixed_windows(F.col("o.block"), size)
    d = d.select(key, "org", "at", "o.name", long.alias("long"), F.posexplode(F.when(long, pieces).otherwise(F.array("o.block"))).alias("sub", "content"))
    d = d.withColumn("chunk_index", (F.row_number().over(Window.partitionBy(key).orderBy("at", "sub")) - 1).cast("long"))
    part = F.when(F.col("org") & F.col("long"), F.concat(F.lit("_sub_"), F.col("sub").cast("string")))
    name = F.concat_ws("", F.col(key).cast("string"), F.when(F.col("org"), "_org_").otherwise("_chunk_"), F.col("chunk_index").cast("string"), part)
    return d.select(key, name.alias("chunk_id"), F.col("name").alias("organization_name"), "chunk_index", "content")


def categorise_files(pages: DataFrame, names: DataFrame, categories: DataFrame, file: str = "file_name") -> DataFrame:
    """Pages with the category that their whole file belongs to: ``names`` maps (base, category_name), where base is the file's
    name without ``.json`` and ``_en``; category_id comes from ``categories`` by the same name, subcategory is empty. Files
    without a category are left out."""
    base = F.replace(F.replace(F.col(file), F.lit(".json"), F.lit("")), F.lit("_en"), F.lit(""))
    ids = categories.groupBy("category_name").agg(F.min("category_id").alias("category_id"))
    known = names.join(ids, "category_name").select(F.col("base").alias("__base"), "category_id", "category_name")
    return pages.withColumn("__base", base).join(known, "__base").drop("__base").withColumn("subcategory", F.lit(""))


def chunk_stats(chunks: DataFrame, text: str) -> DataFrame:
    n = F.length(text)
    return chunks.agg(F.count("*").alias("total_chunks"), F.round(F.avg(n), 6).alias("avg_size"), F.min(n).cast("long").alias("min_size"), F.max(n).cast("long").alias("max_size"), F.sum(n).cast("long").alias("total_chars"))


def pack_paragraphs(text: Column, most: int = 4500) -> Column:
    """Paragraphs joined greedily into packs of fewer than ``most`` characters; a longer paragraph is a pack of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, p: Column) -> Column:
        fits = F.length(s["now"]) + F.length(p) + 2 < most
        joined = F.when(s["now"] == "", p).otherwise(F.concat_ws("\n\n", s["now"], p))
        return F.struct(F.when(fits | (s["now"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"), F.when(fits | (s["now"] == ""), joined).otherwise(p).alias("now"))

    return F.aggregate(F.split(text, "\n\n"), start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def majority(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each key (ties: the smallest) with its count; nulls don't count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("m")).select(*by, f"m.{value}", "m.n")
