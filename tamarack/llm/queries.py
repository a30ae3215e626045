"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm import boilerplate, language, leakage, lookalike, mixing, partenum, splitting, subjects


def _read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pages = _read(spark, d, "logement_en", "page_id", "text").where(F.length("text") > 2000)
    return pages.select("page_id", splitting.weakest_boundary(F.col("text"), 2000).alias("boundary")).where("boundary is not null")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    pages = _read(spark, d, "logement_en", "page_id", "page_number", "text")
    return splitting.split_oversized(pages, "text", 2000, 200)


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """For each page that comes out: whether all pieces are within the limit and the overlap, and a digest of the characters of its
    pieces, without overlaps and blanks, in order. The text's own digest must be the same."""
    own = F.regexp_replace(F.expr("substring(piece, overlap_chars + 1)"), r"(?U)\s+", "")
    d1 = p1_pieces(spark, d).groupBy("page_id", "page_number").agg(
        F.bool_and((F.length("piece") <= 2000) & (F.col("overlap_chars") <= 200)).alias("within"),
        F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("parts"),
    )
    return d1.select("page_id", "page_number", "within", F.md5(F.array_join(F.transform("parts", lambda p: p["own"]), "")).alias("digest"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    pages = _read(spark, d, "logement_en_categorized", "page_id", "text", "category_id", "category_name", "subcategory")
    return subjects.subjects_of(pages, subjects.fit(pages, _read(spark, d, "categories")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d)


def p2_composition(spark: SparkSession, d: str) -> DataFrame:
    """How many pages treat each subject area, and their share of all assignments."""
    names = _read(spark, d, "categories", "category_id", "category_name").distinct()
    n = _subjects(spark, d).groupBy("category_id").agg(F.count("*").alias("pages"))
    every = F.sum("pages").over(Window.partitionBy())  # a row for each subject
    named = names.join(n, "category_id", "left").fillna(0, ["pages"])
    return named.withColumn("share", F.coalesce(F.round(F.try_divide(F.col("pages"), every), 6), F.lit(0.0)))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return partenum.near_duplicate_groups(_read(spark, d, "logement_en", "page_id", "text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return partenum.pairs_within_groups(p3_groups(spark, d))


def _ledger(spark: SparkSession, pages: DataFrame) -> boilerplate.LineLedger:
    """Two merges: the pages that were there before the latest month of ingestion, then those that arrived in it."""
    last = pages.agg(F.date_trunc("month", F.max("ingested_at"))).first()[0]
    new = F.coalesce(F.col("ingested_at") >= F.lit(last), F.lit(False))
    return boilerplate.LineLedger(spark).merge(pages.where(~new)).merge(pages.where(new))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, _read(spark, d, "logement_en", "page_id", "site", "text", "ingested_at")).found()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    pages = _read(spark, d, "logement_en", "page_id", "site", "text", "ingested_at")
    return _ledger(spark, pages).clean(pages.drop("ingested_at")).select("page_id", "clean_text")


def p4_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every month's pages merged as a partition of their own, in order: the pages there are by then that had to be written anew
    because one of their lines crossed. Rows without a time come with the first month. The months are a short list."""
    pages = _read(spark, d, "logement_en", "page_id", "site", "text", "ingested_at")
    month = F.date_trunc("month", "ingested_at")
    months = [r[0] for r in pages.select(month.alias("m")).where("m is not null").distinct().orderBy("m").collect()] or [None]
    ledger = boilerplate.LineLedger(spark)
    for k, m in enumerate(months):
        ledger.merge(pages.where((month == F.lit(m)) | F.col("ingested_at").isNull() if k == 0 else month == F.lit(m)))
    return ledger.rebuilt(pages, [*range(1, ledger.version + 1)])


def _texts(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str, str]]:
    pages = _read(spark, d, "logement_en", "page_id", "text", "lang")
    return [("logement_en", pages, "page_id", "text"), ("cdn_rag_queries", _read(spark, d, "cdn_rag_queries", "query_id", "question", "lang"), "query_id", "question")]


def _dictionaries(tables: list[tuple[str, DataFrame, str, str]]) -> dict[str, bytes]:
    return language.fit([(df, key, text, "lang") for _, df, key, text in tables])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    tables = _texts(spark, d)
    raw = _dictionaries(tables)
    a, b = (language.mislabelled(df, raw, key, text, "lang").select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), "lang") for name, df, key, text in tables)
    return a.union(b)


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    tables = _texts(spark, d)
    raw = _dictionaries(tables)
    a, b = (language.detected(df, raw, key, text, segments=True).select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), "segment_no", "lang", "confidence", "segment") for name, df, key, text in tables)
    return a.union(b.distinct())  # only questions come twice


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    docs, items = _read(spark, d, "documents", "doc_id", "text"), _read(spark, d, "eval_items", "item_id", "text")
    return leakage.leaked(docs, items).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents, and how completely."""
    docs, items = _read(spark, d, "documents", "doc_id", "text"), _read(spark, d, "eval_items", "item_id", "text")
    return leakage.leaked(docs, items).groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("share_found"), 4).alias("best_share"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.counted(_read(spark, d, "documents", "doc_id", "source", "text"), "doc_id", "source", "text"), _read(spark, d, "mix_targets")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.unreachable(*_mixture(spark, d))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_mixture(spark, d)).withColumnRenamed("doc", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    tokens, targets = _mixture(spark, d)
    done = mixing.reached(mixing.mix(tokens, targets), mixing.source_report(tokens, targets))
    return done.select("source", "target_share", "max_repeats", "own_tokens", "reachable", "reached_tokens", F.round("reached_share", 6).alias("reached_share"), F.round("mixture_share", 6).alias("mixture_share"), "repeats")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking_pairs(_read(spark, d, "documents", "doc_id", "text"))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonicalise(_read(spark, d, "documents", "doc_id", "text")).select("doc_id", "canonical")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
