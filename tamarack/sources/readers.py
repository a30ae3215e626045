"""Readers: documents, pre-chunked and page JSON, query sets, judgements, runs, training files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import count_organisations, html_text, path_language, path_topic

#: Adapters of binary formats: extension -> function from bytes to text. None is built in.
BINARY: dict[str, Callable[[bytes], str]] = {}


def files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(file_path, file_name, file_type, content, size, modified_time, language, topic, organization_count) of txt, md and html
    files, and of those binary ones that have an adapter. Files that can't be read are skipped."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    d = d.select("path", name.alias("file_name"), kind.alias("file_type"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").cast("double").alias("modified_time"), "content")
    known = ["txt", "md", "html", "htm", *BINARY]
    text = F.decode("content", "utf-8")
    body = F.when(F.col("file_type").isin("html", "htm"), html_text(text)).otherwise(text)
    if BINARY:
        adapters = dict(BINARY)

        @F.pandas_udf("string")
        def adapted(kinds: pd.Series, contents: pd.Series) -> pd.Series:
            return pd.Series([adapters[k](c) if k in adapters else None for k, c in zip(kinds, contents)])

        body = F.when(F.col("file_type").isin(*BINARY), adapted("file_type", "content")).otherwise(body)
    d = d.where(F.col("file_type").isin(*known)).withColumn("content", body)
    return d.select(F.col("path").alias("file_path"), "file_name", "file_type", "content", "size", "modified_time", path_language(F.col("path")).alias("language"), path_topic(F.col("path")).alias("topic"), count_organisations(F.col("content")).alias("organization_count"))


def chunk_json(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, file_name, content, page_number, category_id, category_name, subcategory) of files that hold an array of
    records; ``text`` or ``content`` is the text, the id is ``{stem}_chunk_{chunk_id or place}``."""
    schema = "chunk_id string, text string, content string, page_number int, category_id int, category_name string, subcategory string"
    d = spark.read.schema(schema).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("at"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("file_name").orderBy("at")) - 1
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    d = d.withColumn("chunk_id", F.concat(stem, F.lit("_chunk_"), F.coalesce("chunk_id", place.cast("string"))))
    return d.select("chunk_id", "file_name", F.coalesce("text", "content", F.lit("")).alias("content"), "page_number", "category_id", "category_name", "subcategory")


def records(df: DataFrame, text_key: str = "text", id_key: str = "id") -> DataFrame:
    """(doc_id, text) of loosely shaped records: missing texts are empty, missing ids the row's hash."""
    text = F.coalesce(F.col(text_key).cast("string"), F.lit("")) if text_key in df.columns else F.lit("")
    own = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("string")
    return df.select((F.coalesce(F.col(id_key).cast("string"), own) if id_key in df.columns else own).alias("doc_id"), text.alias("text"))


def corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, title string, text string").json(path).select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("qid"), "text")


def qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, score) of a file with a header; of repeated pairs the last in the file stays."""
    d = spark.read.csv(path, sep="\t", header=True, schema="qid string, doc_id string, score int").withColumn("at", F.monotonically_increasing_id())
    return d.groupBy("qid", "doc_id").agg(F.max_by("score", "at").alias("score"))


def judged(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, those queries that are judged, and judgements."""
    return corpus, queries.join(qrels.select("qid").distinct(), "qid", "left_semi"), qrels


def trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``qid 0 docid rel`` lines; shorter ones are skipped."""
    w = F.split("value", r"\s+")
    return spark.read.text(path).where(F.size(w) >= 4).select(w[0].alias("qid"), w[2].alias("doc_id"), w[3].try_cast("int").alias("score"))


def trec_run(spark: SparkSession, path: str, k: int) -> DataFrame:
    """``qid Q0 docid rank score tag`` lines up to rank k."""
    w = F.split("value", r"\s+")
    d = spark.read.text(path).where(F.size(w) >= 6).select(w[0].alias("qid"), w[2].alias("doc_id"), w[3].try_cast("long").alias("rank"), w[4].try_cast("double").alias("score"))
    return d.where(F.col("rank") <= k)


def tsv_queries(spark: SparkSession, path: str) -> DataFrame:
    w = F.split("value", "\t")
    return spark.read.text(path).where(F.size(w) >= 2).select(w[0].alias("qid"), w[1].alias("text"))


def tsv_passages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True).select("text")


def id_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="doc_id string, vec_id long")


def hard_negative_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pos, neg) with neg a map of systems; gzip is read as it is."""
    item = "array<struct<pid: string, `ce-score`: double>>"
    return spark.read.schema(f"qid string, pos {item}, neg map<string, {item}>").json(path)


def with_adapter(extension: str, read: Callable[[bytes], str]) -> None:
    BINARY[extension] = read


def pages_of(text: Column) -> Column:
    """Pages of a text that has form feeds, numbered from 1."""
    return F.transform(F.split(text, "\f"), lambda t, i: F.struct((i + 1).alias("page_number"), t.alias("text")))


def batches(df: DataFrame) -> Iterator:
    """Rows one after the other, partition by partition (for sinks outside Spark)."""
    return df.toLocalIterator()
