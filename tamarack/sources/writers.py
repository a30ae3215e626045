"""Writers: index tables, JSON lines, judgements, runs, text sheets, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import one_line, safe_id
from tamarack.operators.ranking import first_by
from tamarack.operators.sparse import SparseIndex


def save_index(index: SparseIndex, path: str) -> None:
    """Postings are clustered by term, so that a search reads only the files of its terms."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")


def load_index(spark, path: str) -> SparseIndex:
    return SparseIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats", "docs")))


def save_vectors(vectors: DataFrame, path: str, by: str | None = None) -> None:
    w = vectors.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def corpus_lines(df: DataFrame) -> DataFrame:
    """One JSON column ``value``: {_id, title, text}."""
    return df.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))).alias("value"))


def qrels_table(qrels: DataFrame) -> DataFrame:
    return qrels.select(F.col("qid").alias("query-id"), F.col("doc_id").alias("corpus-id"), "score")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def index_corpus(df: DataFrame, dataset: str, order: list[str], text: str) -> DataFrame:
    """(id, contents): ids ``dataset_n`` from 1 in the order, blanks as ``_``; the first of equal ids stays."""
    from tamarack.operators.structure import running_ids

    d = running_ids(df.where(F.length(F.trim(F.col(text))) > 0), order, "n")
    return d.select(safe_id(F.concat(F.lit(f"{dataset}_"), F.col("n").cast("string"))).alias("id"), F.col(text).alias("contents"))


def first_of_ids(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return first_by(df, [key], [F.asc(c) for c in order])


def gold_rows(df: DataFrame, key: str, golds: str) -> DataFrame:
    """(key, doc_id): each distinct gold of a list once."""
    return df.select(key, F.explode(F.array_distinct(F.col(golds))).alias("doc_id"))


def query_line(key: Column, text: Column) -> Column:
    return F.concat_ws("\t", key.cast("string"), one_line(text))


def run_line(tag: str) -> Column:
    """``qid Q0 docid rank score tag`` of a run's row, tab-separated."""
    return F.concat_ws("\t", F.col("qid").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", F.col("score").cast("double")), F.lit(tag))


def sheet(number: Column, name: Column, url: Column, site: Column, details: Column) -> Column:
    return F.format_string("===== Organisation %d: %s =====\nURL: %s\nSite internet: %s\n\nDescription: %s\n\n", number, name, url, site, F.coalesce(details, F.lit("")))


def preview(passages: Column, size: int = 200) -> Column:
    """Begins of passages, joined by `` || ``, line ends as blanks."""
    return F.array_join(F.transform(passages, lambda p: F.replace(F.substring(p, 1, size), F.lit("\n"), F.lit(" "))), " || ")


def write_results(df: DataFrame, path: str) -> None:
    """JSON lines; a job's files appear only when it is done."""
    df.write.mode("errorifexists").json(path)
