"""Extensions: index counts kept up to date by a stream of documents, and windows over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import tokens


def append_postings(documents: DataFrame, path: str, checkpoint: str, delay: str = "30 days"):
    """A query that tokenises arriving (doc_id, text, arrived) and appends postings, each document once within ``delay``."""

    def add(batch: DataFrame, epoch: int) -> None:
        # A repeated epoch overwrites its own folder, so that a restart adds nothing twice.
        d = batch.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
        d.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    d = documents.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["doc_id"])
    return d.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of (ts, event_type, value), on a stream or a table; rows later than ``delay`` are left out of a
    stream."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.withWatermark("ts", delay) if d.isStreaming else d
    g = d.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(user_id, start, n): runs of a user's events with less than ``gap`` between them."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.withWatermark("ts", delay) if d.isStreaming else d
    g = d.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")
