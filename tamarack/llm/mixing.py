"""Mixing sources to target shares of all tokens (problem 7).

The mixture is a row of slots: slot i takes the i-th golden-ratio point, which falls into a source's part of the cumulated
shares. Such points are spread so evenly that any stretch of the mixture has nearly the target shares. The tokens that a
source is to give are cut into as many equal blocks as it has slots, so what it gives doesn't hang on how many slots it
happened to get. Its documents are shuffled by a hash and laid end to end, repeated as often as needed and allowed, and each use
of a document goes to the block in which it begins. Blocks beyond the allowed repetitions stay empty; the
shortfall is reported, not made up by other sources.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GOLDEN = 0.6180339887498949
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokenisation pattern that goes with the vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_count(tokenizer: str = TOKENIZER):
    """A pandas UDF string -> long: tokens of a text; 0 for null and empty. The vocabulary file is read once by each
    Python worker and must be at the same path on every machine."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding(os.path.basename(tokenizer), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for s in texts:
            yield s.map(lambda x: len(enc.encode_ordinary(x)) if x else 0).astype("int64")

    return count


def counted(df: DataFrame, key: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc, source, tokens), as a table of its own: tokens are counted once, and texts go no further."""
    from tamarack.runtime import cut

    return cut(df.select(F.col(key).alias("doc"), F.col(source).alias("source"), token_count(tokenizer)(F.col(text)).alias("tokens")), "tokens")


def source_report(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """For each row of ``targets`` (source, target_share, max_repeats): own_tokens, total_tokens (of all rows, also those
    of null or unlisted sources), wanted_tokens and reachable. A null share counts as 0, null repeats as 1."""
    own = tokens.groupBy("source").agg(F.sum("tokens").alias("own_tokens"))
    total = tokens.agg(F.sum("tokens")).first()[0] or 0
    t = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    d = t.join(own, "source", "left").fillna(0, ["own_tokens"]).withColumn("total_tokens", F.lit(total).cast("long"))
    wanted = F.col("target_share") * F.col("total_tokens")
    return d.withColumn("wanted_tokens", wanted).withColumn("reachable", F.col("own_tokens") * F.col("max_repeats") >= wanted - 1e-6)


def _running(df: DataFrame, group: list[str], part: Column, order: list[str], value: Column, parts: DataFrame | None = None) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the group that come earlier by (part, order). Each part is one
    window of its own and only the parts' sums are cumulated for a whole group, so a group that holds most rows is still
    spread over all tasks."""
    d = df.withColumn("__part", part).withColumn("__v", value)
    sums = d.groupBy(*group, "__part").agg(F.sum("__v").alias("__sum"))
    w = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__off", F.coalesce(F.sum("__sum").over(w), F.lit(0))).drop("__sum")
    inner = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__in", F.coalesce(F.sum("__v").over(inner), F.lit(0)))
    return d.join(offsets, [*group, "__part"]).withColumn("before", F.col("__off") + F.col("__in")).drop("__off", "__in", "__v", "__part")


def laid(tokens: DataFrame, seed: int = 7, rows_a_part: int = 20_000) -> DataFrame:
    """(doc, source, tokens, before): each source shuffled by hash, with the tokens that come before a document. The number
    of parts follows the number of rows, so that a window stays small whatever the corpus and its largest source."""
    d = tokens.where("source is not null and tokens > 0").withColumn("__h", F.xxhash64(F.lit(seed), F.col("doc")))
    parts = max(1, -(-d.count() // rows_a_part))
    return _running(d, ["source"], F.pmod("__h", F.lit(parts)), ["__h", "doc"], F.col("tokens")).drop("__h")


def slots(spark, report: DataFrame, count: int, chunk: int = 4096) -> DataFrame:
    """(slot, source, turn): golden-ratio points mapped through the cumulated target shares; ``turn`` numbers a source's
    slots from 0. ``report`` has a row for each source of the mixture; it is collected, as it is a configuration. A
    source whose share is so small that no point falls into it shares slot 0."""
    names = [(r["source"], r["target_share"]) for r in report.where("source is not null").orderBy("source").collect()]
    edges = [round(sum(x for _, x in names[: k + 1]), 12) for k in range(len(names))]
    point = F.expr(f"(id + 0.5D) * {GOLDEN}D - floor((id + 0.5D) * {GOLDEN}D)")
    passed = F.size(F.filter(F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>"), lambda e: e <= F.col("x")))
    d = spark.range(count).select(F.col("id").alias("slot"), point.alias("x")).withColumn("__k", passed).where(F.col("__k") < len(names))
    d = d.select("slot", F.try_element_at(F.array(*(F.lit(n) for n, _ in names)).cast("array<string>"), F.col("__k") + 1).alias("source"))
    turns = _running(d, ["source"], F.floor(F.col("slot") / chunk), ["slot"], F.lit(1)).withColumnRenamed("before", "turn")
    missed = report.where("source is not null and target_share > 0").select("source").join(turns.select("source").distinct(), "source", "left_anti")
    return turns.select("slot", "source", "turn").union(missed.select(F.lit(0).cast("long"), "source", F.lit(0).cast("long")).where(F.lit(count) > 0))


def schedule(tokens: DataFrame, targets: DataFrame, block_tokens: int = 2048) -> DataFrame:
    """(slot, source, turn, slots, wanted_tokens, own_tokens, max_repeats, filled): the row of slots, about one for each
    ``block_tokens`` of all tokens. ``slots`` is how many the source has; each is to hold wanted_tokens / slots. ``filled`` says
    whether the source's documents reach to the end of the slot's block within the allowed repetitions."""
    from tamarack.runtime import cut

    report = cut(source_report(tokens, targets), "report")
    total = report.agg(F.max("total_tokens")).first()[0] or 0
    s = cut(slots(tokens.sparkSession, report, -(-total // block_tokens)), "slots")
    d = s.join(s.groupBy("source").agg(F.count("*").alias("slots")), "source").join(report, "source")
    upto = (F.col("turn") + 1) * F.col("wanted_tokens") / F.col("slots")
    return d.select("slot", "source", "turn", "slots", "wanted_tokens", "own_tokens", "max_repeats", (F.col("own_tokens") * F.col("max_repeats") >= upto - 1e-6).alias("filled"))


def unreachable(tokens: DataFrame, targets: DataFrame, block_tokens: int = 2048) -> DataFrame:
    """(source): the sources for which the schedule has a slot that stays unfilled."""
    return schedule(tokens, targets, block_tokens).where("not filled").select("source").distinct()


def mix(tokens: DataFrame, targets: DataFrame, block_tokens: int = 2048, seed: int = 7) -> DataFrame:
    """The mixture: (slot, source, doc, repetition, tokens), a row for each use of a document.

    The mixture is as long as all of ``tokens``. Every source gives its share of that to within half its smallest unused document, or all
    that ``max_repeats`` uses of its documents hold. Empty tables give an empty mixture; sources of the targets without
    documents have no rows; documents of null or unlisted sources aren't used. A document of no tokens isn't used.
    """
    from tamarack.runtime import cut

    s = cut(schedule(tokens, targets, block_tokens), "schedule")
    per = s.groupBy("source").agg(*(F.max(c).alias(c) for c in ("slots", "wanted_tokens", "own_tokens", "max_repeats")))
    d = laid(tokens, seed).join(per, "source").where("wanted_tokens > 0")
    times = F.least(F.col("max_repeats"), F.ceil(F.col("wanted_tokens") / F.col("own_tokens")).cast("int"))
    d = d.withColumn("repetition", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    d = cut(d.withColumn("start", F.col("repetition") * F.col("own_tokens") + F.col("before")), "uses")
    whole = d.where("start + tokens <= wanted_tokens")
    # what is left is filled by the unused document of the last repetition that fits it best, if that is better than none
    left = per.join(whole.groupBy("source").agg(F.max(F.col("start") + F.col("tokens")).alias("placed")), "source", "left").select("source", F.coalesce("placed", F.lit(0)).alias("placed"))
    over = d.where("start + tokens > wanted_tokens").join(left, "source").withColumn("miss", F.abs(F.col("wanted_tokens") - F.col("placed") - F.col("tokens")))
    over = over.where("miss < wanted_tokens - placed").withColumn("start", F.col("placed"))
    names = whole.columns
    last = over.groupBy("source").agg(F.min_by(F.struct(*names), F.struct("miss", F.xxhash64(F.lit(seed), "doc"), "doc")).alias("u")).select("u.*")
    d = whole.unionByName(last).withColumn("turn", F.floor(F.col("start") * F.col("slots") / F.col("wanted_tokens")))
    return d.join(s.select("slot", "source", "turn"), ["source", "turn"]).select("slot", "source", "doc", F.col("repetition").cast("long").alias("repetition"), "tokens")


def reached(mixture: DataFrame, report: DataFrame) -> DataFrame:
    """``report`` with what the mixture really has: reached_tokens, reached_share (of the wanted total), mixture_share (of
    the tokens in the mixture) and repeats (the most uses of a document)."""
    got = mixture.groupBy("source").agg(F.sum("tokens").alias("reached_tokens"), (F.max("repetition") + 1).alias("repeats"))
    d = report.join(got, "source", "left").fillna(0, ["reached_tokens", "repeats"])
    every = F.sum("reached_tokens").over(Window.partitionBy())  # a row for each source
    return d.withColumn("reached_share", F.coalesce(F.try_divide("reached_tokens", "total_tokens"), F.lit(0.0))).withColumn("mixture_share", F.coalesce(F.try_divide("reached_tokens", every), F.lit(0.0)))
