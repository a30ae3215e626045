"""Lines repeated across one source's documents (problem 4).

The operator keeps tables in a folder, to which every merged partition only appends: its pages as hashes of their lines, its
pages of each source, and for each source and line its pages with it. After a merge, only the sources that the partition
touches are looked at: their lines whose state has changed (a share can rise or fall) are its crossings, which
bring the list of repeated lines up to date. Only documents that hold a crossed line are rebuilt, and they are found by
their hashes. Appended parts are added up when they are read; ``compact`` makes one part of them when there are many.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.runtime import delete_at_exit, new_path


def line_keys(text: Column, min_letters: int) -> Column:
    """array<long>: for each line a hash of its letters in lower case, null for lines of fewer letters."""
    letters = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]+", ""))
    return F.transform(letters, lambda x: F.when(F.length(x) >= min_letters, F.xxhash64(x)))


@dataclass
class LineLedger:
    """State of the line counts of all sources.

    path: folder of the tables, by default a new one in the shared folder. A line is repeated when it is on at least
    ``min_pages`` pages and on at least ``min_share`` of the source's pages. Rows whose source or text is null are no
    pages of any source; an empty text is a page without lines. Column names are parameters, so other columns of ``df``,
    whatever they are called, play no part. The key may have any type, but one and the same in all partitions.
    """

    spark: SparkSession
    path: str = ""
    min_pages: int = 6
    min_share: float = 0.15
    min_letters: int = 4
    version: int = 0
    #: Folders that hold counts: those of the versions, or what they were compacted to.
    parts: list[tuple[int, str]] = field(default_factory=list)
    key_type: str = "long"

    def __post_init__(self) -> None:
        self._own = not self.path  # a state without a given folder lasts as long as the session
        self.path = self.path or new_path(self.spark, "lines")

    def _schema(self, name: str) -> str:
        return {
            "keys": f"key {self.key_type}, src string, keys array<long>", "pages": "src string, pages long", "lines": "src string, line long, pages long",
            "crossed": "src string, line long, now boolean", "list": "src string, line long",
        }[name]

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._schema(name)).parquet(*(f"{p}/{name}" for p in paths))

    def _folder(self, version: int) -> str:
        return f"{self.path}/{version}"

    def _counts(self, name: str, version: int) -> DataFrame:
        return self._read(name, [p for v, p in self.parts if v <= version])

    def merge(self, df: DataFrame, source: str = "site", text: str = "text", key: str = "page_id") -> "LineLedger":
        """Add the pages of a partition that hasn't been merged before. What is written follows the partition's own size. Lines
        are counted once for a page, so only map-side combined counts are shuffled."""
        self.key_type = dict(df.dtypes)[key]
        then, self.version = self.version, self.version + 1
        here = self._folder(self.version)
        d = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("src"), F.col(f"`{text}`").alias("t")).where("src is not null and t is not null")
        d.select("key", "src", line_keys(F.col("t"), self.min_letters).alias("keys")).write.parquet(f"{here}/keys")
        keys = self._read("keys", [here])
        keys.groupBy("src").agg(F.count("*").alias("pages")).write.parquet(f"{here}/pages")
        own = F.array_distinct(F.filter("keys", lambda x: x.isNotNull()))
        keys.select("src", F.explode(own).alias("line")).groupBy("src", "line").agg(F.count("*").alias("pages")).write.parquet(f"{here}/lines")
        self._changes(then, here).write.parquet(f"{here}/crossed")
        self.parts.append((self.version, here))
        crossed = self.crossings()
        kept = self.repeated(then).join(crossed.where("not now"), ["src", "line"], "left_anti")
        kept.unionByName(crossed.where("now").select("src", "line")).write.parquet(f"{here}/list")
        if self._own:
            delete_at_exit(self.spark, self.path)
        return self

    def _changes(self, then: int, here: str) -> DataFrame:
        """(src, line, now) of the lines whose state the part in ``here`` changes, among those of the sources it touches."""
        touched = self._read("pages", [here]).withColumnRenamed("pages", "new_pages")
        before = self._counts("pages", then).join(touched.select("src"), "src", "left_semi").groupBy("src").agg(F.sum("pages").alias("old_pages"))
        total = touched.join(before, "src", "left").select("src", F.coalesce("old_pages", F.lit(0)).alias("old_all"), (F.coalesce("old_pages", F.lit(0)) + F.col("new_pages")).alias("new_all"))
        old = self._counts("lines", then).join(touched.select("src"), "src", "left_semi").select("src", "line", F.col("pages").alias("old"), F.lit(0).cast("long").alias("new"))
        new = self._read("lines", [here]).select("src", "line", F.lit(0).cast("long").alias("old"), F.col("pages").alias("new"))
        both = old.unionByName(new).groupBy("src", "line").agg(F.sum("old").alias("old"), (F.sum("old") + F.sum("new")).alias("new")).where(F.col("new") >= self.min_pages)
        state = lambda n, every: (F.col(n) >= self.min_pages) & (F.col(n) >= self.min_share * F.col(every) - 1e-9)
        both = both.join(total, "src").select("src", "line", state("old", "old_all").alias("was"), state("new", "new_all").alias("now"))
        return both.where("was <> now").select("src", "line", "now")

    def compact(self) -> "LineLedger":
        """Add up the appended counts to one part. The hashes of the pages and the lists stay where they are."""
        to = f"{self._folder(self.version)}-all"
        self._counts("pages", self.version).groupBy("src").agg(F.sum("pages").alias("pages")).write.parquet(f"{to}/pages")
        self._counts("lines", self.version).groupBy("src", "line").agg(F.sum("pages").alias("pages")).write.parquet(f"{to}/lines")
        self.parts = [(self.version, to)]
        return self

    def repeated(self, version: int | None = None) -> DataFrame:
        """(src, line) of the repeated lines, as of a version."""
        v = self.version if version is None else version
        return self._read("list", [self._folder(v)] if v else [])

    def crossings(self, version: int | None = None) -> DataFrame:
        """(src, line, now): lines whose state a merge, by default the last, has changed."""
        v = self.version if version is None else version
        return self._read("crossed", [self._folder(v)] if v else [])

    def _by_source(self, lines: DataFrame, *also: str) -> DataFrame:
        """One row for each source. The list is bounded: each line on it is on ``min_share`` of the source's pages, so there are
        at most 1 / min_share times as many as a page has on average."""
        return lines.groupBy("src", *also).agg(F.collect_set("line").alias("__lines"))

    def _pages(self, version: int | None = None) -> DataFrame:
        return self._read("keys", [self._folder(v) for v in range(1, (self.version if version is None else version) + 1)])

    def found(self, key: str = "page_id") -> DataFrame:
        """(key, line_no): every repeated line of every merged page, from the pages' hashes."""
        d = self._pages().join(self._by_source(self.repeated()), "src")
        hit = F.filter(F.transform("keys", lambda k, i: F.when(F.array_contains("__lines", k), i + 1)), lambda i: i.isNotNull())
        return d.select(F.col("key").alias(key), F.explode(hit).alias("line_no"))

    def clean(self, df: DataFrame, source: str = "site", text: str = "text", into: str = "clean_text") -> DataFrame:
        """``df`` with ``into``: the text without repeated lines, the others as they were. Texts of null sources and texts
        without repeated lines come out unchanged, null stays null. An existing column ``into`` is replaced."""
        lines = self._by_source(self.repeated()).withColumnRenamed("src", "__src")
        d = df.drop(into) if into in df.columns and into not in (source, text) else df
        d = d.join(lines, F.col(f"`{source}`") == F.col("__src"), "left")
        return d.withColumn(into, self._without(F.col(f"`{text}`"))).drop("__lines", "__src")

    def _without(self, text: Column) -> Column:
        zipped = F.arrays_zip(F.split(text, "\n", -1).alias("x"), line_keys(text, self.min_letters).alias("k"))
        kept = F.filter(zipped, lambda p: p["k"].isNull() | ~F.array_contains(F.col("__lines"), p["k"]))
        return F.when(F.col("__lines").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda p: p["x"]), "\n"))

    def rebuilt(self, df: DataFrame, versions: list[int] | None = None, key: str = "page_id", text: str = "text") -> DataFrame:
        """(partition_no, key, clean_text): for each of the merges (default: the last) those documents merged by then that hold a
        line which crossed with it, cleaned as of then. ``df`` has the texts of all merged documents; only those of the documents to
        rebuild are taken from it, in one pass for all merges."""
        out = None
        for v in versions or [self.version]:
            crossed = self._by_source(self.crossings(v)).withColumnRenamed("__lines", "__crossed")
            hit = self._pages(v).join(crossed, "src").where(F.arrays_overlap("keys", "__crossed")).select(F.lit(v).alias("partition_no"), "key", "src").distinct()
            hit = hit.join(self._by_source(self.repeated(v)), "src", "left")
            out = hit if out is None else out.unionByName(hit)
        d = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t")).join(out, "key")
        return d.select("partition_no", F.col("key").alias(key), self._without(F.col("t")).alias("clean_text"))
