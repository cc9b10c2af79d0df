"""Stored results: a table of keyed values with expiry, what it holds, what is out of date, and how it is kept small."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from impactlens.operators import symbols
from impactlens.operators.history import days_before

# Least count of projects, bytes at most, days kept, days unused, minutes between cleanups.
STORAGE = [(100, 250_000_000, 7, 1, 15), (40, 500_000_000, 14, 3, 30), (10, 1_073_741_824, 30, 7, 60)]


class Store:
    """Keyed values in Parquet (gzip): writing appends, the newest value of a key that hasn't expired counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, entries: DataFrame) -> None:
        """entries: key, value, created, expires (null: never)."""
        entries.select("key", "value", F.col("created").cast("timestamp").alias("created"), F.col("expires").cast("timestamp").alias("expires")).write.mode("append").option("compression", "gzip").parquet(self.path)

    def get(self, as_of: str, keys: DataFrame | None = None) -> DataFrame:
        """key, value. keys: only these (column key)."""
        now = F.lit(as_of).cast("timestamp")
        rows = self.spark.read.parquet(self.path).where(F.col("created") <= now)
        rows = rows if keys is None else rows.join(keys.select("key"), "key", "left_semi")
        newest = rows.groupBy("key").agg(F.max_by(F.struct("value", "expires"), F.struct("created", "value")).alias("v"))
        return newest.where(F.col("v.expires").isNull() | (F.col("v.expires") > now)).select("key", "v.value")


    def get_or_make(self, keys: DataFrame, as_of: str, make: Callable[[DataFrame], DataFrame], lifetime_days: int | None = None) -> DataFrame:
        """key, value for all keys: what is stored, and, for keys without a stored value, what `make` (from key to key and
        value) gives, which is stored for the next time."""
        wanted = keys.select("key").distinct()
        had = self.get(as_of, wanted)
        made = make(wanted.join(had, "key", "left_anti")).select("key", "value")
        expires = F.lit(None).cast("timestamp") if lifetime_days is None else F.lit(as_of).cast("timestamp") + F.make_dt_interval(F.lit(lifetime_days))
        self.put(made.withColumn("created", F.lit(as_of).cast("timestamp")).withColumn("expires", expires))
        return self.get(as_of, wanted)


class GraphStore:
    """Call graphs of projects in Parquet, each under the fingerprint of the files it was made from."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, edges: DataFrame, fingerprints: DataFrame) -> None:
        """edges: project, caller, callee; fingerprints: project, fingerprint."""
        edges.join(fingerprints, "project").select("project", "fingerprint", "caller", "callee").write.mode("append").parquet(self.path)

    def get(self, fingerprints: DataFrame) -> DataFrame:
        """project, caller, callee of the projects whose files still have the fingerprint they had."""
        return usable(self.spark.read.parquet(self.path), fingerprints.select("project", "fingerprint")).select("project", "caller", "callee").distinct()

    def stale(self, fingerprints: DataFrame) -> DataFrame:
        """project of stored graphs that must be made anew."""
        held = self.spark.read.parquet(self.path).select("project", "fingerprint").distinct()
        return held.join(fingerprints.select("project", "fingerprint"), ["project", "fingerprint"], "left_anti").select("project").distinct()


class IndexStore:
    """Symbols of files in Parquet under the hash of their content, so that only contents that are new are read again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def warm(self, files: DataFrame) -> DataFrame:
        """Indexes the contents (path, content) that aren't held; sha256 of those that were."""
        hashed = files.select(F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"), "content").dropDuplicates(["sha256"])
        held = self._held()
        new = hashed if held is None else hashed.join(held.select("sha256").distinct(), "sha256", "left_anti")
        found = symbols.index(new.select(F.col("sha256").alias("path"), "content")).select(F.col("path").alias("sha256"), "kind", "symbol")
        none = new.select("sha256", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("symbol"))
        found.unionByName(none).write.mode("append").parquet(self.path)
        return new.select("sha256")

    def _held(self) -> DataFrame | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema("sha256 string, kind string, symbol string").parquet(self.path) if there else None

    def get(self, files: DataFrame) -> DataFrame:
        """kind, symbol, path of files whose contents are held."""
        own = files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"))
        held = self._held()
        return own.join(held.where("kind is not null"), "sha256").select("kind", "symbol", "path").distinct()


def capacity(entries: DataFrame, as_of: str, limit_bytes: int, incoming_bytes: int, free_bytes: int | None = None) -> DataFrame:
    """One row: bytes held, bytes that a cleanup would leave, whether one is needed, and whether so much more may be stored.

    entries: bytes, created, accessed; free_bytes: the room on the disk, which must do in any case."""
    gone = (days_before(as_of, F.col("created")) > 30) | (days_before(as_of, F.col("accessed")) > 7)
    found = entries.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(~gone, F.col("bytes"))), F.lit(0)).alias("fresh"))
    left = F.least(F.col("fresh"), F.lit(int(limit_bytes * 0.7)))
    over = F.col("bytes") + incoming_bytes > limit_bytes
    room = F.lit(True) if free_bytes is None else F.lit(free_bytes >= incoming_bytes)
    return found.select("bytes", left.cast("long").alias("after_cleanup"), over.alias("needs_cleanup"), (room & (~over | (left + incoming_bytes <= limit_bytes))).alias("allowed"))


def saving_of(text: str, sample: int = 1024) -> float:
    """What compressing a text would save, as a share: of all of a short one, else the mean of three samples."""
    data = text or ""
    if not data:
        return 0.0
    size = min(sample, len(data) // 10)
    parts = [data] if len(data) < sample else [data[:size], data[len(data) // 2 : len(data) // 2 + size], data[-size:]]
    saved = [1 - len(zlib.compress(p.encode(), 6)) / len(p.encode()) for p in parts]
    return sum(saved) / len(saved)


@F.pandas_udf(DoubleType())
def estimated_saving(texts: pd.Series) -> pd.Series:
    """`saving_of` of a column, in Arrow batches."""
    return texts.map(saving_of)


def storage_statistics(entries: DataFrame, as_of: str, limit_bytes: int, days_kept: int = 30, days_unused: int = 7) -> DataFrame:
    """One row on entries (bytes, created, accessed): counts and bytes of all, expired and unused ones; whether the limit is
    near (80 %) and whether a cleanup is due (anything expired, over 10 unused, or near the limit)."""
    old, idle = days_before(as_of, F.col("created")) > days_kept, days_before(as_of, F.col("accessed")) > days_unused
    size = lambda when: F.coalesce(F.sum(F.when(when, F.col("bytes"))), F.lit(0))
    found = entries.agg(
        F.count("*").alias("files"), size(F.lit(True)).alias("bytes"), F.count_if(old).alias("expired"), size(old).alias("expired_bytes"),
        F.count_if(idle).alias("unused"), size(idle).alias("unused_bytes"),
    )
    near = F.col("bytes") > limit_bytes * 0.8
    return found.withColumn("near_limit", near).withColumn("cleanup_due", (F.col("expired") > 0) | (F.col("unused") > 10) | near)


def activity(entries: DataFrame, as_of: str) -> DataFrame:
    """One row on entries (bytes, expires): total, active, expired, bytes."""
    gone = F.coalesce(F.col("expires") <= F.lit(as_of).cast("timestamp"), F.lit(False))
    return entries.agg(F.count("*").alias("total"), F.count_if(~gone).alias("active"), F.count_if(gone).alias("expired"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def ratios(counters: DataFrame) -> DataFrame:
    """One row on counters (hits, misses, packed, plain): hit ratio and saving, 0 where nothing was counted."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    found = counters.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "misses", "packed", "plain")))
    return found.withColumn("hit_ratio", share(F.col("hits"), F.col("hits") + F.col("misses"))).withColumn("saving", F.when(F.col("plain") > 0, 1 - share(F.col("packed"), F.col("plain"))).otherwise(0.0))


def modified_assemblies(files: DataFrame, cached: DataFrame) -> DataFrame:
    """path of cached or present files that must be read again: gone, not cached, or written after they were cached.

    files: path, written; cached: path, discovered."""
    both = files.select("path", "written").join(cached.select("path", "discovered"), "path", "full_outer")
    return both.where(F.col("written").isNull() | F.col("discovered").isNull() | (F.col("written") > F.col("discovered"))).select("path")


def changed_projects(files: DataFrame, cached: DataFrame) -> DataFrame:
    """project of cached projects (project, created) with a file (project, written) newer than the entry."""
    newest = files.groupBy("project").agg(F.max("written").alias("written"))
    return cached.join(newest, "project").where("written > created").select("project")


def content_fingerprints(files: DataFrame) -> DataFrame:
    """project, fingerprint: the hash of its files' hashes (project, path, sha256) by path."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda f: f["sha256"])
    return files.groupBy("project").agg(F.sha2(F.array_join(ordered, "|"), 256).alias("fingerprint"))


def usable(cached: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Cached rows (project, fingerprint, ...) whose project still has this fingerprint."""
    return cached.join(fingerprints, ["project", "fingerprint"], "left_semi")


def storage_options(counts: DataFrame) -> DataFrame:
    """counts (projects) with the options advised for so many: most_bytes, days_kept, days_unused, cleanup_minutes; null where
    the defaults will do."""
    out = F.lit(None).cast("struct<most_bytes:bigint,days_kept:int,days_unused:int,cleanup_minutes:int>")
    for least, size, kept, unused, minutes in reversed(STORAGE):
        some = F.struct(F.lit(size).cast("bigint").alias("most_bytes"), F.lit(kept).alias("days_kept"), F.lit(unused).alias("days_unused"), F.lit(minutes).alias("cleanup_minutes"))
        out = F.when(F.col("projects") >= least, some).otherwise(out)
    return counts.withColumn("o", out).select(*counts.columns, "o.*")


def evict(entries: DataFrame, limit_bytes: int, share: float = 0.7, shard: str = "owner") -> DataFrame:
    """Entries (owner, path, bytes, accessed) that go, least recently used first, until an owner is within its share."""
    newest = Window.partitionBy(shard).orderBy(F.desc("accessed"), "path").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("kept", F.sum("bytes").over(newest)).where(F.col("kept") > limit_bytes * share).drop("kept")
