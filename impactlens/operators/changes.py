"""Snapshots of files, what changed between them, and which cached results that makes stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot(files: DataFrame, content: str = "content") -> DataFrame:
    return files.select("path", F.sha2(content, 256).alias("sha256"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (Added, Deleted, Modified) of the files that differ."""
    a, b = old.select("path", F.col("sha256").alias("before")), new.select("path", F.col("sha256").alias("after"))
    status = F.when(F.col("before").isNull(), "Added").when(F.col("after").isNull(), "Deleted").when(F.col("before") != F.col("after"), "Modified")
    return a.join(b, "path", "full_outer").withColumn("status", status).where("status is not null").select("path", "status")


def stale(changed: DataFrame, keys: DataFrame) -> DataFrame:
    """cache_key of entries (cache_key, files) that depend on a changed path, ignoring case."""
    by_file = keys.select("cache_key", F.explode("files").alias("f")).withColumn("f", F.lower("f"))
    return by_file.join(changed.select(F.lower("path").alias("f")), "f", "left_semi").select("cache_key").distinct()


def cleanup(entries: DataFrame, as_of: str, limit_bytes: int, shard: str = "owner") -> DataFrame:
    """entries (owner, path, bytes, created, accessed) that go: those older than 30 days, those not used for 7, and
    then the least recently used until an owner is within 70 % of the limit."""
    age = lambda c: (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(c).cast("timestamp"))) / F.lit(86_400_000_000.0)
    reason = F.when(age("created") > 30, "expired").when(age("accessed") > 7, "unused")
    marked = entries.withColumn("reason", reason)
    newest = Window.partitionBy(shard).orderBy(F.desc("accessed"), "path").rowsBetween(Window.unboundedPreceding, 0)
    left = marked.where("reason is null").withColumn("kept", F.sum("bytes").over(newest))
    over = left.where(F.col("kept") > limit_bytes * 0.7).withColumn("reason", F.lit("lru")).drop("kept")
    return marked.where("reason is not null").unionByName(over)
