"""Execution history: rates, flags, recency and the scores made of them. `as_of` stands for the present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def days_before(as_of: str, at: Column) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000.0)


def summary(runs: DataFrame, as_of: str) -> DataFrame:
    """One row per test_id, from one pass: counts, rates, last result, windows of 1, 3, 7 and 30 days, variability."""
    age = days_before(as_of, F.col("executed_at"))
    failed = ~F.col("passed")
    some = runs.withColumn("age", age)
    newest = Window.partitionBy("test_id").orderBy(F.desc("recent"), F.desc("executed_at"), "run_id")
    some = some.withColumn("recent", failed & (F.col("age") <= 7)).withColumn("k", F.when(F.col("recent"), F.row_number().over(newest)))
    points = F.when(F.col("age") <= 1, 0.3).when(F.col("age") <= 3, 0.2).otherwise(0.1)
    mine = F.col("k") <= 5
    last = F.struct("executed_at", F.negative(F.col("run_id")).alias("r"))
    return some.groupBy("test_id").agg(
        F.count("*").alias("runs"), F.count_if(failed).alias("failures"), F.max_by("passed", last).alias("last_passed"), F.max("executed_at").alias("last_run"),
        F.avg(F.when(F.col("passed"), F.col("duration_ms"))).alias("avg_passed_ms"), F.stddev_pop("duration_ms").alias("sd_ms"), F.avg("duration_ms").alias("mean_ms"),
        F.count_if(F.col("age") <= 7).alias("runs_7d"), F.count_if(F.col("age") <= 30).alias("runs_30d"), F.count_if(failed & (F.col("age") <= 30)).alias("failures_30d"),
        F.min("age").alias("last_age"), F.sum(F.when(mine, points)).alias("points"), F.count(F.when(mine, 1)).alias("recent"),
        (F.max(F.when(mine, F.col("age"))) - F.min(F.when(mine, F.col("age")))).alias("span"),
    )


def failure_rate() -> Column:
    return F.when(F.col("runs") > 0, F.col("failures") / F.col("runs")).otherwise(0.0)


def is_flaky() -> Column:
    return (F.col("runs") >= 5) & (failure_rate() > 0.1) & (failure_rate() < 0.9)


def reliability() -> Column:
    rate = 1 - failure_rate()
    return F.when(F.coalesce("runs", F.lit(0)) == 0, 0.5).when((rate >= 0.7) & (rate <= 0.95), 0.8).when(rate > 0.95, 0.6).when(rate >= 0.5, 0.5).when(rate >= 0.2, 0.3).otherwise(0.1)


def recent_failures() -> Column:
    total = F.coalesce("points", F.lit(0.0)) + F.when((F.col("recent") >= 2) & (F.col("span") <= 2), 0.2).otherwise(0.0)
    return F.least(F.lit(0.5), total)


def frequency() -> Column:
    week = F.when(F.col("runs_7d") >= 5, 0.2).when(F.col("runs_7d") >= 2, 0.1).otherwise(0.0)
    month = F.when(F.col("runs_30d") >= 10, 0.2).when(F.col("runs_30d") >= 5, 0.1).otherwise(0.0)
    last = F.when(F.col("last_age") <= 1, 0.1).when(F.col("last_age") <= 7, 0.05).otherwise(0.0)
    return F.least(F.lit(0.4), week + month + last)


FLAKY_FACTOR = {"Fast": 0.3, "Medium": 0.6, "High": 0.8, "Full": 0.9}


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def score(level: str = "Medium") -> Column:
    """Reliability, recent failures and frequency, less for flaky tests; 0.5 without history."""
    none = F.coalesce("runs", F.lit(0)) == 0
    total = reliability() + recent_failures() + frequency()
    return F.when(none, 0.5).otherwise(clamp(total * F.when(is_flaky(), FLAKY_FACTOR[level]).otherwise(1.0)))


def variability_factor() -> Column:
    cv = F.try_divide("sd_ms", "mean_ms")
    return F.when((F.col("runs") < 3) | F.col("runs").isNull() | cv.isNull(), 1.0).when(cv > 0.5, 0.8).when(cv > 0.3, 0.9).otherwise(1.0)


def historical_success() -> Column:
    return F.coalesce((F.col("failures_30d") > 0) & (F.col("failures_30d") < F.col("runs") / 2), F.lit(False))
