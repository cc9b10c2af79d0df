"""Coverage maps and what changes mean for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impactlens.functions import names
from impactlens.operators.containment import containing


def coverage_map(coverage: DataFrame) -> DataFrame:
    """method_id, tests: how many tests cover each covered method (the pairs themselves stay in long form)."""
    return coverage.groupBy("method_id").agg(F.count_distinct("test_id").alias("tests"))


def statistics(coverage: DataFrame, methods: DataFrame) -> DataFrame:
    """One row: production methods, covered ones, relationships, percentage (0 without methods)."""
    total = methods.where(~F.col("is_test")).agg(F.count("*").alias("methods"))
    some = coverage.agg(F.count_distinct("method_id").alias("covered"), F.count("*").alias("relationships"))
    return total.crossJoin(some).withColumn("percentage", F.coalesce(100.0 * F.try_divide("covered", "methods"), F.lit(0.0)))


def uncovered(methods: DataFrame, coverage: DataFrame) -> DataFrame:
    return methods.where(~F.col("is_test")).join(coverage, "method_id", "left_anti").select("method_id")


def confidence_histogram(coverage: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return coverage.agg(F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"), F.coalesce(F.avg(c), F.lit(0.0)).alias("average"))


def change_coverage(changes: DataFrame, coverage: DataFrame) -> DataFrame:
    """change_id, changed, covered, tests, percentage (100 without changed methods).

    changes: change_id, changed_methods. The equi-join on the method is the only shuffle of coverage."""
    wanted = changes.select("change_id", F.explode_outer("changed_methods").alias("method_id")).distinct()
    by_method = wanted.join(coverage.select("method_id", "test_id").distinct(), "method_id", "left")
    found = by_method.groupBy("change_id").agg(F.count_distinct("method_id").alias("changed"), F.count_distinct(F.when(F.col("test_id").isNotNull(), F.col("method_id"))).alias("covered"), F.count_distinct("test_id").alias("tests"))
    return found.withColumn("percentage", F.when(F.col("changed") == 0, 100.0).otherwise(100.0 * F.try_divide("covered", "changed")))


def recommendations(changes: DataFrame, coverage: DataFrame) -> DataFrame:
    """change_id, priority, kind, affected. coverage: test_id, method_id, depth, confidence."""
    wanted = changes.select("change_id", F.explode("changed_methods").alias("method_id")).distinct()
    joined = wanted.join(coverage, "method_id", "left")
    best = joined.groupBy("change_id", "method_id").agg(F.max("confidence").alias("confidence"), F.min("depth").alias("depth"))
    kind = F.explode(F.filter(F.array(
        F.when(F.col("confidence").isNull(), F.struct(F.lit("High").alias("priority"), F.lit("MissingTests").alias("kind"))),
        F.when(F.col("confidence") < 0.6, F.struct(F.lit("Medium").alias("priority"), F.lit("LowConfidence").alias("kind"))),
        F.when(F.col("depth") > 3, F.struct(F.lit("Low").alias("priority"), F.lit("IndirectCoverage").alias("kind"))),
    ), lambda x: x.isNotNull()))
    return best.select("change_id", kind.alias("r")).groupBy("change_id", "r.priority", "r.kind").agg(F.count("*").alias("affected"))


def fuzzy_matches(tests: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (given), test_id, tier: name equal, then class.method, then an ending, then contained; the best tier of
    each test. Every tier but the first implies that the id contains the name, so those come from one containment join,
    and the first from a join by name."""
    name, given = F.lower(F.col("method_name")), F.lower(F.col("given"))
    tier = (
        F.when(name == names.name_only(given), 1).when(F.endswith(F.lower("test_id"), F.concat_ws(".", names.type_qualifier(given), names.name_only(given))), 2)
        .when(F.endswith(F.lower("test_id"), given), 3).when(F.contains(F.lower("test_id"), names.name_only(given)), 4)
    )
    asked = wanted.select("given", names.name_only(F.lower("given")).alias("short")).distinct()
    held = containing(asked.select(F.col("short").alias("given")), tests.select("test_id", "method_name", F.lower("test_id").alias("value")))
    held = held.withColumnRenamed("given", "short").join(asked, "short").select("test_id", "method_name", "given")
    same = tests.select("test_id", "method_name", F.lower("method_name").alias("short")).join(asked, "short").select("test_id", "method_name", "given")
    found = held.unionByName(same).distinct().withColumn("tier", tier).where("tier is not null")
    first = Window.partitionBy("given", "test_id").orderBy("tier")
    return found.withColumn("k", F.row_number().over(first)).where("k = 1").select("given", "test_id", "tier")
