"""Conflicts between tests that use the same data. Self-joins go by resource or entity, never by all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRITERS = ("Write", "ReadWrite")


def severity(kind: Column) -> Column:
    return F.when(kind.isin("ExclusiveResource", "SharedData"), "High").when(kind == "PotentialRaceCondition", "Low").otherwise("Medium")


def blocks(kind: Column) -> Column:
    return kind.isin("SharedData", "ExclusiveResource", "OrderDependency")


def conflicts(deps: DataFrame) -> DataFrame:
    """i < j, kind, severity, blocking: the gravest conflict of each pair of tests. deps: test_id, resource_id, access, entity.

    The same resource with a writer is shared data; a common entity is resource contention; the same resource without a
    writer is a potential race."""
    side = lambda k: deps.select(F.col("test_id").alias(k), "resource_id", "entity", F.col("access").isin(*WRITERS).alias(f"w_{k}"))
    a, b = side("i"), side("j")
    same = a.drop("entity").distinct().join(b.drop("entity").distinct(), "resource_id").where("i < j")
    first = same.select("i", "j", F.when(F.col("w_i") | F.col("w_j"), 3).otherwise(1).alias("rank"))
    second = a.select("i", "entity").distinct().join(b.select("j", "entity").distinct(), "entity").where("i < j").select("i", "j", F.lit(2).alias("rank"))
    worst = first.unionByName(second).groupBy("i", "j").agg(F.max("rank").alias("rank"))
    kind = F.when(F.col("rank") == 3, "SharedData").when(F.col("rank") == 2, "ResourceContention").otherwise("PotentialRaceCondition")
    return worst.select("i", "j", kind.alias("kind")).withColumn("severity", severity(F.col("kind"))).withColumn("blocking", blocks(F.col("kind")))


def report(found: DataFrame, tests: int | None = None) -> DataFrame:
    return found.groupBy("kind", "severity").agg(F.count("*").alias("pairs"), F.count_if("blocking").alias("blocking"))


def parallel_ratio(found: DataFrame, deps: DataFrame) -> DataFrame:
    """One row: tests with dependencies, pairs of them that must and that can run apart, and the share that can."""
    n = deps.agg(F.count_distinct("test_id").alias("tests"))
    must = found.agg(F.count_if("blocking").alias("must"))
    total = F.col("tests") * (F.col("tests") - 1) / 2
    return n.crossJoin(must).withColumn("can", (total - F.col("must")).cast("long")).withColumn("ratio", F.when(total == 0, 0.0).otherwise((total - F.col("must")) / F.greatest(total, F.lit(1.0))))


def shared_fixtures(tests: DataFrame) -> DataFrame:
    """i < j of tests (test_id, class_name) of one class: they share its fixture. One row per pair, so for the tests of a
    plan, not for a whole history."""
    a, b = tests.select(F.col("test_id").alias("i"), "class_name"), tests.select(F.col("test_id").alias("j"), "class_name")
    return a.join(b, "class_name").where("i < j").select("i", "j", F.lit("SharedFixture").alias("kind"), severity(F.lit("SharedFixture")).alias("severity"), F.lit(False).alias("blocking"))


def reasons(deps: DataFrame) -> DataFrame:
    """i < j, reason: the resources, or else the entities, that two tests have in common."""
    side = lambda k, what: deps.select(F.col("test_id").alias(k), F.col(what).alias("w")).distinct()

    def common(what):
        return side("i", what).join(side("j", what), "w").where("i < j").groupBy("i", "j").agg(F.array_join(F.array_sort(F.collect_list("w")), ", ").alias(what))

    both = common("resource_id").join(common("entity"), ["i", "j"], "full_outer")
    text = F.when(F.col("resource_id").isNotNull(), F.concat(F.lit("Both use "), "resource_id")).otherwise(F.concat(F.lit("Both touch "), "entity"))
    return both.select("i", "j", text.alias("reason"))


def can_run(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs (i, j) with can_run: no blocking conflict between them."""
    stop = found.where("blocking").select("i", "j").distinct().withColumn("stop", F.lit(True))
    return pairs.join(stop, ["i", "j"], "left").withColumn("can_run", F.col("stop").isNull()).drop("stop")


def exclusive(deps: DataFrame, memory: str = "InMemory") -> DataFrame:
    """test_id, exclusive: whether a test writes to or deletes from anything but a database in memory."""
    writes = F.col("access").isin("Write", "ReadWrite", "Delete") & ~F.contains(F.col("resource_id"), F.lit(memory))
    return deps.groupBy("test_id").agg(F.coalesce(F.bool_or(writes), F.lit(False)).alias("exclusive"))
