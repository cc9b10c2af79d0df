"""Finding tests and methods by what a user typed: ids, endings, patterns, near misses. Equi-joins wherever the rule allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactlens.functions import names
from impactlens.operators.containment import containing


def among(coverage: DataFrame, tests: DataFrame) -> DataFrame:
    """Rows of coverage whose test is listed (test_id), ignoring case."""
    listed = tests.select(F.lower("test_id").alias("key")).distinct()
    return coverage.withColumn("key", F.lower("test_id")).join(listed, "key", "left_semi").drop("key")


def provided(tests: DataFrame, given: DataFrame) -> DataFrame:
    """tests (test_id, test_name) that are given: by id, by what follows any dot of it, or by name, ignoring case.

    Every ending is a key, so that the rule becomes an equi-join."""
    parts = F.split(F.lower("test_id"), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    keyed = tests.withColumn("key", F.explode(F.array_distinct(F.concat(endings, F.array(F.lower(F.coalesce("test_name", F.lit(""))))))))
    hit = keyed.join(given.select(F.lower("given").alias("key")).distinct(), "key", "left_semi").select("test_id").distinct()
    return tests.join(hit, "test_id", "left_semi")


def by_pattern(coverage: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, method_id, test_id: the tests of the very method, or else of every method that the pattern fits."""
    wanted = patterns.select("pattern").distinct()
    exact = wanted.join(coverage, F.col("pattern") == F.col("method_id")).select("pattern", "method_id", "test_id")
    missed = wanted.join(coverage.select(F.col("method_id").alias("pattern")), "pattern", "left_anti").withColumn("name", names.name_only(F.col("pattern")))
    methods = coverage.select("method_id").distinct().withColumn("name", names.name_only(F.col("method_id")))
    near = missed.join(methods, "name").where(names.pattern_matches(F.col("method_id"), F.col("pattern"))).select("pattern", "method_id")
    return exact.unionByName(near.join(coverage, "method_id").select("pattern", "method_id", "test_id")).distinct()


def changed_methods(methods: DataFrame, changed: DataFrame) -> DataFrame:
    """given, method_id: methods whose id is, ends in or contains a changed name, ignoring case."""
    wanted = changed.select("given", F.lower("given").alias("low")).distinct()
    found = containing(wanted.select(F.col("low").alias("given")), methods.select("method_id", F.lower("method_id").alias("value")).distinct())
    return found.select(F.col("given").alias("low"), "method_id").join(wanted, "low").select("given", "method_id")


def validated(wanted: DataFrame, tests: DataFrame) -> DataFrame:
    """given, valid: whether a test of this id exists, ignoring case."""
    known = tests.select(F.lower("test_id").alias("key")).distinct().withColumn("valid", F.lit(True))
    return wanted.select("given").distinct().withColumn("key", F.lower("given")).join(known, "key", "left").select("given", F.coalesce("valid", F.lit(False)).alias("valid"))


def suggestions(wanted: DataFrame, tests: DataFrame, most: int = 5) -> DataFrame:
    """given, test_id, distance, place: the nearest ids within a third of the length (3 at least); shorter ones first.

    Only ids whose length differs by no more than the distance allowed are compared: an equi-join on the length."""
    size = F.length("given")
    allowed = F.greatest(F.lit(3), F.floor(size / 3).cast("int"))
    asked = wanted.select("given").distinct().withColumn("allowed", allowed).withColumn("n", F.explode(F.sequence(F.greatest(size - F.col("allowed"), F.lit(0)), size + F.col("allowed"))))
    near = asked.join(tests.select("test_id", F.length("test_id").alias("n")).distinct(), "n").withColumn("distance", F.levenshtein("given", "test_id")).where("distance <= allowed")
    order = Window.partitionBy("given").orderBy("distance", "n", "test_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("given", "test_id", "distance", "place")


def search(tests: DataFrame, text: str) -> DataFrame:
    """Tests whose id or name contains a text, ignoring case."""
    return tests.where(F.contains(F.lower("test_id"), F.lit(text.lower())) | F.contains(F.lower("name"), F.lit(text.lower())))


def wanted_tests(
    include: list[str] | None = None, exclude: list[str] | None = None, tags: list[str] | None = None, no_tags: list[str] | None = None, flaky: Column | None = None
) -> Column:
    """Whether a test (category, tags) passes: categories in and out, any of some tags, none of others, and not flaky."""
    out = F.lit(True)
    has = lambda words: F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*(F.lit(w) for w in words)))
    if exclude:
        out = out & ~F.col("category").isin(exclude)
    if include:
        out = out & F.col("category").isin(include)
    if no_tags:
        out = out & ~has(no_tags)
    if tags:
        out = out & has(tags)
    return out if flaky is None else out & ~F.coalesce(flaky, F.lit(False))
