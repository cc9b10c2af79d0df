"""Scores and selection: execution time, change impact, combination, greedy plans and batches."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactlens.operators import history
from impactlens.operators.containment import containing

# Confidence levels.
LEVELS = {"Fast": (0.70, 30, 50, 0.6), "Medium": (0.85, 300, 200, 0.4), "High": (0.95, 900, 1000, 0.2), "Full": (0.99, 3600, None, 0.0)}


def levels(spark: SparkSession) -> DataFrame:
    """level, confidence, seconds, most, least: the levels as a table of four rows."""
    return spark.createDataFrame([(k, *v) for k, v in LEVELS.items()], "level string, confidence double, seconds int, most int, least double")


WEIGHTS = {"impact": 0.4, "time": 0.3, "history": 0.3}
BASELINE = {"Unit": 0.3, "Integration": 0.6, "Database": 0.4, "API": 0.7, "UI": 0.5, "EndToEnd": 0.8, "Performance": 0.3, "Security": 0.9}


def base_time(ms: Column) -> Column:
    out = F.lit(0.1)
    for most, value in ((15_000, 0.2), (5_000, 0.3), (1_000, 0.5), (500, 0.7), (250, 0.8), (100, 0.9), (50, 1.0)):
        out = F.when(ms <= most, value).otherwise(out)
    return out


def time_score(ms: Column, level: str = "Medium", factor: Column | None = None) -> Column:
    base = base_time(ms)
    by_level = {
        "Fast": F.when(ms > 500, base * 0.3).otherwise(base * 1.2),
        "Medium": F.when(ms > 5_000, base * 0.6).otherwise(base),
        "High": F.when(ms > 30_000, base * 0.8).otherwise(base),
        "Full": base * 0.9,
    }[level]
    return history.clamp(by_level * (factor if factor is not None else F.lit(1.0)))


def by_category(values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(F.col("category") == name, value).otherwise(out)
    return out


def baseline_impact() -> Column:
    """Impact without changes: the category, a recent failure, and less for flaky tests."""
    failed = F.coalesce(~F.col("last_passed"), F.lit(False))
    more = F.when(failed & (F.col("last_age") < 7), 0.3).when(failed & (F.col("last_age") < 30), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), (by_category(BASELINE, 0.2) + more) * F.when(F.coalesce(history.is_flaky(), F.lit(False)), 0.7).otherwise(1.0))


def change_impact(tests: DataFrame, changes: DataFrame) -> DataFrame:
    """tests (test_id, name, category, file_path, dependencies, historical_success) with `impact`, for a change set
    (file_path, change_type, changed_methods, changed_types). Changed names, types and files are joined by key with what
    the tests have; only five flags of the whole change set stand in one row."""
    has = lambda col, *words: F.coalesce(F.max(F.exists(col, lambda t: F.greatest(*(t.contains(w) for w in words), F.lit(False)))), F.lit(False))
    flags = changes.agg(
        has("changed_types", "Repository", "DbContext", "Entity").alias("db"), has("changed_types", "Controller", "Service").alias("api"),
        F.coalesce(F.max(F.col("file_path").contains("View") | F.col("file_path").contains("Component")), F.lit(False)).alias("ui"),
        F.coalesce(F.max(F.col("file_path").contains("Auth") | F.col("file_path").contains("Security")), F.lit(False)).alias("sec"),
        F.coalesce(F.max(F.col("change_type") == "Configuration"), F.lit(False)).alias("conf"),
    )
    none = F.array().cast("array<string>")
    changed = changes.select(F.explode(F.concat(F.coalesce("changed_methods", none), F.coalesce("changed_types", none))).alias("given")).select(F.lower("given").alias("key")).distinct()
    needs = tests.select("test_id", F.explode("dependencies").alias("d")).select("test_id", F.lower("d").alias("key"))
    direct_ = needs.join(changed, "key", "left_semi").groupBy("test_id").agg(F.count("*").alias("direct"))
    types = changes.select(F.explode("changed_types").alias("t")).select(F.lower(F.substring_index("t", ".", -1)).alias("given")).where("given != ''").distinct()
    named_ = containing(types, tests.select("test_id", F.lower("name").alias("value"))).select("test_id").distinct().withColumn("named", F.lit(True))
    files = changes.select(F.lower("file_path").alias("file_key")).distinct().withColumn("in_file", F.lit(True))
    joined = tests.join(direct_, "test_id", "left").join(named_, "test_id", "left").withColumn("file_key", F.lower("file_path")).join(files, "file_key", "left")
    joined = joined.crossJoin(F.broadcast(flags))  # one row
    direct, named, in_file = F.coalesce("direct", F.lit(0)), F.coalesce("named", F.lit(False)), F.coalesce("in_file", F.lit(False))
    category = F.col("category")
    table = (
        F.when(category == "Unit", F.when((direct > 0) | named, 0.6).otherwise(0.2)).when(category == "Integration", 0.4).when(category == "Database", F.when(F.col("db"), 0.7).otherwise(0.2))
        .when(category == "API", F.when(F.col("api"), 0.8).otherwise(0.3)).when(category == "UI", F.when(F.col("ui"), 0.6).otherwise(0.1)).when(category == "EndToEnd", 0.3)
        .when(category == "Security", F.when(F.col("sec"), 1.0).otherwise(0.1)).otherwise(0.1)
    )
    configured = F.when(F.col("conf"), by_category({"Integration": 0.3, "EndToEnd": 0.4, "API": 0.3}, 0.1)).otherwise(0.0)
    total = (
        F.when(direct > 0, F.least(F.lit(0.9), direct * 0.3) + F.when(category == "Unit", 0.1).otherwise(0.0)).otherwise(0.0) + F.when(named, 0.8).otherwise(0.0)
        + F.when(in_file, 0.5).otherwise(0.0) + table + configured + F.when(F.col("historical_success"), 0.2).otherwise(0.0)
    )
    total = F.when((total < 0.1) & (category == "Integration"), 0.1).otherwise(total)
    return joined.withColumn("impact", F.least(F.lit(1.0), total)).select(*tests.columns, "impact")


def combined(**scores: Column) -> Column:
    """Weighted mean of the scores given, by WEIGHTS."""
    total = sum(WEIGHTS[k] for k in scores)
    return sum((v * WEIGHTS[k] for k, v in scores.items()), F.lit(0.0)) / total


@dataclass
class Scorers:
    """Scores by name, each with its weight and a Column made for a level; others can be added or put in their place.
    A score is at most 1 and at least 0; one that is null counts as 0."""

    held: dict[str, tuple[float, Callable[[str], Column]]] = field(default_factory=dict)

    @staticmethod
    def standard() -> Scorers:
        own = Scorers()
        own.add("impact", WEIGHTS["impact"], lambda level: baseline_impact())
        own.add("time", WEIGHTS["time"], lambda level: time_score(F.col("avg_ms"), level, history.variability_factor()))
        own.add("history", WEIGHTS["history"], lambda level: history.score(level))
        return own

    def add(self, name: str, weight: float, made: Callable[[str], Column]) -> Scorers:
        self.held[name] = (weight, made)
        return self

    def score(self, found: DataFrame, level: str = "Medium") -> DataFrame:
        """found with <name>_score of each and their weighted mean, `score`."""
        found = found.withColumns({f"{name}_score": made(level) for name, (_, made) in self.held.items()})
        total = sum(weight for weight, _ in self.held.values()) or 1.0
        parts = (F.when(F.col(f"{name}_score").isNull(), 0.0).otherwise(history.clamp(F.col(f"{name}_score"))) * weight for name, (weight, _) in self.held.items())
        return found.withColumn("score", sum(parts, F.lit(0.0)) / total)


def scored(tests: DataFrame, runs: DataFrame, as_of: str, level: str = "Medium", scorers: Scorers | None = None) -> DataFrame:
    """tests with the scores of each scorer (impact, time and history if none are given) and the combined one."""
    found = tests.join(history.summary(runs, as_of), "test_id", "left")
    return (scorers or Scorers.standard()).score(found, level)


def kind(tests: DataFrame) -> Column:
    """The category, renamed so that a plan can go by it; null where tests have none."""
    return (F.col("category") if "category" in tests.columns else F.lit(None).cast("string")).alias("kind")


def select(scored_tests: DataFrame, plan: str, level: str = "Medium", budget_ms: float | None = None, most: int | None = None) -> DataFrame:
    """Greedy selection within each plan: by score, passing over tests that don't fit the time that is left.

    Only candidates at or over the level's least score that fit the budget alone take part; the fold runs per plan.
    """
    _, seconds, count, least = LEVELS[level]
    budget = seconds * 1000.0 if budget_ms is None else budget_ms
    most = most or count or math.inf
    own = scored_tests.where((F.col("score") >= least) & (F.col("avg_ms") <= budget)).select(plan, "test_id", kind(scored_tests), "score", "avg_ms")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "test_id"], ascending=[False, True])
        used, keep = 0.0, []
        for i, ms in enumerate(frame["avg_ms"].tolist()):
            if len(keep) >= most:
                break
            if used + ms <= budget:
                used += ms
                keep.append(i)
        out = frame.iloc[keep].copy()
        out["place"] = range(1, len(keep) + 1)
        return out

    kinds = dict(scored_tests.dtypes)
    return own.groupBy(plan).applyInPandas(fold, f"{plan} {kinds[plan]}, test_id string, kind string, score double, avg_ms double, place long").withColumnRenamed("kind", "category")


ALONE = {"Database", "UI", "EndToEnd"}


def batches(selected: DataFrame, plan: str, parallel: int = 4, limit_ms: float = 300_000.0) -> DataFrame:
    """Batches of a plan's tests (test_id, score, avg_ms and, if there, category and dependencies).

    Tests are grouped with the first one they can run beside (neither of a kind that runs alone, no common dependency);
    groups go by their total time, tests by score. A batch is closed at `parallel` tests or when its longest test and
    the next one exceed `limit_ms`; it takes as long as its longest test."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["score", "test_id"], ascending=[False, True]).to_dict("records")
        width, number, held, longest, out = min(parallel, len(rows)), 1, 0, 0.0, []
        for group in sorted(compatible_groups(rows), key=lambda g: -sum(r["avg_ms"] for r in g)):
            for r in sorted(group, key=lambda r: (-r["score"], r["test_id"])):
                if held and (held >= width or longest + r["avg_ms"] > limit_ms):
                    number, held, longest = number + 1, 0, 0.0
                held, longest = held + 1, max(longest, r["avg_ms"])
                out.append((r[plan], r["test_id"], r["score"], r["avg_ms"], number))
        return pd.DataFrame(out, columns=[plan, "test_id", "score", "avg_ms", "batch"])

    kinds = dict(selected.dtypes)
    own = selected.select(plan, "test_id", kind(selected), "score", "avg_ms", *(["dependencies"] if "dependencies" in kinds else []))
    return own.groupBy(plan).applyInPandas(fold, f"{plan} {kinds[plan]}, test_id string, score double, avg_ms double, batch long")


def compatible_groups(rows: list[dict]) -> list[list[dict]]:
    """Each group is a first test and all later ones that can run beside it."""
    groups, left = [], rows
    while left:
        head, later = left[0], left[1:]
        needs = set(head.get("dependencies") if head.get("dependencies") is not None else ())
        fits = [head["kind"] not in ALONE and r["kind"] not in ALONE and needs.isdisjoint(r.get("dependencies") if r.get("dependencies") is not None else ()) for r in later]
        groups.append([head, *(r for r, f in zip(later, fits, strict=True) if f)])
        left = [r for r, f in zip(later, fits, strict=True) if not f]
    return groups


def compatible(selected: DataFrame, plan: str) -> DataFrame:
    """plan, test_id, head: the group of each test, by the first test of it, within a plan (test_id, category, score, avg_ms)."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["score", "test_id"], ascending=[False, True]).to_dict("records")
        return pd.DataFrame([(r[plan], r["test_id"], g[0]["test_id"]) for g in compatible_groups(rows) for r in g], columns=[plan, "test_id", "head"])

    kinds = dict(selected.dtypes)
    own = selected.select(plan, "test_id", kind(selected), "score", "avg_ms", *(["dependencies"] if "dependencies" in kinds else []))
    return own.groupBy(plan).applyInPandas(fold, f"{plan} {kinds[plan]}, test_id string, head string")


def can_run_beside(kind_a: Column, kind_b: Column, needs_a: Column, needs_b: Column) -> Column:
    """Neither is of a kind that runs alone, and they have no dependency in common."""
    return ~kind_a.isin(*ALONE) & ~kind_b.isin(*ALONE) & ~F.coalesce(F.arrays_overlap(needs_a, needs_b), F.lit(False))


def plan_time(batched: DataFrame, plan: str) -> DataFrame:
    """plan, ms: batches one after the other, each as long as its longest test."""
    return batched.groupBy(plan, "batch").agg(F.max("avg_ms").alias("ms")).groupBy(plan).agg(F.sum("ms").alias("ms"), F.count("*").alias("batches"))


def select_fast(scored_tests: DataFrame, plan: str, budget_ms: float = 30_000.0, most: int = 50, least: float = 0.6) -> DataFrame:
    """Greedy selection for quick feedback: up to 80 % unit tests, then integration tests, then whatever fits, by score."""
    units = max(1, int(most * 0.8))
    own = scored_tests.where((F.col("score") >= min(least, 0.4)) & (F.col("avg_ms") <= budget_ms)).select(plan, "test_id", F.col("category").alias("kind"), "score", "avg_ms")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(frame.sort_values(["score", "test_id"], ascending=[False, True]).itertuples(index=False))
        kept, used = [], 0.0
        for kind, quota, floor in (("Unit", units, max(least, 0.5)), ("Integration", most - units, max(least, 0.4)), (None, most, least)):
            taken, seen = 0, {r.test_id for r in kept}
            for r in rows:
                if taken >= quota or len(kept) >= most:
                    break
                if (kind in (None, r.kind)) and r.test_id not in seen and r.score >= floor and used + r.avg_ms <= budget_ms:
                    kept.append(r)
                    taken, used = taken + 1, used + r.avg_ms
        out = pd.DataFrame(kept, columns=frame.columns)
        out["place"] = range(1, len(kept) + 1)
        return out

    kinds = dict(scored_tests.dtypes)
    return own.groupBy(plan).applyInPandas(fold, f"{plan} {kinds[plan]}, test_id string, kind string, score double, avg_ms double, place long").withColumnRenamed("kind", "category")


def plan_metrics(selected: DataFrame, plan: str) -> DataFrame:
    """plan, tests, total_ms, mean_score, categories (a map of counts)."""
    by_kind = selected.groupBy(plan, "category").agg(F.count("*").alias("n"), F.sum("avg_ms").alias("ms"), F.sum("score").alias("score"))
    return by_kind.groupBy(plan).agg(F.sum("n").alias("tests"), F.sum("ms").alias("total_ms"), (F.sum("score") / F.sum("n")).alias("mean_score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))


def expected_tests(methods: DataFrame, types: DataFrame) -> DataFrame:
    """test_name, confidence: names that tests of these methods (method_id) and types (type) would have by convention. They
    needn't exist; graph.tests_exercising finds those that do."""
    one = methods.select(F.concat("method_id", F.lit("Test")).alias("test_name"), F.lower("method_id").alias("k"), F.lit(0.8).alias("confidence"))
    two = types.select(F.concat("type", F.lit("IntegrationTest")).alias("test_name"), F.lower("type").alias("k"), F.lit(0.6).alias("confidence"))
    return one.unionByName(two).groupBy("k", "confidence").agg(F.min("test_name").alias("test_name")).select("test_name", "confidence")


def change_summary(changes: DataFrame) -> DataFrame:
    """One row on changes (file_path, changed_methods, changed_types): files, methods, types and the impact, at most 1."""
    found = changes.agg(F.count("*").alias("changes"), F.count_distinct("file_path").alias("files"), F.coalesce(F.sum(F.size("changed_methods")), F.lit(0)).alias("methods"), F.coalesce(F.sum(F.size("changed_types")), F.lit(0)).alias("types"))
    return found.withColumn("impact", F.when(F.col("changes") > 0, F.least(F.lit(1.0), (0.1 * F.col("methods") + 0.2 * F.col("types")) / F.col("changes"))).otherwise(0.0))
