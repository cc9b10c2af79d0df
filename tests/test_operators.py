"""Known values and small cases for the operators."""


import pytest
from pyspark.sql import functions as F

from impactlens.functions import classify, diff, names
from impactlens.operators import changes, conflict, coverage, graph, history, scoring, similarity


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("ms,level,want", [
    (25, "Medium", 1.0), (75, "Medium", 0.9), (200, "Medium", 0.8), (400, "Medium", 0.7), (750, "Medium", 0.5), (3000, "Medium", 0.3), (10000, "Medium", 0.12), (20000, "Medium", 0.06),
    (100, "Fast", 1.0), (600, "Fast", 0.15), (6000, "Medium", 0.12), (100, "High", 0.9), (35000, "High", 0.08), (100, "Full", 0.81),
])
def test_time_scores(spark, ms, level, want):
    assert value(spark, scoring.time_score(F.lit(float(ms)), level)) == pytest.approx(want, abs=1e-9)


def test_reliability(spark):
    for passed, want in ((9, 0.8), (10, 0.6), (6, 0.5), (3, 0.3), (1, 0.1)):
        runs = [("t", i, i < passed, 10.0, f"2023-01-{i + 1:02d} 00:00:00") for i in range(10)]
        table = spark.createDataFrame(runs, "test_id string, run_id long, passed boolean, duration_ms double, t string").withColumn("executed_at", F.to_timestamp("t"))
        assert history.summary(table, "2024-01-31 00:00:00").select(history.reliability().alias("v")).first()["v"] == want


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "d"), ("e", "f")], "caller string, callee string")
    found = graph.closure(edges, spark.createDataFrame([("a", "a")], "source string, node string"))
    assert {(r["node"], r["depth"]) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r["node"]: r["level"] for r in graph.levels(edges).collect()} == {"c": 0, "f": 0, "e": 1, "a": None, "b": None, "d": None}


def test_deep_chain_and_stop(spark):
    chain = ["test", *(f"m{i}" for i in range(6)), "target"]
    edges = spark.createDataFrame([*zip(chain[:-1], chain[1:], strict=True), ("outer", "test")], "caller string, callee string")
    tests = spark.createDataFrame([("test",), ("outer",)], "test_id string")
    found = graph.tests_exercising(edges, spark.createDataFrame([("target",)], "method_id string"), tests).collect()
    assert [(r["test_id"], r["depth"], r["confidence"]) for r in found] == [("test", 7, 0.4)]


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "caller string, callee string")
    assert graph.statistics(edges).count() == 1 and graph.levels(edges).count() == 0


def test_jaccard_and_metadata(spark):
    cover = spark.createDataFrame([("a", m) for m in ("1", "2", "3")] + [("b", m) for m in ("2", "3", "4", "5")], "test_id string, method_id string")
    assert similarity.overlaps(cover).first()["jaccard"] == pytest.approx(0.4)
    for a, b, want in ((100, 100, 1), (100, 110, 0.953), (100, 200, 0.707), (100, 1000, 0.316), (0, 0, 1), (0, 100, 0)):
        assert value(spark, similarity.time_similarity(F.lit(float(a)), F.lit(float(b)))) == pytest.approx(want, abs=1e-3)
    for a, b, want in (("Unit", "Unit", 1.0), ("Unit", "Integration", 0.3), ("Integration", "EndToEnd", 0.4), ("Database", "Integration", 0.5), ("Unit", "EndToEnd", 0.0)):
        assert value(spark, similarity.category_similarity(F.lit(a), F.lit(b))) == want


def test_linkage(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.3), ("d", "e", 0.7)], "i string, j string, jaccard double")
    assert {r["test_id"]: r["cluster"] for r in similarity.single_linkage(pairs).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert {r["test_id"]: r["cluster"] for r in similarity.linkage(pairs).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d"}


def test_paths(spark):
    pairs = spark.createDataFrame([(1, 2, list("abcd"), list("abxd"))], "i int, j int, a array<string>, b array<string>")
    r = similarity.path_similarity(pairs).first()
    assert (r["lcs"], r["edit"], r["prefix"]) == (0.75, 0.75, 2)


def test_change_coverage(spark):
    made = spark.createDataFrame([(1, ["MethodOne", "MethodTwo"])], "change_id int, changed_methods array<string>")
    cover = spark.createDataFrame([("t", "MethodOne", 1, 0.8)], "test_id string, method_id string, depth int, confidence double")
    r = coverage.change_coverage(made, cover).first()
    assert (r["changed"], r["covered"], r["percentage"]) == (2, 1, 50.0)
    assert [tuple(x) for x in coverage.recommendations(made, cover).collect()] == [(1, "High", "MissingTests", 1)]


def test_baseline_impact(spark):
    table = spark.createDataFrame([(k,) for k in scoring.BASELINE], "category string").select("category", *(F.lit(None).cast(t).alias(n) for n, t in (("runs", "long"), ("failures", "long"), ("last_passed", "boolean"), ("last_age", "double"))))
    assert {r["category"]: r["v"] for r in table.select("category", scoring.baseline_impact().alias("v")).collect()} == scoring.BASELINE


def test_direct_dependency_scores_high(spark):
    tests = spark.createDataFrame([("t", "MyTest", "Unit", "x.cs", ["MyNamespace.MyClass.MyMethod"], False)], "test_id string, name string, category string, file_path string, dependencies array<string>, historical_success boolean")
    made = spark.createDataFrame([("f.cs", "Modified", ["MyNamespace.MyClass.MyMethod"], ["MyNamespace.Other"])], "file_path string, change_type string, changed_methods array<string>, changed_types array<string>")
    assert scoring.change_impact(tests, made).first()["impact"] > 0.8


def test_conflicts(spark):
    deps = spark.createDataFrame([("a", "r", "Write", "e1"), ("b", "r", "Read", "e2"), ("c", "s", "Read", "e2"), ("d", "s", "Read", "e3")], "test_id string, resource_id string, access string, entity string")
    found = {(r["i"], r["j"]): (r["kind"], r["severity"], r["blocking"]) for r in conflict.conflicts(deps).collect()}
    assert found == {("a", "b"): ("SharedData", "High", True), ("b", "c"): ("ResourceContention", "Medium", False), ("c", "d"): ("PotentialRaceCondition", "Low", False)}


def test_names(spark):
    for pattern, method, want in (("Add", "Shop.Cart.Add(int)", True), ("Cart.Add(int)", "Shop.Cart.Add(System.int)", True), ("Cart.Add(int,int)", "Shop.Cart.Add(int)", False), ("Box.Add", "Shop.Cart.Add(int)", False)):
        assert value(spark, names.pattern_matches(F.lit(method), F.lit(pattern))) is want
    assert sorted(value(spark, names.tokens(F.lit("Test_UserLogin-fast")))) == ["fast", "login", "test", "user", "userlogin"]
    assert [value(spark, names.seconds(F.lit(x))) for x in ("30s", "5m", "1h", "7")] == [30, 300, 3600, 7]
    assert value(spark, names.grams(F.array(*map(F.lit, "abcd")))) == ["a->b->c", "b->c->d"]
    assert value(spark, classify.access_type(F.lit("InsertRow"))) == "Create" and value(spark, classify.change_type(F.lit("a.json"))) == "Configuration"


def test_diff(spark):
    text = "diff --git a/TestFile.cs b/TestFile.cs\n--- a/TestFile.cs\n+++ b/TestFile.cs\n@@ -10,7 +10,7 @@ namespace TestProject\n+    public void TestMethod()\n+    {\n-        var result = OldMethod();\n+        var result = NewMethod();\n+    }\n"
    r = diff.changes(spark.createDataFrame([(1, text), (2, ""), (3, None)], "diff_id int, text string")).collect()
    assert len(r) == 1 and r[0]["file_path"] == "TestFile.cs" and r[0]["change_type"] == "Modified" and "TestMethod" in r[0]["changed_methods"]


def test_snapshots(spark):
    old, new = (spark.createDataFrame(x, "path string, sha256 string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]))
    assert {tuple(r) for r in changes.difference(old, new).collect()} == {("b", "Modified"), ("c", "Deleted"), ("d", "Added")}


def test_greedy_passes_over_what_does_not_fit(spark):
    table = spark.createDataFrame([("p", "a", 0.9, 60.0), ("p", "b", 0.8, 50.0), ("p", "c", 0.7, 40.0), ("p", "d", 0.1, 1.0)], "plan string, test_id string, score double, avg_ms double")
    chosen = scoring.select(table, "plan", "Medium", budget_ms=100.0)
    assert [r["test_id"] for r in chosen.orderBy("place").collect()] == ["a", "c"]
    assert {r["test_id"]: r["batch"] for r in scoring.batches(chosen, "plan", parallel=1).collect()} == {"a": 1, "c": 2}


def test_stream_appends_runs(spark, tmp_path):
    from impactlens.streaming.runs import append_runs, runs_stream

    rows = spark.createDataFrame([(1, "t", True), (1, "t", True), (2, "t", False)], "run_id long, test_id string, passed boolean").withColumn("executed_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    rows.write.parquet(str(tmp_path / "in"))
    append_runs(runs_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
