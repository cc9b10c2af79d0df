"""Small and odd cases for projects, symbols, look-ups, paths, plans, stored results, sinks, streams and commands."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from impactlens.commands import Workspace
from impactlens.functions import attributes, classify, names, seeding
from impactlens.operators import artefacts, conflict, lookups, paths, scoring, similarity, symbols
from impactlens.sources import projects, sinks
from impactlens.streaming import files as file_stream


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_paths_are_resolved(spark):
    for given, want in (("/a/b/../c.cs", "/a/c.cs"), ("a\\.\\b", "a/b"), ("/../x", "/x"), ("", "")):
        assert value(spark, projects.resolved(F.lit(given))) == want


def test_odd_project_files(spark):
    files = table(spark, "path string, content string", ("/a/x.csproj", None), ("/b/x.csproj", "<Project"), ("/c/x.csproj", "<TargetFrameworks>;net6.0;net8.0</TargetFrameworks><Reference Include='A'/>"))
    found = {r["path"]: r for r in projects.project_details(files).collect()}
    assert found["/a/x.csproj"]["target_framework"] == found["/b/x.csproj"]["target_framework"] == "net8.0"
    assert found["/c/x.csproj"]["target_framework"] == "net6.0" and found["/c/x.csproj"]["assembly_refs"] == ["A"] and found["/c/x.csproj"]["packages"] == []


def test_solution_lines(spark):
    text = 'Project("{A}") = "One", "one\\one.csproj", "{00000000-0000-0000-0000-000000000001}"\nProject("{A}") = "Bad", "bad.csproj", "{1}"\nProject("{A}") = "Folder", "f", "{00000000-0000-0000-0000-000000000002}"'
    found = projects.solution_projects(table(spark, "path string, content string", ("/s/all.sln", text), ("/s/none.sln", None))).collect()
    assert [(r["name"], r["path"]) for r in found] == [("One", "/s/one/one.csproj")]


def test_config_and_files(spark, tmp_path):
    rules = projects.Config.parse('{"Projects": {"Include": ["*Tests*"], "ExcludeTypes": ["orm"], "TestProjectsOnly": true}}')
    assert rules == projects.Config(["*Tests*"], [], ["orm"], True) and projects.Config.parse("{}") == projects.Config()
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.csproj").write_text("<Project>\n</Project>")
    (tmp_path / "b.txt").write_text("x")
    rows = projects.read_files(spark, str(tmp_path), "*.csproj").collect()
    assert len(rows) == 1 and rows[0]["path"].endswith("/sub/a.csproj") and rows[0]["content"] == "<Project>\n</Project>"


def test_framework_and_assemblies(spark):
    assert value(spark, projects.framework_version(F.lit(None).cast("string"), F.lit(" "), F.lit("net8.0"))) == "net8.0"
    assert value(spark, projects.framework_version(F.lit(""))) == "Unknown"
    assert value(spark, projects.is_test_assembly(F.lit("NUnit.Core"))) and not value(spark, projects.is_test_assembly(F.lit(None).cast("string")))


def test_attributes(spark):
    pairs = F.array(F.struct(F.lit("CategoryAttribute").alias("name"), F.lit("Slow").alias("value")), F.struct(F.lit("TestCaseAttribute").alias("name"), F.lit("1, 2").alias("value")), F.struct(F.lit("CategoryAttribute").alias("name"), F.lit("").alias("value")))
    assert value(spark, attributes.values_of(pairs, "category")) == ["Slow"] and value(spark, attributes.values_of(pairs, "case")) == ["1, 2"]
    none = F.array().cast("array<string>")
    assert not value(spark, attributes.is_test_method(none))
    assert value(spark, attributes.is_fixture(none, F.array(F.array(F.lit("FactAttribute")), none)))
    assert value(spark, attributes.marks(F.lit("setupattribute"), "setup"))


def test_names_and_kinds(spark):
    assert [value(spark, names.container(F.lit(x))) for x in ("a.b.c.d", "a.b", "a")] == ["a.b", "a", None]
    assert value(spark, names.approximate_id(F.lit(None).cast("string"), F.lit("C"), F.lit("m"), F.lit(2))) == "C.m.(2 params)"
    assert [value(spark, classify.change_type(F.lit(x))) for x in ("/config/a.cs", "/a/app.config", "b.JSON", "c.cs")] == ["Modified", "Configuration", "Configuration", "Modified"]
    assert value(spark, classify.call_type(F.lit(False), F.lit(True), F.lit(True), F.lit(False))) == "Static"
    assert value(spark, classify.looks_like_test(F.array(F.lit("NUnit.Test")), F.lit("x"), F.lit("y"))) and value(spark, classify.looks_like_test(F.array().cast("array<string>"), F.lit("x"), F.lit("ATests")))
    assert value(spark, seeding.in_memory(F.lit(None).cast("string"))) == []


def test_symbols_of_nothing(spark):
    empty = table(spark, "path string, content string")
    assert symbols.index(empty).count() == 0 and symbols.index(table(spark, "path string, content string", ("a", None), ("b", ""))).count() == 0
    ix = symbols.index(table(spark, "path string, content string", ("a", "class A { public void Run() { } }\nclass A {}"), ("b", "class AB { public int Run2(int x) => 1; }")))
    assert sorted((r["given"], r["path"]) for r in symbols.files_with_method(ix, table(spark, "given string", ("X.Run",), ("Run",), ("Run",))).collect()) == [("Run", "a"), ("X.Run", "a"), ("X.Run", "b")]
    owners = table(spark, "path string, project string", ("a", "p"), ("b", "p"))
    assert symbols.projects_with_method(ix, table(spark, "given string", ("X.Run",)), owners).collect()[0]["project"] == "p"


def test_lookups(spark):
    tests = table(spark, "test_id string, test_name string", ("N.A.Run", "Run"), ("N.B.Go", None), ("Solo", "Solo"))
    found = lambda *g: sorted(r["test_id"] for r in lookups.provided(tests, table(spark, "given string", *((x,) for x in g))).collect())
    assert found("b.go") == ["N.B.Go"] and found("un") == [] and found("run", "Solo", "solo") == ["N.A.Run", "Solo"]
    near = lookups.suggestions(table(spark, "given string", ("Sola",), ("",)), tests).collect()
    assert [(r["given"], r["test_id"], r["distance"]) for r in near] == [("Sola", "Solo", 1)]
    assert {r["given"]: r["valid"] for r in lookups.validated(table(spark, "given string", ("SOLO",), ("x",)), tests).collect()} == {"SOLO": True, "x": False}


def test_call_path_order(spark):
    """Of two paths of equal length the one through the caller's own type counts, although its id is greater."""
    edges = table(spark, "caller string, callee string", ("t", "b"), ("t", "a"), ("a", "x"), ("b", "x"), ("x", "t"))
    methods = table(spark, "method_id string, containing_type string", ("t", "T"), ("b", "T"), ("a", "A"), ("x", "X"))
    found = paths.call_paths(edges, methods, table(spark, "test_id string, target string", ("t", "x"), ("t", "t"), ("t", "none"))).collect()
    assert {(r["target"], tuple(r["path"]), r["depth"]) for r in found} == {("x", ("t", "b", "x"), 2), ("t", ("t",), 0)}
    assert paths.call_paths(edges, methods, table(spark, "test_id string, target string", ("t", "x")), 2).count() == 0


def brute_divergences(a, b, most=50):
    out, prefix = [], next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x[0] != y[0]), min(len(a), len(b)))
    if prefix < min(len(a), len(b)):
        out.append(("sequential", a[prefix][0], prefix))
    jumps = lambda c: [(c[k][0], c[k][1] - c[k - 1][1], k) for k in range(1, len(c)) if abs(c[k][1] - c[k - 1][1]) > 1]
    for m, d, k in jumps(a):
        other = next((x for x in jumps(b) if x[0] == m), None)
        if other and other[1] != d:
            out.append(("conditional", m, k))
    return out[:most]


def test_divergences(spark):
    calls = {"i": [("a", 1), ("b", 4), ("c", 1), ("b", 3)], "j": [("a", 1), ("c", 1), ("b", 6)], "k": [("a", 1)], "l": [("a", 1), ("b", 4)]}
    trace = table(spark, "test_id string, seq int, method_id string, call_depth int", *((t, n, m, d) for t, c in calls.items() for n, (m, d) in enumerate(c)))
    pairs = list(itertools.product(calls, calls))
    found = paths.divergences(table(spark, "i string, j string", *pairs), trace).collect()
    got = {p: sorted((r["kind"], r["method"], r["position"]) for r in found if (r["i"], r["j"]) == p) for p in pairs}
    assert got == {(i, j): sorted(brute_divergences(calls[i], calls[j])) for i, j in pairs}


def test_edges_of_equal_depth(spark):
    trace = table(spark, "test_id string, seq int, method_id string, call_depth int, call_path array<string>", ("t", 1, "a", 1, ["a"]), ("t", 2, "b", 1, ["a", "b"]), ("t", 3, "c", 1, ["c"]))
    assert [(r["caller"], r["callee"]) for r in paths.execution_edges(trace).collect()] == [("a", "b")]
    same = paths.graph_similarity(table(spark, "i string, j string", ("t", "t")), trace).first()
    assert same["structural"] == pytest.approx(1) and same["cosine"] == pytest.approx(1)


def test_batches_keep_apart(spark):
    rows = [("p", "a", "Unit", 0.9, 10.0), ("p", "b", "Database", 0.8, 50.0), ("p", "c", "Unit", 0.7, 20.0), ("p", "d", "Unit", 0.6, 290_000.0), ("p", "e", "Unit", 0.5, 20_000.0)]
    made = scoring.batches(table(spark, "plan string, test_id string, category string, score double, avg_ms double", *rows), "plan", 4)
    assert {r["test_id"]: r["batch"] for r in made.collect()} == {"a": 1, "c": 1, "d": 1, "e": 2, "b": 2}
    assert scoring.plan_time(made, "plan").first()["ms"] == 310_000.0
    needs = [{"kind": "Unit", "avg_ms": 1.0, "dependencies": d} for d in (["x"], ["x", "y"], ["z"], None)]
    assert [len(g) for g in scoring.compatible_groups(needs)] == [3, 1]


def test_fast_selection(spark):
    rows = [("p", f"u{k}", "Unit", 0.95 - k / 100, 10.0) for k in range(9)] + [("p", "i1", "Integration", 0.7, 10.0), ("p", "i2", "Integration", 0.65, 10.0), ("p", "x", "API", 0.99, 10.0)]
    found = scoring.select_fast(table(spark, "plan string, test_id string, category string, score double, avg_ms double", *rows), "plan", 1000.0, 5).collect()
    assert [r["test_id"] for r in sorted(found, key=lambda r: r["place"])] == ["u0", "u1", "u2", "u3", "i1"]
    short = scoring.select_fast(table(spark, "plan string, test_id string, category string, score double, avg_ms double", *rows), "plan", 25.0, 5).collect()
    assert [r["test_id"] for r in short] == ["u0", "u1"]


def test_silhouette(spark):
    clusters = table(spark, "test_id string, cluster string", ("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"), ("e", "3"))
    pairs = table(spark, "i string, j string, jaccard double", ("a", "b", 0.8), ("a", "c", 0.4), ("c", "d", 0.6))
    found = {r["test_id"]: r["silhouette"] for r in similarity.silhouettes(clusters, pairs).collect()}
    assert found == pytest.approx({"a": 0.75, "b": 1.0, "c": 2 / 3, "d": 1.0})
    one = similarity.cluster_statistics(clusters, pairs, table(spark, "test_id string", ("a",), ("z",))).first()
    assert (one["clusters"], one["clustered"], one["unclustered"], one["quality"]) == (3, 5, 1, "excellent")
    assert similarity.silhouettes(clusters.where("cluster = '1'"), pairs).count() == 0


def test_weights_and_profile(spark):
    assert similarity.method_weights(table(spark, "method_id string", ("System.A.get_X",))).first()["weight"] == pytest.approx(0.18)
    prof = similarity.cluster_profile(table(spark, "test_id string, cluster string", ("a.b.FooTests.x", "1"), ("a.c.FooTests.y", "1"), ("solo", "2"))).collect()
    assert {r["cluster"]: (r["namespaces"], r["name"], r["pattern"]) for r in prof} == {"1": (["a.b", "a.c"], "TestCluster_1", "Foos"), "2": ([], "TestCluster_2", "Unknown")}
    assert similarity.consolidations(table(spark, "cluster string, size long, cohesion double", ("1", 5, 0.8), ("2", 11, 0.9), ("3", 4, 1.0))).count() == 2


def test_exclusive(spark):
    deps = table(spark, "test_id string, resource_id string, access string", ("a", "InMemory:x", "Write"), ("b", "db", "Delete"), ("c", "db", "Read"), ("c", None, "Write"))
    assert {r["test_id"]: r["exclusive"] for r in conflict.exclusive(deps).collect()} == {"a": False, "b": True, "c": False}


def test_store(spark, tmp_path):
    store = artefacts.Store(spark, str(tmp_path / "kv"))
    rows = lambda *r: table(spark, "key string, value string, created string, expires string", *r)
    store.put(rows(("a", "1", "2024-01-01", None), ("b", "1", "2024-01-01", "2024-01-05")))
    store.put(rows(("a", "2", "2024-01-02", None), ("c", "1", "2024-02-01", None)))
    assert {tuple(r) for r in store.get("2024-01-10").collect()} == {("a", "2")}
    assert {tuple(r) for r in store.get("2024-01-03", table(spark, "key string", ("b",))).collect()} == {("b", "1")}


def test_reports_of_nothing(spark):
    empty = table(spark, "owner string, path string, bytes long, created timestamp, accessed timestamp, expires timestamp")
    one = artefacts.storage_statistics(empty, "2024-01-01", 10).first()
    assert (one["files"], one["bytes"], one["cleanup_due"]) == (0, 0, False)
    assert artefacts.activity(empty, "2024-01-01").first()["bytes"] == 0
    assert artefacts.ratios(table(spark, "hits long, misses long, packed long, plain long")).first()["saving"] == 0
    assert scoring.change_summary(table(spark, "file_path string, changed_methods array<string>, changed_types array<string>")).first()["impact"] == 0


def test_sinks(spark, tmp_path):
    df = table(spark, "a int, b array<string>", (1, ["x"]), (2, None))
    sinks.write(df, str(tmp_path / "j"), "json", compressed=True)
    assert sorted(r["a"] for r in spark.read.json(str(tmp_path / "j")).collect()) == [1, 2] and list((tmp_path / "j").glob("*.gz"))
    sinks.write(df, str(tmp_path / "t"), "text")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a: 1, b: [x]", "a: 2"]
    assert [json.loads(r["value"]) for r in sinks.as_json(df.where("a = 1")).collect()] == [{"a": 1, "b": ["x"]}]
    assert [value(spark, sinks.bytes_text(F.lit(n))) for n in (0, 1023, 1536, 1024**2, 5 * 1024**5)] == ["0 B", "1023 B", "1.5 KB", "1 MB", "5120 TB"]
    assert sinks.comparison(table(spark, "i string, j string, overall double, other int", ("a", "b", 0.5, 1)), "Summary").columns == ["i", "j", "overall"]


def test_file_events(spark, tmp_path):
    events = tmp_path / "events"
    table(spark, "path string, changed_at timestamp", ("A.cs", None), ("a.cs", None)).write.parquet(str(events))
    stream = spark.readStream.schema("path string, changed_at timestamp").parquet(str(events))
    keys = lambda: table(spark, "cache_key string, files array<string>", ("k1", ["a.cs"]), ("k2", ["b.cs"]))
    file_stream.invalidate(stream, keys, str(tmp_path / "stale"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r["cache_key"] for r in spark.read.parquet(str(tmp_path / "stale")).collect()] == ["k1"]


def test_commands(spark):
    methods = table(spark, "method_id string, name string, containing_type string, file_path string, is_test boolean", ("T.Run", "Run", "T", "/tests/T.cs", True), ("A.Load(int)", "Load", "A", "/src/A.cs", False), ("A.Save", "Save", "A", "/src/A.cs", False))
    edges = table(spark, "caller string, callee string", ("T.Run", "A.Load(int)"), ("A.Load(int)", "A.Save"))
    tests = table(spark, "test_id string, name string, category string, avg_ms double, tags array<string>", ("T.Run", "Run", "Unit", 10.0, []))
    own = Workspace(methods, edges, tests)
    assert [(r["target"], r["test_id"], r["depth"]) for r in own.find_tests("A.Save", "Load").orderBy("depth").collect()] == [("A.Load(int)", "T.Run", 1), ("A.Save", "T.Run", 2)]
    assert {r["method_id"]: r["depth"] for r in own.trace_execution().collect()} == {"A.Load(int)": 1, "A.Save": 2}
    text = table(spark, "diff_id int, text string", (1, "diff --git a/A.cs b/A.cs\n+++ b/A.cs\n+  void Save() {\n"))
    assert {r["method_id"]: r["depth"] for r in own.diff(text).collect()} == {"A.Save": 0, "A.Load(int)": 1, "T.Run": 2}
    assert own.analyze_coverage(text).first()["percentage"] == 100.0 and own.analyze_coverage(text, "none").first()["covered"] == 0
    assert own.callgraph("Save", depth=1).count() == 1 and own.callgraph().count() == 2 and own.analyze().first()["tests"] == 1
    own.runs = table(spark, "test_id string, run_id long, passed boolean, duration_ms double, executed_at timestamp")
    assert [len(own.select(k).collect()) for k in ("Fast", "Medium", "High", "Full")] == [0, 1, 1, 1]
    assert own.compare_tests("T.Run").count() == 0 and own.version()
