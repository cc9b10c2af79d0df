"""Queries over all rows, and operators that SQL can't express, against plain versions."""

import io
import json
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from impactlens import api
from impactlens.commands import Workspace
from impactlens.functions import diff
from impactlens.operators import artefacts, code, containment, databases, graph, lookups, scoring, similarity
from impactlens.plans import catalog as queries
from impactlens.sources.adapter import AS_OF, Tables
from impactlens.sources.cut import Pieces, cut


def test_divergences_of_all_orders(spark, sf_dir):
    t = Tables(spark, sf_dir)
    keys = {r["test_id"] for r in t.traces().select("test_id").distinct().collect()}
    assert keys == {f"O{r['l_orderkey']}" for r in t.raw("lineitem").select("l_orderkey").distinct().collect()}


def test_paths_of_all_orders_are_compared(spark, sf_dir):
    keys = {r["l_orderkey"] for r in Tables(spark, sf_dir).raw("lineitem").select("l_orderkey").distinct().collect()}
    found = queries.QUERIES["j9_path_similarity"](spark, sf_dir).select("i", "j").collect()
    assert sorted(map(tuple, found)) == sorted((k, k + 500) for k in keys if k + 500 in keys)


def test_long_changed_line(spark):
    text = "diff --git a/a.cs b/a.cs\n+++ b/a.cs\n+" + ";" * 1_000_010 + " void FarOff() {\n"
    assert diff.changes(spark.createDataFrame([(1, text)], "diff_id int, text string")).first()["changed_methods"] == ["FarOff"]


def test_both_rules_for_method_names(spark):
    text = "diff --git a/a.cs b/a.cs\n+++ b/a.cs\n+    Task<int> Typed<T>(int a) where T : new()\n+    Called(1);\n-  x = Inner(2) + 1;\n+  if (y) {\n+  return Back(3) + 1;\n"
    found = diff.changes(spark.createDataFrame([(1, text)], "diff_id int, text string")).first()["changed_methods"]
    assert found == ["Back", "Called", "Typed"]


def plain_linkage(values, threshold, kind):
    """Merging the best pair, one after the other."""
    groups = [[x] for x in sorted({x for p in values for x in p})]

    def tie(a, b):
        found = [values.get((min(x, y), max(x, y)), 0.0) for x in a for y in b]
        return min(found) if kind == "complete" else sum(found) / len(found)

    while len(groups) > 1:
        best, a, b = max((tie(groups[a], groups[b]), -a, -b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        if best < threshold:
            break
        groups[-a] = sorted(groups[-a] + groups.pop(-b))
    return {x: g[0] for g in groups for x in g}


@pytest.mark.parametrize("kind", ["complete", "average"])
def test_linkage(spark, kind):
    rng = random.Random(3)
    values = {(f"t{a:02}", f"t{b:02}"): rng.random() for a in range(24) for b in range(a + 1, 24) if rng.random() < 0.7}
    frame = spark.createDataFrame([(a, b, v) for (a, b), v in values.items()], "i string, j string, jaccard double")
    got = {r["test_id"]: r["cluster"] for r in similarity.linkage(frame, 0.4, kind).collect()}
    assert got == plain_linkage(values, 0.4, kind)


def test_clusters_by_option(spark):
    frame = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("d", "e", 0.7)], "i string, j string, jaccard double")
    for algorithm in similarity.ALGORITHMS:
        assert {r["test_id"]: r["cluster"] for r in similarity.clusters(frame, 0.6, algorithm).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert {r["cluster"] for r in similarity.clusters(frame, 0.6, linked="complete").collect()} == {"a", "c", "d"}
    with pytest.raises(ValueError, match="algorithm"):
        similarity.clusters(frame, 0.6, "Other")


def test_components_of_chains(spark):
    links = [(f"n{i:04}", f"n{i + 1:04}") for i in range(300) if i % 100 != 99] + [("x", "x")]
    got = {r["test_id"]: r["cluster"] for r in similarity.single_linkage(spark.createDataFrame([(a, b, 1.0) for a, b in links], "i string, j string, jaccard double")).collect()}
    assert got == {f"n{i:04}": f"n{i // 100 * 100:04}" for i in range(300)}


def test_path_scores(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abc") for _ in range(rng.randrange(9))]) for i in range(60)]

    def lcs(a, b):
        if not a or not b:
            return 0
        return lcs(a[1:], b[1:]) + 1 if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))

    def edit(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(edit(a[1:], b) + 1, edit(a, b[1:]) + 1, edit(a[1:], b[1:]) + (a[0] != b[0]))

    found = similarity.path_similarity(spark.createDataFrame(rows, "i int, a array<string>, b array<string>")).collect()
    for r in found:
        most = max(len(r["a"]), len(r["b"]))
        want = (lcs(r["a"], r["b"]) / most, 1 - edit(r["a"], r["b"]) / most) if most else (1, 1)
        assert abs(r["lcs"] - want[0]) < 1e-9 and abs(r["edit"] - want[1]) < 1e-9


@pytest.mark.parametrize("few", [1000, 2])
def test_containment(spark, few):
    rng = random.Random(5)
    given = ["", "a", "ab", "abc", "bcab", "zz", "é", "cabcab"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(20)]
    values = ["", "abcab", "xxab", "é!", "cabcabc"] + ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    got = containment.containing(spark.createDataFrame([(g,) for g in given], "given string"), spark.createDataFrame([(v,) for v in set(values)], "value string"), few)
    assert sorted(map(tuple, got.select("given", "value").collect())) == sorted((g, v) for g in set(given) if g for v in set(values) if g in v)


def test_long_chains_are_closed_in_few_pieces(spark):
    edges = cut(spark.range(40).select(F.col("id").cast("string").alias("caller"), (F.col("id") + 1).cast("string").alias("callee")))
    began = time.time()
    found = graph.closure(edges, spark.createDataFrame([("0", "0")], "source string, node string"))
    assert {(r["node"], r["depth"]) for r in found.collect()} == {(str(i), i) for i in range(41)}
    assert found.rdd.getNumPartitions() <= 24 and time.time() - began < 60


def test_pieces(spark):
    own = Pieces(spark.range(0, 1))
    for k in range(1, 20):
        own.add(cut(spark.range(k, k + 1)))
    assert len(own.held) <= 6 and sorted(r["id"] for r in own.whole().collect()) == list(range(20))


def test_changed_names_without_regard_to_case(spark):
    methods = spark.createDataFrame([("Shop.Repo.LoadAll",), ("shop.x",)], "method_id string")
    found = lookups.changed_methods(methods, spark.createDataFrame([("LOAD",), ("load",), ("",), ("none",)], "given string")).collect()
    assert sorted(map(tuple, found)) == [("LOAD", "Shop.Repo.LoadAll"), ("load", "Shop.Repo.LoadAll")]


def test_estimated_saving(spark):
    texts = [None, "", "short", "a" * 500, "".join(random.Random(1).choice("abcdefgh") for _ in range(30_000))]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(artefacts.estimated_saving(F.col("t"))).collect()]
    save = lambda s: 1 - len(zlib.compress(s.encode(), 6)) / len(s.encode())
    long = texts[4]
    want = [0.0, 0.0, save("short"), save("a" * 500), (save(long[:1024]) + save(long[15_000:16_024]) + save(long[-1024:])) / 3]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))


def test_scorers_can_be_replaced(spark, sf_dir):
    t = Tables(spark, sf_dir)
    own = scoring.Scorers().add("one", 2.0, lambda level: F.lit(3.0)).add("none", 2.0, lambda level: F.lit(None).cast("double"))
    assert {r["score"] for r in scoring.scored(t.tests(), t.runs(), AS_OF, scorers=own).select("score").collect()} == {0.5}


SOURCE = """namespace A.B;
[Ignore]
public class Plain { }
public abstract class Base
{
  public abstract void Run(int a);
}
public class Derived<T> : Base, IList<T> where T : new()
{
  public Derived() { }
  public override void Run(int a) { Helper.Do(a); }  // Helper.Not();
  [Fact] public void Quick() { Run(1); if (x) { return; } }
  [Theory, InlineData(1)]
  public async Task Slow(int n)
  {
    await Other.Wait(n);
    var y = nameof(Run) + typeof(T);
    Handler = items[0].Name;
  }
}"""


def test_source_text(spark):
    files = spark.createDataFrame([("a.cs", SOURCE), ("b.cs", None), ("c.cs", ""), ("d.cs", "no code ("), ("e.cs", "class")], "path string, content string")
    found = {r["method_id"]: r for r in code.declared(files).collect()}
    assert set(found) == {"A.B.Base.Run", "A.B.Derived.Derived", "A.B.Derived.Run", "A.B.Derived.Quick", "A.B.Derived.Slow"}
    assert found["A.B.Base.Run"]["virtual"] and found["A.B.Derived.Run"]["virtual"] and not found["A.B.Derived.Slow"]["virtual"]
    calls = {(r["caller"], r["expression"]) for r in code.calls(files).collect()}
    assert ("A.B.Derived.Slow", "Other.Wait") in calls and not any("Not" in e or e in ("nameof", "typeof", "if") for _, e in calls)
    assert {(r["base"], r["impl"]) for r in code.overrides(files).collect()} == {("A.B.Base.Run", "A.B.Derived.Run")}
    assert {r["path"]: (r["tests"], r["error"]) for r in code.discovery_results(files).collect()} == {"a.cs": (1, None), "b.cs": (0, "no content"), "c.cs": (0, None), "d.cs": (0, None), "e.cs": (0, None)}


def test_detectors_on_odd_sources(spark):
    rows = [("a", None), ("b", ""), ("c", "new AContext(); db.Xs.Remove(x); db.Xs.Where(y);"), ("c", "new AContext(); db.Xs.Remove(x); db.Xs.Where(y);"), ("d", 'o.UseSqlite("Data Source=:memory:")')]
    found = databases.Detectors().detect(spark.createDataFrame(rows, "test_id string, source string")).collect()
    assert {(r["test_id"], r["resource_id"], r["access"], r["entity"]) for r in found} == {("c", "EFCore:AContext", "Delete", "Xs"), ("c", "EFCore:AContext", "Read", "Xs"), ("d", "EFCore:InMemory::memory:", "ReadWrite", None)}
    assert len(found) == 3 and databases.Detectors({}).detect(spark.createDataFrame(rows, "test_id string, source string")).count() == 0


def test_service(spark, sf_dir):
    t = Tables(spark, sf_dir)
    app = api.application(Workspace(t.methods(), t.edges(), t.tests(), t.runs(), as_of=AS_OF))

    def ask(method, path, body=None, query=""):
        raw, said = json.dumps(body or {}).encode(), []
        environ = {"REQUEST_METHOD": method, "PATH_INFO": path, "CONTENT_LENGTH": str(len(raw)), "wsgi.input": io.BytesIO(raw), "QUERY_STRING": query}
        lines = list(app(environ, lambda status, headers: said.append(status)))
        return said[0][:3], [json.loads(x) for x in lines]

    assert ask("GET", "/api/testdiscovery/health") == ("200", [{"status": "Healthy"}])
    assert ask("GET", "/api/none")[0] == "404" and ask("POST", "/api/testdiscovery/health")[0] == "404"
    assert ask("POST", "/api/testselection/execution-results", {"results": [{"test_id": "a", "passed": True}, {"test_id": "b", "passed": False}]})[1] == [{"results": 2, "passed": 1}]
    assert ask("POST", "/api/testselection/execution-results", {"results": [{}]})[0] == "400"
    assert len(ask("GET", "/api/testselection/history", query="filter=000001")[1]) >= 1
    assert len(api.ROUTES) == 17
