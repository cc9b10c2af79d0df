"""Plans whose cost must follow the input: what is shuffled, broadcast or left to one task."""

from pyspark.sql import functions as F

from impactlens import api
from impactlens.commands import Workspace
from impactlens.operators import code
from impactlens.plans import code_queries
from impactlens.sources.adapter import Tables

FILES = [("a.cs", "namespace A;\nclass C : B\n{\n  // void No() { }\n  [Test]\n  public void M(int x)\n  {\n    N(x);\n  }\n  void N(int x) { }\n}\nclass B { }\nvoid Free() { }\n"), ("b.cs", None), ("c.cs", "")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_is_read_within_its_row(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    for made in (code.code_lines(files), code.declared(files), code.calls(files), code.marked(files)):
        assert "Exchange" not in plan(made) and "Window" not in plan(made)
    rows = [(r.path, r.line, r.namespace, r.type, r.method, r.declares_method) for r in code.code_lines(files).where("line > 3 or path != 'a.cs'").collect()]
    assert rows[:2] + rows[4:6] == [("a.cs", 4, "A", "C", None, False), ("a.cs", 5, "A", "C", None, False), ("a.cs", 8, "A", "C", "M", False), ("a.cs", 9, "A", "C", "M", False)]
    assert rows[-4:] == [("a.cs", 13, "A", "B", "Free", True), ("a.cs", 14, "A", "B", "Free", False), ("b.cs", 1, "", None, None, False), ("c.cs", 1, "", None, None, False)]
    assert [(r.method, [a.name for a in r.attributes]) for r in code.marked(files).where("method is not null").orderBy("method").collect()] == [("Free", []), ("M", ["TestAttribute"]), ("N", [])]


def test_code_is_not_broadcast(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    for made in (code.resolved(code.calls(files), code.declared(files)), code.call_graph(files), code.overrides(files), code.type_usage(files), code.discovery_results(files)):
        assert "Broadcast" not in plan(made)


def test_keys_of_files_are_dealt_out(spark, sf_dir):
    assert code_queries.files(Tables(spark, sf_dir)).rdd.getNumPartitions() >= 4


def test_statistics_count_every_callee(spark):
    n = 60
    edges = spark.range(n).select(F.lit("T").alias("caller"), F.concat(F.lit("M"), "id").alias("callee"))
    ids = edges.select(F.col("callee").alias("method_id")).unionByName(spark.createDataFrame([("T",)], "method_id string"))
    methods = ids.select("method_id", F.col("method_id").alias("name"), F.lit("K").alias("containing_type"), F.lit("/src/k.cs").alias("file_path"), (F.col("method_id") == "T").alias("is_test"))
    tests = spark.createDataFrame([("T", "T")], "test_id string, name string")
    found = api.answer(Workspace(methods, edges, tests), "POST", "/api/testcoverage/statistics").first()
    assert (found.methods, found.covered, found.relationships, found.percentage) == (n, n, n, 100.0)
    assert Workspace(methods, edges, tests).trace_execution().count() == 50
