"""Queries on call paths and execution traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlens.functions import classify
from impactlens.operators import graph, paths
from impactlens.plans.queries import small_parts
from impactlens.plans.registry import query, rounded
from impactlens.sources.adapter import Tables, sql

CHAIN = """c AS (SELECT a.caller AS test_id, e.callee AS target, min([a.caller, a.callee, b.callee, c.callee, d.callee, e.callee]) AS path FROM edges a JOIN edges b ON b.caller = a.callee JOIN edges c ON c.caller = b.callee
JOIN edges d ON d.caller = c.callee JOIN edges e ON e.caller = d.callee WHERE a.caller LIKE 'C%' GROUP BY 1, 2)"""


def wanted(t: Tables) -> DataFrame:
    regions = t.raw("region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("target"))
    return t.tests().select("test_id").crossJoin(regions)  # five regions


@query("g4_call_paths", sql("edges") + f", {CHAIN} SELECT test_id, target, array_to_string(path, '>') AS path, 5 AS depth, 0.6::DOUBLE AS confidence FROM c")
def _(t):
    return paths.call_paths(t.edges(), t.methods(), wanted(t)).withColumn("path", F.array_join("path", ">"))


@query("p21_scoped_coverage", sql("edges") + f""", p AS (SELECT 'P' || p_partkey AS m FROM part WHERE p_size = 1), c AS (SELECT a.caller AS test_id, b.callee AS target, min(a.callee) AS via FROM edges a JOIN edges b ON b.caller = a.callee
WHERE a.caller LIKE 'C%' AND b.callee IN (SELECT m FROM p) GROUP BY 1, 2) SELECT test_id, target, via, 0.8::DOUBLE AS confidence FROM c""")
def _(t):
    near = graph.tests_exercising(t.edges(), small_parts(t), t.tests(), 2).select("test_id", "target")
    return paths.call_paths(t.edges(), t.methods(), near, 3).select("test_id", "target", F.get("path", 1).alias("via"), "confidence")


@query("g11_scoped_graph", sql("edges") + """ SELECT DISTINCT caller, callee FROM edges WHERE caller = 'S1' OR callee = 'S1' OR caller = 'C2' OR callee = 'C2'""")
def _(t):
    one = lambda column, *ids: t.spark.createDataFrame([(i,) for i in ids], f"{column} string")
    return paths.scoped_graph(t.edges(), t.methods(), one("method_id", "S1"), one("test_id", "C2"), one("file_path"), 1)


@query("g13_nodes_at_depth", sql("edges") + " SELECT DISTINCT 'S1' AS source, b.callee AS node FROM edges a JOIN edges b ON b.caller = a.callee WHERE a.caller = 'S1'")
def _(t):
    return paths.at_depth(t.edges(), t.spark.createDataFrame([("S1", "S1")], "source string, node string"), 2)


@query("t2_most_called", sql("edges") + """ (SELECT 'caller' AS side, caller AS method_id, count(*) AS n FROM edges GROUP BY caller ORDER BY n DESC, caller LIMIT 10)
UNION ALL (SELECT 'callee', callee, count(*) AS n FROM edges GROUP BY callee ORDER BY n DESC, callee LIMIT 10)""")
def _(t):
    top = lambda side: t.edges().groupBy(F.col(side).alias("method_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "method_id").limit(10).select(F.lit(side).alias("side"), "method_id", "n")
    return top("caller").unionByName(top("callee"))


@query("f28_coverage_confidence", """SELECT o_orderkey AS k, round(least(1.0::DOUBLE, CASE WHEN d <= 1 THEN 1.0 WHEN d <= 3 THEN 0.8 WHEN d <= 6 THEN 0.6 ELSE 0.4 END::DOUBLE * CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.8 END * (0.5 + 0.5 * (o_orderkey % 5) / 4.0)) * CASE WHEN d < 1 THEN 0 ELSE 1 END, 6)::DOUBLE AS confidence
FROM (SELECT *, o_orderkey % 9 AS d FROM orders)""")
def _(t):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "Unit").when(k % 3 == 1, "Security").otherwise("End2End")
    return rounded(t.raw("orders").select(k.alias("k"), paths.coverage_confidence(k % 9, kind, (k % 5) / 4.0).alias("confidence")), "confidence")


@query("b17_test_confidence", "SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM nation")
def _(t):
    pick = lambda *w: F.element_at(F.array(*(F.lit(x) for x in w)), (F.col("n_nationkey") % 4 + 1).cast("int"))
    path, name, type_ = pick("/a.Tests/RunTests.cs", "/spec/x.cs", "/src/Run.cs", "/src/Run.cs"), pick("ShouldRun", "Load", "VerifyAll", "Load"), pick("RunTests", "RunSpec", "RunTests", "Runner")
    return rounded(t.raw("nation").select(F.col("n_nationkey").alias("k"), classify.test_confidence(path, name, type_).alias("confidence")), "confidence")


# Traces

STEPS = "s AS (SELECT *, lead(method_id) OVER w AS next, lead(call_depth) OVER w AS next_depth, lag(call_depth) OVER w AS before FROM traces WINDOW w AS (PARTITION BY test_id ORDER BY seq))"


@query("j10_execution_edges", sql("traces") + f", {STEPS}, f AS (SELECT test_id, method_id, count(*) AS n FROM traces GROUP BY 1, 2) SELECT DISTINCT s.test_id, s.method_id AS caller, s.next AS callee, s.next_depth AS depth, round(ln(a.n + b.n + 1), 6) AS weight FROM s JOIN f a ON a.test_id = s.test_id AND a.method_id = s.method_id JOIN f b ON b.test_id = s.test_id AND b.method_id = s.next WHERE next_depth > call_depth")
def _(t):
    return rounded(paths.execution_edges(t.traces()), "weight")


@query("j10_execution_nodes", sql("traces") + " SELECT test_id, method_id, count(*) AS calls, min(call_depth) AS depth FROM traces GROUP BY 1, 2")
def _(t):
    return paths.execution_nodes(t.traces())


def trace_pairs(t: Tables) -> DataFrame:
    return t.raw("orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("i"), F.concat(F.lit("O"), (F.col("o_orderkey") + 20).cast("string")).alias("j"))


@query("j8_graph_similarity", sql("traces") + f""", {STEPS}, n AS (SELECT test_id, method_id, count(*) AS n, min(call_depth) AS depth FROM traces GROUP BY 1, 2),
e AS (SELECT DISTINCT test_id, method_id || '>' || next AS edge, next_depth FROM s WHERE next_depth > call_depth),
g AS (SELECT test_id, list(method_id) AS nodes, sqrt(sum(n * n)) AS norm, avg(depth) AS ad, max(depth) AS md, count(*) AS nn FROM n GROUP BY 1),
x AS (SELECT g.*, coalesce(edges, []) AS edges, coalesce(ne, 0)::DOUBLE / greatest(1, nn - 1) AS br FROM g LEFT JOIN (SELECT test_id, list(DISTINCT edge) AS edges, count(*) AS ne FROM e GROUP BY 1) USING (test_id)),
dots AS (SELECT a.test_id AS i, b.test_id AS j, sum(a.n * b.n) AS dot FROM n a JOIN n b ON a.method_id = b.method_id AND substr(b.test_id, 2)::BIGINT = substr(a.test_id, 2)::BIGINT + 20 GROUP BY 1, 2),
r AS (SELECT a.test_id AS i, b.test_id AS j, coalesce(dot, 0) / (a.norm * b.norm) AS cosine, len(list_intersect(a.nodes, b.nodes))::DOUBLE / len(list_distinct(a.nodes || b.nodes)) AS node_sim,
  CASE WHEN len(a.edges) + len(b.edges) = 0 THEN 1 ELSE len(list_intersect(a.edges, b.edges))::DOUBLE / len(list_distinct(a.edges || b.edges)) END AS edge_sim,
  CASE WHEN a.ad = 0 AND b.ad = 0 THEN 1 ELSE (1 - abs(a.ad - b.ad) / greatest(a.ad, b.ad) + 1 - abs(a.md - b.md)::DOUBLE / greatest(a.md, b.md)) / 2 END AS depth_sim,
  CASE WHEN a.br = 0 AND b.br = 0 THEN 1 WHEN a.br = 0 OR b.br = 0 THEN 0 ELSE 1 - abs(a.br - b.br) / greatest(a.br, b.br) END AS branching_sim
  FROM x a JOIN x b ON substr(b.test_id, 2)::BIGINT = substr(a.test_id, 2)::BIGINT + 20 LEFT JOIN dots ON dots.i = a.test_id AND dots.j = b.test_id)
SELECT i, j, round(cosine, 6) AS cosine, round(node_sim, 6) AS node_sim, round(edge_sim, 6) AS edge_sim, round(depth_sim, 6) AS depth_sim, round(branching_sim, 6) AS branching_sim, round(0.4 * node_sim + 0.3 * edge_sim + 0.2 * depth_sim + 0.1 * branching_sim, 6) AS structural FROM r""")
def _(t):
    return rounded(paths.graph_similarity(trace_pairs(t), t.traces()), "cosine", "node_sim", "edge_sim", "depth_sim", "branching_sim", "structural")


@query("j12_divergences")
def _(t):
    return paths.divergences(trace_pairs(t), t.traces())


@query("b22_relevant_calls", sql("traces") + " SELECT test_id, seq, method_id FROM traces WHERE category <> 'Framework' AND call_depth <= 3")
def _(t):
    return paths.relevant(t.traces(), 3).select("test_id", "seq", "method_id")


@query("e7_trace_statistics", sql("traces") + " SELECT count(DISTINCT test_id) AS traces, count(DISTINCT method_id) FILTER (is_production) AS covered, trunc(avg(call_depth))::INT AS avg_depth, max(call_depth) AS max_depth FROM traces")
def _(t):
    return paths.trace_statistics(t.traces())


@query("e8_trace_breakdown", sql("traces") + " SELECT test_id, 'category' AS side, category AS value, count(*) AS calls FROM traces GROUP BY ALL UNION ALL SELECT test_id, 'depth', call_depth::VARCHAR, count(*) FROM traces GROUP BY ALL")
def _(t):
    return paths.trace_breakdown(t.traces())
