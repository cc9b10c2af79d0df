"""Call paths between tests and methods, and execution traces: their graphs, similarity and where they part.

A trace is rows of test_id, seq, method_id, call_depth and, if at hand, category and call_path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactlens.functions import names
from impactlens.operators.graph import closure, path_confidence, subgraph
from impactlens.operators.similarity import array_jaccard
from impactlens.sources.cut import Pieces, cut

OUTSIDE = ("Framework", "ThirdParty")
#: How sure a path of each kind of test is.
TYPE_FACTOR = {"Unit": 1.0, "Integration": 0.9, "End2End": 0.8}


def call_paths(edges: DataFrame, methods: DataFrame, wanted: DataFrame, most_nodes: int = 12) -> DataFrame:
    """test_id, target, path, depth, confidence: a shortest path of at most `most_nodes` nodes from each test to its target.

    wanted: test_id, target. Of equally short paths the first by breadth-first order counts: callees of the caller's own
    type come before others and those of no known type last, then by id. Each hop is one join on the frontier, which
    holds one path for each test and node."""
    kind = methods.select(F.col("method_id"), F.col("containing_type").alias("kind"))
    rank = F.when(F.col("kind_b").isNull(), 2).when(F.col("kind_a") == F.col("kind_b"), 0).otherwise(1)
    ranked = edges.join(kind.toDF("caller", "kind_a"), "caller", "left").join(kind.toDF("callee", "kind_b"), "callee", "left").select("caller", "callee", rank.alias("rank"))
    ranked = cut(ranked)
    own = lambda r, id_: F.struct(r.alias("rank"), id_.alias("id"))
    frontier = cut(wanted.select("test_id", F.col("test_id").alias("node")).distinct().withColumn("path", F.array(own(F.lit(0), F.col("node")))))
    done = Pieces(frontier)
    for _ in range(most_nodes - 1):
        step = frontier.join(ranked, frontier["node"] == ranked["caller"]).select("test_id", F.col("callee").alias("node"), F.concat("path", F.array(own(F.col("rank"), F.col("callee")))).alias("path"))
        fresh = step.groupBy("test_id", "node").agg(F.min("path").alias("path")).join(done.whole().select("test_id", "node"), ["test_id", "node"], "left_anti")
        frontier = cut(fresh)
        if frontier.isEmpty():
            break
        done.add(frontier)
    found = done.whole().join(wanted.select("test_id", F.col("target").alias("node")).distinct(), ["test_id", "node"])
    depth = F.size("path") - 1
    return found.select("test_id", F.col("node").alias("target"), F.transform("path", lambda s: s["id"]).alias("path"), depth.alias("depth"), path_confidence(depth).alias("confidence"))


def coverage_confidence(depth: Column, test_type: Column, test_confidence: Column) -> Column:
    """Of a covering path: its depth, the kind of test, and how sure it is that it is a test."""
    by_type = F.lit(0.9)
    for name, value in TYPE_FACTOR.items():
        by_type = F.when(test_type == name, value).otherwise(by_type)
    total = path_confidence(depth) * by_type * (0.5 + 0.5 * test_confidence)
    return F.when(depth < 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def scoped_graph(edges: DataFrame, methods: DataFrame, changed: DataFrame, tests: DataFrame, files: DataFrame, depth: int = 10) -> DataFrame:
    """Edges near the changed methods (method_id) and the tests (test_id), or, without any, near the methods of the
    changed files (file_path)."""
    named = changed.select("method_id").unionByName(tests.select(F.col("test_id").alias("method_id"))).distinct()
    of_files = methods.join(files, "file_path", "left_semi").select("method_id")
    return subgraph(edges, named if not named.isEmpty() else of_files, depth)


def at_depth(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes whose least distance from a seed (source, node) is `depth`."""
    return closure(edges, seeds, depth).where(F.col("depth") == depth).select("source", "node")


def relevant(trace: DataFrame, most_depth: int = 20, outside: bool = False) -> DataFrame:
    """Without calls into frameworks and third parties, and none deeper than most_depth (0: any)."""
    kept = trace if outside else trace.where(~F.coalesce(F.col("category").isin(*OUTSIDE), F.lit(False)))
    return kept.where(F.col("call_depth") <= most_depth) if most_depth > 0 else kept


def execution_nodes(trace: DataFrame) -> DataFrame:
    """test_id, method_id, calls, depth (the least)."""
    return trace.groupBy("test_id", "method_id").agg(F.count("*").alias("calls"), F.min("call_depth").alias("depth"))


def execution_edges(trace: DataFrame) -> DataFrame:
    """test_id, caller, callee, depth, weight: each call to the next one where it is deeper, or as deep with a longer call
    path that holds all of this one's. Weight is ln(calls of both + 1)."""
    paths = "call_path" in trace.columns
    order = Window.partitionBy("test_id").orderBy("seq")
    after = lambda c: F.lead(c).over(order)
    rows = trace.withColumn("callee", after("method_id")).withColumn("next_depth", after("call_depth")).withColumn("calls", F.count("*").over(Window.partitionBy("test_id", "method_id")))
    rows = rows.withColumn("next_calls", after("calls"))
    held = F.lit(False)
    if paths:
        rows = rows.withColumn("next_path", after("call_path"))
        held = (F.size("next_path") > F.size("call_path")) & (F.size(F.array_except("call_path", "next_path")) == 0)
    linked = (F.col("next_depth") > F.col("call_depth")) | ((F.col("next_depth") == F.col("call_depth")) & held)
    return rows.where(F.col("callee").isNotNull() & linked).select("test_id", F.col("method_id").alias("caller"), "callee", F.col("next_depth").alias("depth"), F.log(F.col("calls") + F.col("next_calls") + 1).alias("weight")).distinct()


def graph_facts(trace: DataFrame) -> DataFrame:
    """One row per test: nodes and calls of each, edges, average and greatest depth, branching."""
    nodes = execution_nodes(trace).groupBy("test_id").agg(
        F.collect_list("method_id").alias("nodes"), F.map_from_entries(F.collect_list(F.struct("method_id", "calls"))).alias("calls"),
        F.avg("depth").alias("avg_depth"), F.max("depth").alias("max_depth"), F.sqrt(F.sum(F.col("calls") * F.col("calls"))).alias("norm"),
    )
    edges = execution_edges(trace).groupBy("test_id").agg(F.collect_set(F.struct("caller", "callee")).alias("edges"), F.count("*").alias("n_edges"))
    none = F.array().cast("array<struct<caller:string,callee:string>>")
    return nodes.join(edges, "test_id", "left").withColumn("edges", F.coalesce("edges", none)).withColumn("branching", F.coalesce("n_edges", F.lit(0)) / F.greatest(F.size("nodes") - 1, F.lit(1))).drop("n_edges")


def _ratio(a: Column, b: Column) -> Column:
    return 1.0 - F.abs(a - b) / F.greatest(a, b)


def graph_similarity(pairs: DataFrame, trace: DataFrame) -> DataFrame:
    """pairs (i, j) with cosine, node_sim, edge_sim, depth_sim, branching_sim and structural. Sets are held per test, which is
    one trace, and only pairs asked for are made."""
    facts = graph_facts(trace)
    side = lambda k: facts.select(*(F.col(c).alias(f"{k}_{c}" if c != "test_id" else k) for c in facts.columns))
    both = pairs.join(side("i"), "i").join(side("j"), "j")
    col = lambda k, c: F.col(f"{k}_{c}")
    dot = F.aggregate(F.array_intersect("i_nodes", "j_nodes"), F.lit(0.0), lambda s, m: s + F.element_at("i_calls", m) * F.element_at("j_calls", m))
    depth = F.when((col("i", "avg_depth") == 0) & (col("j", "avg_depth") == 0), 1.0).otherwise((_ratio(col("i", "avg_depth"), col("j", "avg_depth")) + _ratio(col("i", "max_depth"), col("j", "max_depth"))) / 2)
    a, b = col("i", "branching"), col("j", "branching")
    branching = F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(_ratio(a, b))
    found = both.select(
        *pairs.columns, (dot / (col("i", "norm") * col("j", "norm"))).alias("cosine"), array_jaccard(F.col("i_nodes"), F.col("j_nodes")).alias("node_sim"),
        array_jaccard(F.col("i_edges"), F.col("j_edges")).alias("edge_sim"), depth.alias("depth_sim"), branching.alias("branching_sim"),
    )
    return found.withColumn("structural", 0.4 * F.col("node_sim") + 0.3 * F.col("edge_sim") + 0.2 * F.col("depth_sim") + 0.1 * F.col("branching_sim"))


def sequences(trace: DataFrame) -> DataFrame:
    """test_id, calls: the array of (seq, method_id, call_depth) in order."""
    return trace.groupBy("test_id").agg(F.array_sort(F.collect_list(F.struct("seq", "method_id", "call_depth"))).alias("calls"))


def _depth_changes(calls: Column) -> Column:
    """(method, change, position) wherever the depth changes by more than one."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(calls) - 1, F.lit(1))), lambda k: F.struct(
        F.get(calls, k)["method_id"].alias("method"), (F.get(calls, k)["call_depth"] - F.get(calls, k - 1)["call_depth"]).alias("change"), k.alias("position")))
    return F.filter(steps, lambda s: F.abs(s["change"]) > 1)


def divergences(pairs: DataFrame, trace: DataFrame, most: int = 50) -> DataFrame:
    """i, j, kind, method, position: where the calls of two tests part first, and methods at which the depth changes
    differently in both (the first such change of the other counts); the first `most` of a pair."""
    calls = sequences(trace)
    both = pairs.join(calls.toDF("i", "a"), "i").join(calls.toDF("j", "b"), "j")
    ids = lambda c: F.transform(c, lambda x: x["method_id"])
    both = both.withColumn("prefix", names.common_prefix(ids("a"), ids("b"))).withColumn("other", _depth_changes(F.col("b")))
    point = lambda kind, method, at: F.struct(F.lit(kind).alias("kind"), method.alias("method"), at.cast("int").alias("position"))
    first = F.when(F.col("prefix") < F.least(F.size("a"), F.size("b")), F.array(point("sequential", F.get("a", F.col("prefix").cast("int"))["method_id"], F.col("prefix"))))
    twin = lambda s: F.get(F.filter("other", lambda o: o["method"] == s["method"]), 0)["change"]
    more = F.transform(F.filter(_depth_changes(F.col("a")), lambda s: F.coalesce(twin(s) != s["change"], F.lit(False))), lambda s: point("conditional", s["method"], s["position"]))
    none = F.array().cast("array<struct<kind:string,method:string,position:int>>")
    points = F.slice(F.concat(F.coalesce(first, none), more), 1, most)
    return both.select("i", "j", F.explode(points).alias("p")).select("i", "j", "p.kind", "p.method", "p.position")


def trace_statistics(trace: DataFrame) -> DataFrame:
    """One row: traces, distinct production methods, average depth (cut to a whole number) and greatest depth."""
    return trace.agg(
        F.count_distinct("test_id").alias("traces"), F.count_distinct(F.when(F.col("is_production"), F.col("method_id"))).alias("covered"),
        F.coalesce(F.avg("call_depth").cast("int"), F.lit(0)).alias("avg_depth"), F.coalesce(F.max("call_depth"), F.lit(0)).alias("max_depth"),
    )


def trace_breakdown(trace: DataFrame) -> DataFrame:
    """test_id, side (category or depth), value, calls: both breakdowns of each trace, in one pass."""
    sides = F.explode(F.array(F.struct(F.lit("category").alias("side"), F.col("category").alias("value")), F.struct(F.lit("depth").alias("side"), F.col("call_depth").cast("string").alias("value"))))
    return trace.select("test_id", sides.alias("s")).groupBy("test_id", "s.side", "s.value").agg(F.count("*").alias("calls"))


def is_production(is_test: Column, path: Column, category: Column) -> Column:
    return ~is_test & ~F.lower(path).rlike("test") & ~category.isin(*OUTSIDE)


def execution_report(traces: DataFrame, methods: DataFrame) -> DataFrame:
    """One row: traced tests, production methods (method_id, is_test), those that a trace (test_id, method_id, depth) holds
    and those that none does, percentage, average and greatest depth."""
    own = methods.where(~F.col("is_test")).select("method_id").distinct()
    held = traces.join(own, "method_id", "left_semi")
    some = held.agg(F.count_distinct("method_id").alias("covered"))
    every = traces.agg(F.count_distinct("test_id").alias("tests"), F.coalesce(F.avg("depth"), F.lit(0.0)).alias("avg_depth"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    total = own.agg(F.count("*").alias("methods"))
    both = total.crossJoin(some).crossJoin(every)  # one row each
    return both.select("tests", "methods", "covered", (F.col("methods") - F.col("covered")).alias("uncovered"), F.coalesce(100.0 * F.try_divide("covered", "methods"), F.lit(0.0)).alias("percentage"), "avg_depth", "max_depth")


def not_executed(traces: DataFrame, methods: DataFrame) -> DataFrame:
    """method_id of production methods that no trace holds."""
    return methods.where(~F.col("is_test")).select("method_id").distinct().join(traces.select("method_id").distinct(), "method_id", "left_anti")


def path_record(structural: DataFrame, sequential: DataFrame) -> DataFrame:
    """i, j, structural, sequential, path_sim (their mean) of pairs that have both."""
    both = structural.select("i", "j", "structural").join(sequential.select("i", "j", "sequential"), ["i", "j"])
    return both.withColumn("path_sim", (F.col("structural") + F.col("sequential")) / 2)


def depth_changes(trace: DataFrame) -> DataFrame:
    """test_id, seq, method_id, change: calls whose depth is more than one away from that of the call before."""
    before = F.lag("call_depth").over(Window.partitionBy("test_id").orderBy("seq"))
    return trace.withColumn("change", F.col("call_depth") - before).where(F.abs("change") > 1).select("test_id", "seq", "method_id", "change")
