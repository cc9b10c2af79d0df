"""Call-graph operators over edges (caller, callee): neighbours, closures, shortest depths, statistics, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactlens.sources.cut import Pieces, cut


#: Rows of a frontier that may be broadcast.
BROADCAST = 100_000


def callees(edges: DataFrame, method: str) -> DataFrame:
    return edges.where(F.col("caller") == method).select("callee")


def callers(edges: DataFrame, method: str) -> DataFrame:
    return edges.where(F.col("callee") == method).select("caller")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")).distinct()


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """source, node, depth: every node reachable from each seed along edges, at its least depth; seeds have depth 0.

    seeds: source, node. stop: nodes (column node) that are reached but not expanded. Each step is one join on the
    frontier only; cycles end because a node that was reached is not reached again. The edges are written once and not
    derived anew at each step; they aren't partitioned by caller, so that a caller of very many can still be split. What
    was reached stands in about log(depth) pieces, so a step's tasks don't grow with the depth.
    """
    if max_depth is None or max_depth > 1:
        edges = cut(edges.select("caller", "callee"))
    if stop is not None:  # as large as the tests may be
        stop = stop.select("node").hint("merge")
    reached = seeds.select("source", "node", F.lit(0).alias("depth")).distinct()
    frontier, depth = cut(reached), 0
    done = Pieces(frontier)
    if frontier.count() > BROADCAST:  # plans take seeds derived from text for small ones
        edges = edges.hint("merge")
    while max_depth is None or depth < max_depth:
        depth += 1
        grow = frontier if stop is None else frontier.join(stop, "node", "left_anti")
        step = grow.join(edges, grow["node"] == edges["caller"]).select("source", F.col("callee").alias("node")).distinct()
        step = cut(step.join(done.whole(), ["source", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            break
        done.add(step)
        frontier = step
    return done.whole()


def path_confidence(depth: Column) -> Column:
    return F.when(depth <= 1, 1.0).when(depth <= 3, 0.8).when(depth <= 6, 0.6).otherwise(0.4)


def tests_exercising(edges: DataFrame, targets: DataFrame, tests: DataFrame, max_depth: int | None = None) -> DataFrame:
    """target, test_id, depth, confidence: tests that reach a target; the search doesn't go on behind a test.

    targets: method_id; tests: test_id. A test counts once for each target, at its least depth.
    """
    stop = cut(tests.select(F.col("test_id").alias("node")).distinct())
    back = closure(reversed_edges(edges), targets.select(F.col("method_id").alias("source"), F.col("method_id").alias("node")), max_depth, stop)
    found = back.where("depth > 0").join(stop.hint("merge"), "node", "left_semi")
    return found.select(F.col("source").alias("target"), F.col("node").alias("test_id"), "depth", path_confidence(F.col("depth")).alias("confidence"))


def by_confidence(found: DataFrame) -> DataFrame:
    """target, test_id, depth, confidence with the place of each test among those of its target, surest first."""
    order = Window.partitionBy("target").orderBy(F.desc("confidence"), "depth", "test_id")
    return found.withColumn("place", F.row_number().over(order))


def dependents(edges: DataFrame, seeds: DataFrame, include_seeds: bool = False) -> DataFrame:
    """method_id, depth: everything that a change of the seeds (method_id) affects."""
    one = closure(reversed_edges(edges), seeds.select(F.lit("all").alias("source"), F.col("method_id").alias("node")))
    return one.where(F.lit(include_seeds) | (F.col("depth") > 0)).select(F.col("node").alias("method_id"), "depth")


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """Edges touched by going from the seeds in both directions, to a depth."""
    both = edges.unionByName(reversed_edges(edges)).distinct()
    near = closure(both, seeds.select(F.lit("all").alias("source"), F.col("method_id").alias("node")), depth - 1).select("node")
    out = edges.join(near, edges["caller"] == near["node"], "left_semi")
    return out.unionByName(edges.join(near, edges["callee"] == near["node"], "left_semi")).distinct()


def trace(edges: DataFrame, methods: DataFrame, tests: DataFrame, max_depth: int = 20, breadth: int | None = 50) -> DataFrame:
    """test_id, method_id, depth: what each test executes; at most `breadth` callees of a method, least ids first (None: all)."""
    some = edges.join(methods, edges["callee"] == methods["method_id"], "left_semi").select("caller", "callee")
    if breadth is not None:
        order = Window.partitionBy("caller").orderBy("callee")
        some = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= breadth).select("caller", "callee")
    found = closure(some, tests.select(F.col("test_id").alias("source"), F.col("test_id").alias("node")), max_depth - 1)
    return found.where("depth > 0").select(F.col("source").alias("test_id"), F.col("node").alias("method_id"), "depth")


def statistics(edges: DataFrame) -> DataFrame:
    """One row: callers, edges, average and greatest fan-out, greatest fan-in, density."""
    out = edges.groupBy("caller").count().agg(F.count("*").alias("nodes"), F.sum("count").alias("edges"), F.max("count").alias("max_fan_out"))
    into = edges.groupBy("callee").count().agg(F.max("count").alias("max_fan_in"))
    n = F.col("nodes").cast("double")
    return out.crossJoin(into).select(
        "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce(F.try_divide("edges", "nodes"), F.lit(0.0)).alias("avg_fan_out"),
        F.coalesce("max_fan_out", F.lit(0)).alias("max_fan_out"), F.coalesce("max_fan_in", F.lit(0)).alias("max_fan_in"),
        F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"),
    )


def integrity(edges: DataFrame, back: DataFrame) -> DataFrame:
    """One row: edges that the reverse table lacks, reverse edges that the table lacks, and whether both are 0."""
    swapped = back.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    lost = edges.join(swapped, ["caller", "callee"], "left_anti").agg(F.count("*").alias("missing_reverse"))
    extra = swapped.join(edges, ["caller", "callee"], "left_anti").agg(F.count("*").alias("missing_forward"))
    return lost.crossJoin(extra).withColumn("valid", (F.col("missing_reverse") == 0) & (F.col("missing_forward") == 0))


def levels(edges: DataFrame) -> DataFrame:
    """node, level: a node's level is its place in dependency order (0: calls nothing); null for nodes of cycles and for
    what leads to them."""
    left = cut(edges)
    nodes = edges.select(F.col("caller").alias("node")).union(edges.select(F.col("callee").alias("node"))).distinct()
    todo, level = cut(nodes), 0
    done = Pieces(todo.where("false").withColumn("level", F.lit(0)))
    while True:
        free = todo.join(left, todo["node"] == left["caller"], "left_anti").withColumn("level", F.lit(level))
        free = cut(free)
        if free.isEmpty():
            break
        done.add(free)
        todo = cut(todo.join(free, "node", "left_anti"))
        left = cut(left.join(free, left["callee"] == free["node"], "left_anti"))
        level += 1
    return done.whole().unionByName(todo.withColumn("level", F.lit(None).cast("int")))


def with_overrides(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """edges and, both ways, the pairs of an interface or base method and what implements it; makes 2-cycles."""
    ways = pairs.select(F.col("base").alias("caller"), F.col("impl").alias("callee"))
    return edges.unionByName(ways).unionByName(reversed_edges(ways)).distinct()
