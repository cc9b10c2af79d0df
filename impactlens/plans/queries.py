"""Every query over the derived tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlens.functions import classify, diff, names
from impactlens.operators import changes, conflict, coverage, graph, history, scoring, similarity
from impactlens.plans.registry import ORACLE_SQL, QUERIES, query, rounded  # noqa: F401
from impactlens.sources.adapter import AS_OF, Tables, sql

# Graph

SMALL_PARTS = "SELECT 'P' || p_partkey AS method_id FROM part WHERE p_size = 1"


def small_parts(t: Tables) -> DataFrame:
    return t.raw("part").where("p_size = 1").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("method_id"))


@query("g3_tests_exercising", sql("edges") + f"""
SELECT DISTINCT a.callee AS target, b.caller AS test_id, 2 AS depth, 0.8::DOUBLE AS confidence
FROM edges a JOIN edges b ON b.callee = a.caller WHERE a.callee IN ({SMALL_PARTS}) AND b.caller LIKE 'C%'""")
def _(t):
    return graph.tests_exercising(t.edges(), small_parts(t), t.tests())


@query("g6_affected_methods", sql("edges") + f""", seeds AS ({SMALL_PARTS}),
up AS (SELECT DISTINCT caller AS m FROM edges WHERE callee IN (SELECT method_id FROM seeds)),
top AS (SELECT DISTINCT caller AS m FROM edges WHERE callee IN (SELECT m FROM up))
SELECT method_id, 0 AS depth FROM seeds UNION ALL SELECT m, 1 FROM up UNION ALL SELECT m, 2 FROM top""")
def _(t):
    return graph.dependents(t.edges(), small_parts(t), include_seeds=True)


@query("g1_transitive_dependents", sql("edges") + """, RECURSIVE_free AS (
SELECT caller AS m, 1 AS d FROM edges WHERE callee = 'R1'),
d2 AS (SELECT DISTINCT e.caller AS m FROM edges e JOIN RECURSIVE_free r ON e.callee = r.m),
d3 AS (SELECT DISTINCT e.caller AS m FROM edges e JOIN d2 ON e.callee = d2.m),
d4 AS (SELECT DISTINCT e.caller AS m FROM edges e JOIN d3 ON e.callee = d3.m),
d5 AS (SELECT DISTINCT e.caller AS m FROM edges e JOIN d4 ON e.callee = d4.m)
SELECT m AS method_id, d AS depth FROM RECURSIVE_free UNION ALL SELECT m, 2 FROM d2 UNION ALL SELECT m, 3 FROM d3 UNION ALL SELECT m, 4 FROM d4 UNION ALL SELECT m, 5 FROM d5""")
def _(t):
    return graph.dependents(t.edges(), t.spark.createDataFrame([("R1",)], "method_id string"))


@query("c2_c3_neighbours", sql("edges") + " SELECT 'callee' AS side, callee AS method_id FROM edges WHERE caller = 'P7' UNION ALL SELECT 'caller', caller FROM edges WHERE callee = 'P7'")
def _(t):
    one = graph.callees(t.edges(), "P7").select(F.lit("callee").alias("side"), F.col("callee").alias("method_id"))
    return one.unionByName(graph.callers(t.edges(), "P7").select(F.lit("caller").alias("side"), F.col("caller").alias("method_id")))


@query("c4_reverse_degree", sql("edges") + " SELECT callee AS method_id, count(*) AS callers FROM edges GROUP BY callee")
def _(t):
    return graph.reversed_edges(t.edges()).groupBy(F.col("caller").alias("method_id")).agg(F.count("*").alias("callers"))


@query("e9_graph_statistics", sql("edges") + """, o AS (SELECT caller, count(*) AS n FROM edges GROUP BY caller), i AS (SELECT callee, count(*) AS n FROM edges GROUP BY callee)
SELECT (SELECT count(*) FROM o) AS nodes, (SELECT sum(n)::BIGINT FROM o) AS edges, round((SELECT sum(n)::DOUBLE / count(*) FROM o), 6) AS avg_fan_out, (SELECT max(n) FROM o) AS max_fan_out,
(SELECT max(n) FROM i) AS max_fan_in, round((SELECT sum(n)::DOUBLE / (count(*)::DOUBLE * (count(*) - 1)) FROM o), 6) AS density""")
def _(t):
    return rounded(graph.statistics(t.edges()), "avg_fan_out", "density")


@query("e10_graph_integrity", sql("edges") + " SELECT 0::BIGINT AS missing_reverse, count(*) AS missing_forward, count(*) = 0 AS valid FROM edges WHERE caller = 'none'")
def _(t):
    return graph.integrity(t.edges(), graph.reversed_edges(t.edges()))


@query("g8_focused_subgraph", sql("edges") + """ SELECT DISTINCT caller, callee FROM edges WHERE caller IN ('S1') OR callee IN ('S1')
OR caller IN (SELECT caller FROM edges WHERE callee = 'S1' UNION SELECT callee FROM edges WHERE caller = 'S1') OR callee IN (SELECT caller FROM edges WHERE callee = 'S1' UNION SELECT callee FROM edges WHERE caller = 'S1')""")
def _(t):
    return graph.subgraph(t.edges(), t.spark.createDataFrame([("S1",)], "method_id string"), 2)


@query("g7_traces", sql("edges", "tests") + """, e AS (SELECT caller, callee FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY callee) AS k FROM edges) WHERE k <= 50),
s AS (SELECT test_id FROM tests), d1 AS (SELECT DISTINCT test_id, callee AS m FROM s JOIN e ON caller = test_id), d2 AS (SELECT DISTINCT test_id, callee AS m FROM d1 JOIN e ON caller = m),
d3 AS (SELECT DISTINCT test_id, callee AS m FROM d2 JOIN e ON caller = m)
SELECT test_id, m AS method_id, 1 AS depth FROM d1 UNION ALL SELECT test_id, m, 2 FROM d2 UNION ALL SELECT test_id, m, 3 FROM d3""")
def _(t):
    return graph.trace(t.edges(), t.methods(), t.tests(), max_depth=4)


@query("t11_dependency_levels", sql("edges") + """, full_ AS (SELECT caller AS m FROM edges WHERE substr(caller, 1, 1) = 'O'), n AS (SELECT caller AS m FROM edges UNION SELECT callee FROM edges)
SELECT m AS node, CASE substr(m, 1, 1) WHEN 'R' THEN 0 WHEN 'N' THEN 1 WHEN 'S' THEN 2 WHEN 'P' THEN 3 WHEN 'O' THEN CASE WHEN m IN (SELECT m FROM full_) THEN 4 ELSE 0 END
ELSE CASE WHEN m IN (SELECT caller FROM edges WHERE callee IN (SELECT m FROM full_)) THEN 5 ELSE 1 END END AS level FROM n""")
def _(t):
    return graph.levels(t.edges())


@query("g10_cycles", sql("edges") + """, c AS (SELECT DISTINCT caller AS m FROM edges WHERE substr(caller, 1, 1) = 'P' AND substr(callee, 1, 1) = 'S' UNION SELECT DISTINCT callee FROM edges WHERE substr(caller, 1, 1) = 'P' AND substr(callee, 1, 1) = 'S')
SELECT substr(m, 1, 1) AS kind, count(*) AS n FROM (SELECT m FROM c UNION SELECT caller FROM edges WHERE substr(caller, 1, 1) IN ('O', 'C') AND (substr(caller, 1, 1) = 'O' OR callee IN (SELECT caller FROM edges))) GROUP BY 1""")
def _(t):
    edges = t.edges()
    both = graph.with_overrides(edges, edges.where("caller like 'P%' and callee like 'S%'").select(F.col("caller").alias("base"), F.col("callee").alias("impl")))
    return graph.levels(both).where("level is null").groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


# Coverage

CHANGES_SQL = "changes AS (SELECT p_size AS change_id, 'P' || p_partkey AS method_id FROM part WHERE p_size <= 10)"


def change_sets(t: Tables) -> DataFrame:
    return t.raw("part").where("p_size <= 10").groupBy(F.col("p_size").alias("change_id")).agg(F.collect_list(F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).alias("changed_methods"))


@query("e1_coverage_map", sql("coverage") + " SELECT method_id, count(DISTINCT test_id) AS tests FROM coverage GROUP BY method_id")
def _(t):
    return coverage.coverage_map(t.coverage())


@query("e2_coverage_statistics", sql("coverage", "methods") + """ SELECT (SELECT count(*) FROM methods WHERE NOT is_test) AS methods, count(DISTINCT method_id) AS covered, count(*) AS relationships,
round(100.0::DOUBLE * count(DISTINCT method_id) / (SELECT count(*) FROM methods WHERE NOT is_test), 6) AS percentage FROM coverage""")
def _(t):
    return rounded(coverage.statistics(t.coverage(), t.methods()), "percentage")


@query("c6_uncovered_methods", sql("coverage", "methods") + " SELECT method_id FROM methods WHERE NOT is_test AND method_id NOT IN (SELECT method_id FROM coverage)")
def _(t):
    return coverage.uncovered(t.methods(), t.coverage())


@query("e4_change_coverage", sql("coverage") + f""", {CHANGES_SQL}
SELECT change_id, count(DISTINCT changes.method_id) AS changed, count(DISTINCT coverage.method_id) AS covered, count(DISTINCT test_id) AS tests,
round(100.0::DOUBLE * count(DISTINCT coverage.method_id) / count(DISTINCT changes.method_id), 6) AS percentage FROM changes LEFT JOIN coverage USING (method_id) GROUP BY change_id""")
def _(t):
    return rounded(coverage.change_coverage(change_sets(t), t.coverage()), "percentage")


@query("p22_coverage_recommendations", sql("coverage") + f""", {CHANGES_SQL},
held AS (SELECT * FROM coverage WHERE substr(method_id, 2)::BIGINT % 7 > 0 AND (substr(method_id, 2)::BIGINT % 3 > 0 OR substr(test_id, -1) = '7')),
best AS (SELECT change_id, changes.method_id, max(CASE WHEN far THEN 0.4 ELSE 0.8 END) AS confidence, min(CASE WHEN far THEN 5 ELSE 2 END) AS depth, count(test_id) AS n
  FROM changes LEFT JOIN (SELECT *, substr(test_id, -1) = '7' AS far FROM held) c USING (method_id) GROUP BY 1, 2)
SELECT change_id, 'High' AS priority, 'MissingTests' AS kind, count(*) AS affected FROM best WHERE n = 0 GROUP BY 1
UNION ALL SELECT change_id, 'Medium', 'LowConfidence', count(*) FROM best WHERE n > 0 AND confidence < 0.6 GROUP BY 1
UNION ALL SELECT change_id, 'Low', 'IndirectCoverage', count(*) FROM best WHERE n > 0 AND depth > 3 GROUP BY 1""")
def _(t):
    """Some parts are covered by no test, and some only by tests that are far from them."""
    far, key = F.col("test_id").endswith("7"), F.substring("method_id", 2, 20).cast("long")
    some = t.coverage().where((key % 7 > 0) & ((key % 3 > 0) | far))
    return coverage.recommendations(change_sets(t), some.withColumn("depth", F.when(far, 5).otherwise(2)).withColumn("confidence", F.when(far, 0.4).otherwise(0.8)))


@query("e5_confidence_histogram", sql("coverage") + """ SELECT count(*) FILTER (c >= 0.8) AS high, count(*) FILTER (c >= 0.5 AND c < 0.8) AS medium, count(*) FILTER (c < 0.5) AS low, round(avg(c), 6) AS average
FROM (SELECT (length(test_id) % 5) * 0.25::DOUBLE AS c FROM coverage)""")
def _(t):
    return rounded(coverage.confidence_histogram(t.coverage().withColumn("confidence", F.length("test_id") % 5 * 0.25)), "average")


# History and scores

HISTORY = f"""aged AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(executed_at::TIMESTAMP)) / 86400000000.0::DOUBLE AS age FROM runs),
newest AS (SELECT *, row_number() OVER (PARTITION BY test_id, (NOT passed AND age <= 7) ORDER BY executed_at DESC, run_id) AS k FROM aged),
h AS (SELECT test_id, count(*) AS runs, count(*) FILTER (NOT passed) AS failures, max(executed_at) AS last_run, avg(duration_ms) FILTER (passed) AS avg_passed_ms,
  stddev_pop(duration_ms) AS sd_ms, avg(duration_ms) AS mean_ms, count(*) FILTER (age <= 7) AS runs_7d, count(*) FILTER (age <= 30) AS runs_30d,
  count(*) FILTER (NOT passed AND age <= 30) AS failures_30d, min(age) AS last_age,
  sum(CASE WHEN age <= 1 THEN 0.3::DOUBLE WHEN age <= 3 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END) FILTER (NOT passed AND age <= 7 AND k <= 5) AS points,
  count(*) FILTER (NOT passed AND age <= 7 AND k <= 5) AS recent, max(age) FILTER (NOT passed AND age <= 7 AND k <= 5) - min(age) FILTER (NOT passed AND age <= 7 AND k <= 5) AS span
  FROM newest GROUP BY test_id),
latest AS (SELECT test_id, passed AS last_passed FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY executed_at DESC, run_id) AS n FROM runs) WHERE n = 1),
hist AS (SELECT h.*, last_passed, failures::DOUBLE / runs AS rate, runs >= 5 AND failures::DOUBLE / runs > 0.1 AND failures::DOUBLE / runs < 0.9 AS flaky FROM h JOIN latest USING (test_id))"""


@query("e11_failure_rates", sql("runs") + f", {HISTORY} SELECT test_id, runs, failures, round(rate, 6) AS rate, flaky, last_passed, round(avg_passed_ms, 6) AS avg_passed_ms FROM hist")
def _(t):
    found = history.summary(t.runs(), AS_OF).select("test_id", "runs", "failures", history.failure_rate().alias("rate"), history.is_flaky().alias("flaky"), "last_passed", "avg_passed_ms")
    return rounded(found, "rate", "avg_passed_ms")


RELIABILITY = "CASE WHEN 1 - rate >= 0.7 AND 1 - rate <= 0.95 THEN 0.8 WHEN 1 - rate > 0.95 THEN 0.6 WHEN 1 - rate >= 0.5 THEN 0.5 WHEN 1 - rate >= 0.2 THEN 0.3 ELSE 0.1 END::DOUBLE"
RECENT = "least(0.5::DOUBLE, coalesce(points, 0) + CASE WHEN recent >= 2 AND span <= 2 THEN 0.2::DOUBLE ELSE 0 END)"
FREQUENCY = """least(0.4::DOUBLE, CASE WHEN runs_7d >= 5 THEN 0.2::DOUBLE WHEN runs_7d >= 2 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN runs_30d >= 10 THEN 0.2::DOUBLE WHEN runs_30d >= 5 THEN 0.1::DOUBLE ELSE 0 END
 + CASE WHEN last_age <= 1 THEN 0.1::DOUBLE WHEN last_age <= 7 THEN 0.05::DOUBLE ELSE 0 END)"""


@query("p7_history_score", sql("runs") + f""", {HISTORY} SELECT test_id, round({RELIABILITY}, 6) AS reliability, round({RECENT}, 6) AS recent, round({FREQUENCY}, 6) AS frequency,
round(greatest(0::DOUBLE, least(1::DOUBLE, ({RELIABILITY} + {RECENT} + {FREQUENCY}) * CASE WHEN flaky THEN 0.6::DOUBLE ELSE 1 END)), 6) AS score FROM hist""")
def _(t):
    found = history.summary(t.runs(), AS_OF).select("test_id", history.reliability().alias("reliability"), history.recent_failures().alias("r"), history.frequency().alias("frequency"), history.score().alias("score"))
    return rounded(found.withColumnRenamed("r", "recent"), "reliability", "recent", "frequency", "score")


BASE_TIME = "CASE WHEN avg_ms <= 50 THEN 1.0 WHEN avg_ms <= 100 THEN 0.9 WHEN avg_ms <= 250 THEN 0.8 WHEN avg_ms <= 500 THEN 0.7 WHEN avg_ms <= 1000 THEN 0.5 WHEN avg_ms <= 5000 THEN 0.3 WHEN avg_ms <= 15000 THEN 0.2 ELSE 0.1 END::DOUBLE"
FACTOR = "CASE WHEN runs IS NULL OR runs < 3 OR mean_ms = 0 THEN 1.0 WHEN sd_ms / mean_ms > 0.5 THEN 0.8 WHEN sd_ms / mean_ms > 0.3 THEN 0.9 ELSE 1.0 END::DOUBLE"
CATEGORY_BASE = "CASE category WHEN 'Unit' THEN 0.3 WHEN 'Integration' THEN 0.6 WHEN 'Database' THEN 0.4 WHEN 'API' THEN 0.7 WHEN 'EndToEnd' THEN 0.8 ELSE 0.2 END::DOUBLE"


@query("p5_time_scores", sql("tests") + f""" SELECT test_id, round(least(1::DOUBLE, {BASE_TIME} * CASE WHEN avg_ms > 500 THEN 0.3::DOUBLE ELSE 1.2 END), 6) AS fast,
round({BASE_TIME} * CASE WHEN avg_ms > 5000 THEN 0.6::DOUBLE ELSE 1 END, 6) AS medium, round({BASE_TIME} * CASE WHEN avg_ms > 30000 THEN 0.8::DOUBLE ELSE 1 END, 6) AS high, round({BASE_TIME} * 0.9, 6) AS "full" FROM tests""")
def _(t):
    return rounded(t.tests().select("test_id", *(scoring.time_score(F.col("avg_ms"), k).alias(k.lower()) for k in scoring.LEVELS)), "fast", "medium", "high", "full")


SCORED = f"""scored AS (SELECT test_id, test_key, category, avg_ms,
 {BASE_TIME} * CASE WHEN avg_ms > 5000 THEN 0.6::DOUBLE ELSE 1 END * {FACTOR} AS time_score,
 CASE WHEN runs IS NULL THEN 0.5::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, ({RELIABILITY} + {RECENT} + {FREQUENCY}) * CASE WHEN flaky THEN 0.6::DOUBLE ELSE 1 END)) END AS history_score,
 least(1::DOUBLE, ({CATEGORY_BASE} + CASE WHEN NOT coalesce(last_passed, true) AND last_age < 7 THEN 0.3::DOUBLE WHEN NOT coalesce(last_passed, true) AND last_age < 30 THEN 0.1::DOUBLE ELSE 0 END) * CASE WHEN coalesce(flaky, false) THEN 0.7::DOUBLE ELSE 1 END) AS impact_score
 FROM tests LEFT JOIN hist USING (test_id))"""


@query("p1_combined_scores", sql("tests", "runs") + f", {HISTORY}, {SCORED} SELECT test_id, round(time_score, 6) AS time_score, round(history_score, 6) AS history_score, round(impact_score, 6) AS impact_score, round((0.4 * impact_score + 0.3 * time_score + 0.3 * history_score) / 1.0, 6) AS score FROM scored")
def _(t):
    return rounded(scoring.scored(t.tests(), t.runs(), AS_OF).select("test_id", "time_score", "history_score", "impact_score", "score"), "time_score", "history_score", "impact_score", "score")


@query("p3_change_impact", sql("tests") + """, facts AS (SELECT list(lower('nation' || n_nationkey)) AS names FROM nation WHERE n_regionkey = 1)
SELECT test_id, round(least(1.0::DOUBLE, CASE WHEN direct > 0 THEN least(0.9::DOUBLE, direct * 0.3::DOUBLE) + CASE WHEN category = 'Unit' THEN 0.1::DOUBLE ELSE 0 END ELSE 0 END
 + CASE category WHEN 'Unit' THEN CASE WHEN direct > 0 THEN 0.6::DOUBLE ELSE 0.2 END WHEN 'Integration' THEN 0.4 WHEN 'Database' THEN 0.7 WHEN 'API' THEN 0.3 WHEN 'EndToEnd' THEN 0.3 ELSE 0.1 END), 6) AS impact
FROM (SELECT *, CASE WHEN list_contains(names, 'nation' || nation) THEN 1 ELSE 0 END AS direct FROM tests, facts)""")
def _(t):
    nations = t.raw("nation").where("n_regionkey = 1").select(F.concat(F.lit("Nation"), F.col("n_nationkey").cast("string")).alias("n"))
    made = nations.agg(F.collect_list("n").alias("changed_methods")).select(F.lit("src/a.cs").alias("file_path"), F.lit("Modified").alias("change_type"), "changed_methods", F.array(F.lit("Shop.PartRepository")).alias("changed_types"))
    tests = t.tests().withColumn("dependencies", F.col("tags")).withColumn("file_path", F.lit("tests/b.cs")).withColumn("historical_success", F.lit(False))
    return rounded(scoring.change_impact(tests, made).select("test_id", "impact"), "impact")


@query("p11_selection")
def _(t):
    found = scoring.scored(t.tests(), t.runs(), AS_OF).withColumn("plan", F.col("category"))
    return rounded(scoring.select(found, "plan", "Medium", budget_ms=100_000.0, most=50), "score")


@query("p14_batches")
def _(t):
    found = scoring.scored(t.tests(), t.runs(), AS_OF).withColumn("plan", F.col("category"))
    made = scoring.batches(scoring.select(found, "plan", "Medium", budget_ms=100_000.0, most=50), "plan")
    return made.groupBy("plan", "batch").agg(F.count("*").alias("tests"), F.max("avg_ms").alias("batch_ms"))


@query("e15_category_summary", sql("tests") + " SELECT category, count(*) AS tests, round(avg(avg_ms), 6) AS avg_ms, count(DISTINCT nation) AS groups FROM tests GROUP BY category")
def _(t):
    return rounded(t.tests().groupBy("category").agg(F.count("*").alias("tests"), F.avg("avg_ms").alias("avg_ms"), F.count_distinct(F.col("tags")[1]).alias("groups")), "avg_ms")


# Similarity

OVERLAP = """n AS (SELECT test_id, count(*) AS n FROM coverage GROUP BY test_id),
pairs AS (SELECT a.test_id AS i, b.test_id AS j, count(*) AS common FROM coverage a JOIN coverage b ON a.method_id = b.method_id AND a.test_id < b.test_id GROUP BY 1, 2),
sims AS (SELECT i, j, common, x.n AS n_i, y.n AS n_j, common::DOUBLE / (x.n + y.n - common) AS jaccard FROM pairs JOIN n x ON x.test_id = i JOIN n y ON y.test_id = j)"""


@query("j3_coverage_overlap", sql("coverage") + f", {OVERLAP} SELECT i, j, common, n_i, n_j, round(jaccard, 6) AS jaccard FROM sims")
def _(t):
    return rounded(similarity.overlaps(t.coverage()), "jaccard")


@query("j2_weighted_overlap", sql("coverage") + """, w AS (SELECT 'P' || p_partkey AS method_id, CASE WHEN p_size > 25 THEN 1.0 ELSE 0.3 END::DECIMAL(18, 6) AS weight FROM part),
own AS (SELECT test_id, method_id, weight FROM coverage JOIN w USING (method_id)), total AS (SELECT test_id, sum(weight) AS w FROM own GROUP BY 1),
p AS (SELECT a.test_id AS i, b.test_id AS j, sum(a.weight) AS common FROM own a JOIN own b ON a.method_id = b.method_id AND a.test_id < b.test_id GROUP BY 1, 2)
SELECT i, j, round(common::DOUBLE / (x.w + y.w - common)::DOUBLE, 6) AS weighted FROM p JOIN total x ON x.test_id = i JOIN total y ON y.test_id = j""")
def _(t):
    weights = t.raw("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("method_id"), F.when(F.col("p_size") > 25, 1.0).otherwise(0.3).alias("weight"))
    return rounded(similarity.weighted_overlaps(t.coverage(), weights), "weighted")


META = """meta AS (SELECT i, j, jaccard, CASE WHEN a.category = b.category THEN 1.0 WHEN least(a.category, b.category) = 'Integration' AND greatest(a.category, b.category) = 'Unit' THEN 0.3
  WHEN least(a.category, b.category) = 'EndToEnd' AND greatest(a.category, b.category) = 'Integration' THEN 0.4 WHEN least(a.category, b.category) = 'Database' AND greatest(a.category, b.category) = 'Integration' THEN 0.5 ELSE 0.0 END::DOUBLE AS category_sim,
  ((a.tag = b.tag)::INT + (a.nation = b.nation)::INT)::DOUBLE / (4 - (a.tag = b.tag)::INT - (a.nation = b.nation)::INT) AS tag_sim,
  CASE WHEN a.avg_ms < 1 AND b.avg_ms < 1 THEN 1.0::DOUBLE WHEN a.avg_ms <= 0 OR b.avg_ms <= 0 THEN 0 ELSE sqrt(least(a.avg_ms, b.avg_ms) / greatest(a.avg_ms, b.avg_ms)) END AS time_sim
  FROM sims JOIN tests a ON a.test_id = i JOIN tests b ON b.test_id = j)"""


@query("j13_metadata_similarity", sql("coverage", "tests") + f", {OVERLAP}, {META} SELECT i, j, round(category_sim, 6) AS category_sim, round(tag_sim, 6) AS tag_sim, round(time_sim, 6) AS time_sim FROM meta")
def _(t):
    return rounded(similarity.metadata(similarity.overlaps(t.coverage()), t.tests()).select("i", "j", "category_sim", "tag_sim", "time_sim"), "category_sim", "tag_sim", "time_sim")


@query("r1_recommendations")
def _(t):
    pairs = similarity.metadata(similarity.overlaps(t.coverage()), t.tests())
    return rounded(similarity.recommendations(pairs), "confidence")


@query("e22_matrix_statistics", sql("coverage") + f", {OVERLAP} SELECT count(*) AS pairs, round(avg(jaccard), 6) AS mean, round(stddev_pop(jaccard), 6) AS sd, round(min(jaccard), 6) AS least, round(max(jaccard), 6) AS most, round(median(jaccard), 6) AS median FROM sims")
def _(t):
    return rounded(similarity.matrix_statistics(similarity.overlaps(t.coverage())), "mean", "sd", "least", "most", "median")


@query("e23_average_similarity", sql("coverage") + f", {OVERLAP} SELECT test_id, round(avg(jaccard), 6) AS average FROM (SELECT i AS test_id, jaccard FROM sims UNION ALL SELECT j, jaccard FROM sims) GROUP BY test_id")
def _(t):
    return rounded(similarity.average_per_test(similarity.overlaps(t.coverage())), "average")


@query("k1_single_linkage")
def _(t):
    return similarity.single_linkage(similarity.overlaps(t.coverage()), 0.06)


@query("k3_complete_linkage")
def _(t):
    pairs = similarity.overlaps(t.coverage())
    return rounded(similarity.intra_similarity(similarity.linkage(pairs, 0.08), pairs), "cohesion")


@query("j9_path_similarity")
def _(t):
    paths = t.raw("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: F.concat(F.lit("S"), x["l_suppkey"].cast("string"))).alias("a"))
    pairs = paths.select(F.col("l_orderkey").alias("i"), "a").join(paths.select(F.col("l_orderkey").alias("j"), F.col("a").alias("b")), F.col("j") == F.col("i") + 500)
    return rounded(similarity.path_similarity(pairs).drop("a", "b"), "lcs", "edit", "trigram", "sequential")


# Conflicts and snapshots

CONFLICTS = """ranks AS (SELECT a.test_id AS i, b.test_id AS j, CASE WHEN a.access <> 'Read' OR b.access <> 'Read' THEN 3 ELSE 1 END AS rank FROM data_deps a JOIN data_deps b ON a.resource_id = b.resource_id AND a.test_id < b.test_id
  UNION ALL SELECT a.test_id, b.test_id, 2 FROM data_deps a JOIN data_deps b ON a.entity = b.entity AND a.test_id < b.test_id),
found AS (SELECT i, j, max(rank) AS rank FROM ranks GROUP BY i, j),
conflicts AS (SELECT i, j, CASE rank WHEN 3 THEN 'SharedData' WHEN 2 THEN 'ResourceContention' ELSE 'PotentialRaceCondition' END AS kind, CASE rank WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS severity, rank = 3 AS blocking FROM found)"""


@query("h4_conflicts", sql("data_deps") + f", {CONFLICTS} SELECT i, j, kind, severity, blocking FROM conflicts")
def _(t):
    return conflict.conflicts(t.data_deps())


@query("e25_conflict_report", sql("data_deps") + f", {CONFLICTS} SELECT kind, severity, count(*) AS pairs, count(*) FILTER (blocking) AS blocking FROM conflicts GROUP BY kind, severity")
def _(t):
    return conflict.report(conflict.conflicts(t.data_deps()))


@query("e27_parallel_ratio", sql("data_deps") + f""", {CONFLICTS}, n AS (SELECT count(DISTINCT test_id) AS tests FROM data_deps), m AS (SELECT count(*) FILTER (blocking) AS must FROM conflicts)
SELECT tests, must, (tests * (tests - 1) // 2 - must)::BIGINT AS can, round((tests * (tests - 1) / 2 - must)::DOUBLE / (tests * (tests - 1) / 2), 6) AS ratio FROM n, m""")
def _(t):
    return rounded(conflict.parallel_ratio(conflict.conflicts(t.data_deps()), t.data_deps()), "ratio")


SNAPSHOTS = """WITH f AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS sha, doc_id AS n FROM documents),
a AS (SELECT path, sha FROM f WHERE n % 11 <> 0), b AS (SELECT path, CASE WHEN n % 10 = 0 THEN sha256(sha || 'edited') ELSE sha END AS sha FROM f WHERE n % 13 <> 0)"""


@query("c17_snapshot_difference", SNAPSHOTS + " SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'Added' WHEN b.path IS NULL THEN 'Deleted' ELSE 'Modified' END AS status FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.sha <> b.sha")
def _(t):
    return changes.difference(*t.snapshots())


@query("c18_stale_entries", """WITH keys AS (SELECT 'K' || o_custkey AS cache_key, 'DOC/' || (o_orderkey % 1000) AS file FROM orders), changed AS (SELECT 'doc/' || doc_id AS path FROM documents)
SELECT DISTINCT cache_key FROM keys JOIN changed ON lower(file) = lower(path)""")
def _(t):
    keys = t.raw("orders").groupBy(F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("cache_key")).agg(F.collect_set(F.concat(F.lit("DOC/"), (F.col("o_orderkey") % 1000).cast("string"))).alias("files"))
    return changes.stale(t.raw("documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path")), keys)


@query("m2_cleanup", f"""WITH e AS (SELECT user_id AS owner, event_id::VARCHAR AS path, (abs(value) * 100)::BIGINT AS bytes, ts AS accessed FROM events),
m AS (SELECT *, CASE WHEN (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(accessed::TIMESTAMP)) / 86400000000.0::DOUBLE > 7 THEN 'unused' END AS reason FROM e),
o AS (SELECT *, sum(bytes) OVER (PARTITION BY owner ORDER BY accessed DESC, path ROWS UNBOUNDED PRECEDING) AS kept FROM m WHERE reason IS NULL)
SELECT owner, path, reason FROM m WHERE reason IS NOT NULL UNION ALL SELECT owner, path, 'lru' FROM o WHERE kept > 20000 * 0.7""")
def _(t):
    entries = t.raw("events").select(F.col("user_id").alias("owner"), F.col("event_id").cast("string").alias("path"), F.expr("cast(round(abs(value) * 100) as bigint)").alias("bytes"), F.lit(AS_OF).cast("timestamp").alias("created"), F.col("ts").alias("accessed"))
    return changes.cleanup(entries, AS_OF, 20_000).select("owner", "path", "reason")


# Names, rules, diffs


@query("f1_method_names", """WITH m AS (SELECT p_partkey AS k, 'Shop.' || replace(p_name, ' ', '.') || '(int,' || p_brand || ')' AS id FROM part)
SELECT k, split_part(id, '(', 1) AS bare, list_extract(string_split(split_part(id, '(', 1), '.'), -1) AS name, lower(list_extract(string_split(split_part(id, '(', 1), '.'), -1)) = lower(list_extract(string_split(split_part(id, '(', 1), '.'), -1)) AS matches, 2 AS parameters FROM m""")
def _(t):
    made = t.raw("part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("Shop."), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("(int,"), "p_brand", F.lit(")")).alias("id"))
    own = F.col("id")
    return made.select("k", names.without_parameters(own).alias("bare"), names.name_only(own).alias("name"), names.matches(own, F.upper(names.name_only(own))).alias("matches"), F.size(names.parameters(own)).alias("parameters"))


@query("f8_name_tokens", """SELECT p_partkey AS k, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(p_name, '[_\\-. ]'), lambda x: length(x) > 2), lambda x: lower(x)))), ',') AS tokens FROM part""")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("k"), F.array_join(F.array_sort(names.tokens(F.col("p_name"), camel=False)), ",").alias("tokens"))


@query("f18_levenshtein", "SELECT a.n_nationkey AS i, b.n_nationkey AS j, levenshtein(a.n_name, b.n_name)::INT AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(t):
    a = t.raw("nation")
    b = a.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("other"), "n_regionkey")
    return a.join(b, "n_regionkey").where("n_nationkey < j").select(F.col("n_nationkey").alias("i"), "j", F.levenshtein("n_name", "other").alias("distance"))


@query("f24_fingerprints", "SELECT o_orderkey AS k, sha256(o_orderstatus || '|' || o_orderpriority) AS fingerprint FROM orders")
def _(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("k"), names.fingerprint(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("fingerprint"))


@query("b11_categories", """SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'EndToEnd' WHEN p_partkey % 7 = 1 THEN 'UI' WHEN p_partkey % 7 = 2 THEN 'Database' WHEN p_partkey % 7 = 3 THEN 'API' WHEN p_partkey % 7 = 4 THEN 'Performance' WHEN p_partkey % 7 = 5 THEN 'Security' ELSE 'Integration' END AS category FROM part""")
def _(t):
    words = F.array(*(F.lit(x) for x in ("RunE2E", "BrowserOpens", "SqlWorks", "HttpGet", "StressAll", "AuthFails", "Integration")))
    method = F.get(words, (F.col("p_partkey") % 7).cast("int"))
    return t.raw("part").select(F.col("p_partkey").alias("k"), classify.category(method, F.lit("PartTests"), F.lit("Shop"), F.lit("Shop")).alias("category"))


@query("b16_test_types", sql("methods") + " SELECT method_id, CASE WHEN is_test THEN 'Unit' ELSE 'Unknown' END AS test_type, CASE WHEN is_test THEN 'TestUtility' WHEN containing_type = 'PartRepository' THEN 'DataAccess' WHEN containing_type = 'SupplierFactory' THEN 'Infrastructure' ELSE 'BusinessLogic' END AS category FROM methods WHERE containing_type <> 'OrderService' AND containing_type <> 'Region' AND containing_type <> 'Nation'")
def _(t):
    own = t.methods().where(~F.col("containing_type").isin("OrderService", "Region", "Nation"))
    return own.select("method_id", classify.test_type(F.col("is_test"), F.col("file_path"), F.lit("run"), F.col("containing_type")).alias("test_type"), classify.method_category(F.col("is_test"), F.col("containing_type"), F.lit("run")).alias("category"))


@query("d1_diffs", """SELECT n_nationkey AS diff_id, 'src/' || n_name || '.cs' AS file_path, CASE WHEN n_nationkey % 3 = 0 THEN 'Added' ELSE 'Modified' END AS change_type, 'Load' || n_nationkey AS methods, 'Repo' || n_nationkey AS types FROM nation""")
def _(t):
    n = F.col("n_nationkey").cast("string")
    head = F.concat(F.lit("diff --git a/src/"), "n_name", F.lit(".cs b/src/"), "n_name", F.lit(".cs\n"), F.when(F.col("n_nationkey") % 3 == 0, "new file mode 100644\n--- /dev/null\n").otherwise("--- a/x\n"))
    text = F.concat(head, F.lit("+++ b/src/x.cs\n@@ -1,2 +1,3 @@\n public class Kept {}\n+public class Repo"), n, F.lit(" {\n+    public void Load"), n, F.lit("(int a) {\n-    if (x) {\ndiff --git a/n.txt b/n.txt\n+++ b/n.txt\n+void Not() {\n"))
    found = diff.changes(t.raw("nation").select(F.col("n_nationkey").alias("diff_id"), text.alias("text")))
    return found.select("diff_id", "file_path", "change_type", F.array_join("changed_methods", ",").alias("methods"), F.array_join("changed_types", ",").alias("types"))
