"""Queries that report on plans, clusters, conflicts and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlens.operators import artefacts, conflict, scoring, similarity
from impactlens.plans.queries import CONFLICTS, OVERLAP, change_sets
from impactlens.plans.registry import query, rounded
from impactlens.sources.adapter import AS_OF, Tables, sql

# Selection


def plan(t: Tables) -> DataFrame:
    found = scoring.scored(t.tests(), t.runs(), AS_OF).withColumn("plan", F.lit("all"))
    return scoring.select(found, "plan", "Medium", budget_ms=100_000.0, most=50)


@query("p12_fast_selection")
def _(t):
    found = scoring.scored(t.tests(), t.runs(), AS_OF, "Fast").withColumn("plan", F.lit("all"))
    return rounded(scoring.select_fast(found, "plan", 100_000.0, 50, 0.4), "score")


@query("p17_plan_time")
def _(t):
    return rounded(scoring.plan_time(scoring.batches(plan(t), "plan"), "plan"), "ms")


@query("e15_plan_metrics", sql("tests") + """, c AS (SELECT nation AS plan, category, count(*) AS n, sum(avg_ms) AS ms, sum(floor(avg_ms) / 8192) AS score FROM tests GROUP BY ALL)
SELECT plan, sum(n)::BIGINT AS tests, round(sum(ms), 6) AS total_ms, round(sum(score) / sum(n), 6) AS mean_score, string_agg(category || '=' || n, ',' ORDER BY category) AS categories FROM c GROUP BY plan""")
def _(t):
    made = scoring.plan_metrics(t.tests().select(F.replace(F.col("tags")[1], F.lit("nation"), F.lit("")).cast("int").alias("plan"), "category", "avg_ms", (F.floor("avg_ms") / 8192).alias("score")), "plan")
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("categories")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rounded(made.withColumn("categories", listed), "total_ms", "mean_score")


@query("p19_expected_tests", "SELECT 'P' || p_partkey || 'Test' AS test_name, 0.8::DOUBLE AS confidence FROM part WHERE p_size <= 10 UNION ALL SELECT DISTINCT p_type || 'IntegrationTest', 0.6::DOUBLE FROM part WHERE p_size <= 10")
def _(t):
    methods = change_sets(t).select(F.explode("changed_methods").alias("method_id"))
    return scoring.expected_tests(methods, t.raw("part").where("p_size <= 10").select(F.col("p_type").alias("type")))


@query("e32_change_summary", "SELECT count(DISTINCT p_size) AS changes, count(DISTINCT p_size) AS files, count(*) AS methods, count(DISTINCT p_size) AS types, least(1.0, round((0.1 * count(*) + 0.2 * count(DISTINCT p_size)) / count(DISTINCT p_size), 6))::DOUBLE AS impact FROM part WHERE p_size <= 10")
def _(t):
    made = change_sets(t).select(F.col("change_id").cast("string").alias("file_path"), "changed_methods", F.array(F.lit("T")).alias("changed_types"))
    return rounded(scoring.change_summary(made), "impact")


@query("e18_category_listing", sql("tests") + " SELECT category, count(*) AS tests, min(name) AS first, max(name) AS last FROM tests GROUP BY category")
def _(t):
    return t.tests().groupBy("category").agg(F.count("*").alias("tests"), F.min("name").alias("first"), F.max("name").alias("last"))


# Pairs and clusters


def pairs(t: Tables) -> DataFrame:
    return similarity.overlaps(t.coverage())


@query("u1_overlap_facts", sql("coverage") + f", {OVERLAP} SELECT i, j, common, n_i - common AS only_i, n_j - common AS only_j, round(100 * jaccard, 6) AS percentage FROM sims")
def _(t):
    return rounded(similarity.overlap_facts(pairs(t)).select("i", "j", "common", "only_i", "only_j", "percentage"), "percentage")


NEAREST = "near AS (SELECT i, j, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY jaccard DESC, j) AS k FROM (SELECT i, j, jaccard FROM sims UNION SELECT j, i, jaccard FROM sims)) WHERE k = 1)"


@query("u1_common_methods", sql("coverage") + f""", {OVERLAP}, {NEAREST},
m AS (SELECT i, j, method_id, bool_or(a) AS a, bool_or(b) AS b FROM (SELECT i, j, method_id, true AS a, false AS b FROM near JOIN coverage ON test_id = i UNION ALL SELECT i, j, method_id, false, true FROM near JOIN coverage ON test_id = j) GROUP BY 1, 2, 3)
SELECT i, j, method_id, CASE WHEN a AND b THEN 'both' WHEN a THEN 'i' ELSE 'j' END AS side FROM m""")
def _(t):
    """Of every test and the one most similar to it."""
    near = similarity.most_similar(pairs(t)).select(F.col("test_id").alias("i"), F.col("nearest").alias("j"))
    return similarity.common_methods(t.coverage(), near)


@query("u2_tag_sets", sql("coverage", "tests") + f""", {OVERLAP} SELECT i, j, array_to_string(list_sort(list_filter([a.tag, 'nation' || a.nation], lambda x: list_contains([b.tag, 'nation' || b.nation], x))), ',') AS common_tags
FROM sims JOIN tests a ON a.test_id = i JOIN tests b ON b.test_id = j""")
def _(t):
    return similarity.tag_sets(pairs(t).select("i", "j"), t.tests()).select("i", "j", F.array_join(F.array_sort("common_tags"), ",").alias("common_tags"))


@query("t4_most_similar", sql("coverage") + f", {OVERLAP}, {NEAREST} SELECT i AS test_id, j AS nearest, round(jaccard, 6) AS jaccard FROM near")
def _(t):
    return rounded(similarity.most_similar(pairs(t)), "jaccard")


@query("t6_primary_recommendation")
def _(t):
    return rounded(similarity.primary(similarity.recommendations(similarity.metadata(pairs(t), t.tests()))), "confidence")


@query("j20_overall_similarity", sql("coverage", "tests") + f""", {OVERLAP} SELECT i, j, round(0.7 * jaccard + 0.3 * least(1.0, 0.3 * CASE WHEN a.category = b.category THEN 1.0 WHEN least(a.category, b.category) = 'Integration' AND greatest(a.category, b.category) = 'Unit' THEN 0.3
WHEN least(a.category, b.category) = 'EndToEnd' AND greatest(a.category, b.category) = 'Integration' THEN 0.4 WHEN least(a.category, b.category) = 'Database' AND greatest(a.category, b.category) = 'Integration' THEN 0.5 ELSE 0 END::DOUBLE + 0.4 * CASE WHEN a.name = b.name THEN 1 ELSE 0 END
+ 0.2 * ((a.tag = b.tag)::INT + (a.nation = b.nation)::INT)::DOUBLE / (4 - (a.tag = b.tag)::INT - (a.nation = b.nation)::INT) + 0.1 * CASE WHEN a.avg_ms < 1 AND b.avg_ms < 1 THEN 1 WHEN a.avg_ms <= 0 OR b.avg_ms <= 0 THEN 0 ELSE sqrt(least(a.avg_ms, b.avg_ms) / greatest(a.avg_ms, b.avg_ms)) END), 5) AS overall
FROM sims JOIN tests a ON a.test_id = i JOIN tests b ON b.test_id = j""")
def _(t):
    plain = t.tests().withColumn("name", F.replace("name", F.lit("Customer#"), F.lit("")))
    return similarity.metadata(pairs(t), plain).select("i", "j", F.round(similarity.overall(), 5).alias("overall"))


@query("k6_cluster_statistics")
def _(t):
    found = pairs(t)
    return rounded(similarity.cluster_statistics(similarity.single_linkage(found, 0.06), found, t.tests()), "cohesion", "size_spread", "silhouette")


@query("k10_cluster_profile", """SELECT c_nationkey::VARCHAR AS cluster, 'Shop.A' AS namespaces, 'Shop.A_Cluster_' || c_nationkey AS name, max_by(p, n * 1000 + ascii(p)) AS pattern
FROM (SELECT c_nationkey, c_mktsegment || 's' AS p, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey""")
def _(t):
    made = t.raw("customer").select(F.concat(F.lit("Shop.A."), "c_mktsegment", F.lit("Tests.Run"), F.col("c_custkey").cast("string")).alias("test_id"), F.col("c_nationkey").cast("string").alias("cluster"))
    return similarity.cluster_profile(made).withColumn("namespaces", F.array_join("namespaces", ","))


# Conflicts


@query("h3_conflict_reasons", sql("data_deps") + """, r AS (SELECT i, j, string_agg(w, ', ' ORDER BY w) AS r FROM (SELECT DISTINCT a.test_id AS i, b.test_id AS j, a.resource_id AS w FROM data_deps a JOIN data_deps b ON a.resource_id = b.resource_id AND a.test_id < b.test_id) GROUP BY 1, 2),
e AS (SELECT i, j, string_agg(w, ', ' ORDER BY w) AS e FROM (SELECT DISTINCT a.test_id AS i, b.test_id AS j, a.entity AS w FROM data_deps a JOIN data_deps b ON a.entity = b.entity AND a.test_id < b.test_id) GROUP BY 1, 2)
SELECT i, j, coalesce('Both use ' || r, 'Both touch ' || e) AS reason FROM r FULL JOIN e USING (i, j)""")
def _(t):
    return conflict.reasons(t.data_deps())


@query("h4_shared_fixtures", "SELECT 'S' || a.s_suppkey AS i, 'S' || b.s_suppkey AS j, 'SharedFixture' AS kind, 'Medium' AS severity, false AS blocking FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND 'S' || a.s_suppkey < 'S' || b.s_suppkey")
def _(t):
    return conflict.shared_fixtures(t.raw("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("test_id"), F.col("s_nationkey").cast("string").alias("class_name")))


@query("h8_exclusive_tests", sql("data_deps") + " SELECT test_id, bool_or(access <> 'Read' AND resource_id NOT LIKE '%S1%') AS exclusive FROM data_deps GROUP BY test_id")
def _(t):
    return conflict.exclusive(t.data_deps(), "S1")


@query("c15_parallel_pairs", sql("data_deps") + f""", {CONFLICTS}, p AS (SELECT 'O' || o_orderkey AS i, 'O' || (o_orderkey + 20) AS j FROM orders)
SELECT i, j, NOT EXISTS (SELECT 1 FROM conflicts c WHERE c.i = p.i AND c.j = p.j AND blocking) AS can_run FROM p""")
def _(t):
    made = t.raw("orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("i"), F.concat(F.lit("O"), (F.col("o_orderkey") + 20).cast("string")).alias("j"))
    return conflict.can_run(made, conflict.conflicts(t.data_deps()))


# Stored results


def entries(t: Tables) -> DataFrame:
    return t.raw("events").select(
        F.col("user_id").alias("owner"), F.col("event_id").cast("string").alias("path"), (F.col("event_id") % 1000).alias("bytes"), (F.col("ts") - F.expr("INTERVAL 20 DAYS")).alias("created"),
        F.col("ts").alias("accessed"), F.when(F.col("event_id") % 3 > 0, F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("expires"),
    )


NOW = f"TIMESTAMP '{AS_OF}'"


@query("e28_storage_statistics", f"""SELECT count(*) AS files, sum(event_id % 1000)::BIGINT AS bytes, count(*) FILTER (ts - INTERVAL 20 DAY < {NOW} - INTERVAL 30 DAY) AS expired, coalesce(sum(event_id % 1000) FILTER (ts - INTERVAL 20 DAY < {NOW} - INTERVAL 30 DAY), 0)::BIGINT AS expired_bytes,
count(*) FILTER (ts < {NOW} - INTERVAL 7 DAY) AS unused, coalesce(sum(event_id % 1000) FILTER (ts < {NOW} - INTERVAL 7 DAY), 0)::BIGINT AS unused_bytes, sum(event_id % 1000) > 800000 AS near_limit, true AS cleanup_due FROM events""")
def _(t):
    return artefacts.storage_statistics(entries(t), AS_OF, 1_000_000)


@query("e29_store_activity", f"SELECT count(*) AS total, count(*) - count(*) FILTER (event_id % 3 > 0 AND ts + INTERVAL 5 DAY <= {NOW}) AS active, count(*) FILTER (event_id % 3 > 0 AND ts + INTERVAL 5 DAY <= {NOW}) AS expired, sum(event_id % 1000)::BIGINT AS bytes FROM events")
def _(t):
    return artefacts.activity(entries(t), AS_OF)


@query("e31_ratios", "SELECT count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type <> 'click') AS misses, sum(event_id % 7)::BIGINT AS packed, sum(event_id % 70)::BIGINT AS plain, round(avg((event_type = 'click')::INT), 6) AS hit_ratio, round(1 - sum(event_id % 7)::DOUBLE / sum(event_id % 70), 6) AS saving FROM events")
def _(t):
    click = (F.col("event_type") == "click").cast("long")
    return rounded(artefacts.ratios(t.raw("events").select(click.alias("hits"), (1 - click).alias("misses"), (F.col("event_id") % 7).alias("packed"), (F.col("event_id") % 70).alias("plain"))), "hit_ratio", "saving")


@query("m9_modified_assemblies", "SELECT o_orderkey::VARCHAR AS path FROM orders WHERE o_orderkey % 5 IN (0, 1) OR o_orderkey % 2 = 0")
def _(t):
    own = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("written"), F.col("o_orderkey").alias("k"))
    cached = own.where("k % 5 != 0").select("path", (F.col("written") + F.when(F.col("k") % 2 == 0, F.expr("INTERVAL '-1' DAY")).otherwise(F.expr("INTERVAL '1' DAY"))).alias("discovered"))
    return artefacts.modified_assemblies(own.where("k % 5 != 1"), cached)


@query("m10_changed_projects", "SELECT o_custkey AS project FROM orders GROUP BY o_custkey HAVING max(o_orderdate) > TIMESTAMP '2000-01-01'")
def _(t):
    files = t.raw("orders").select(F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("written"))
    return artefacts.changed_projects(files, files.select("project").distinct().withColumn("created", F.lit("2000-01-01").cast("timestamp")))


@query("f25_content_fingerprints", "SELECT source AS project, sha256(string_agg(sha256(text), '|' ORDER BY doc_id::VARCHAR)) AS fingerprint FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source")
def _(t):
    files = t.raw("documents").where("text is not null and source is not null").select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    return artefacts.content_fingerprints(files)


@query("m12_storage_options", """SELECT n_nationkey * 5 AS projects, CASE WHEN n_nationkey >= 20 THEN 250000000 WHEN n_nationkey >= 8 THEN 500000000 WHEN n_nationkey >= 2 THEN 1073741824 END::BIGINT AS most_bytes,
CASE WHEN n_nationkey >= 20 THEN 7 WHEN n_nationkey >= 8 THEN 14 WHEN n_nationkey >= 2 THEN 30 END AS days_kept, CASE WHEN n_nationkey >= 20 THEN 1 WHEN n_nationkey >= 8 THEN 3 WHEN n_nationkey >= 2 THEN 7 END AS days_unused,
CASE WHEN n_nationkey >= 20 THEN 15 WHEN n_nationkey >= 8 THEN 30 WHEN n_nationkey >= 2 THEN 60 END AS cleanup_minutes FROM nation""")
def _(t):
    return artefacts.storage_options(t.raw("nation").select((F.col("n_nationkey") * 5).alias("projects")))


@query("t9_evicted", "SELECT owner, path FROM (SELECT user_id AS owner, event_id::VARCHAR AS path, sum(event_id % 1000) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS kept FROM events) WHERE kept > 10000 * 0.7")
def _(t):
    return artefacts.evict(entries(t), 10_000).select("owner", "path")
