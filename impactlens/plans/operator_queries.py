"""A query for each operator that has none of its own elsewhere: rules, functions, stores, streams, selections, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens import api
from impactlens.commands import Workspace
from impactlens.functions import attributes, classify, names, seeding
from impactlens.operators import artefacts, changes, conflict, coverage, lookups, paths, scoring, similarity
from impactlens.plans.code_queries import files
from impactlens.plans.queries import BASE_TIME, CONFLICTS, FACTOR, HISTORY, META, OVERLAP, SCORED, SMALL_PARTS, small_parts
from impactlens.plans.registry import ORACLE_SQL, query, rounded
from impactlens.plans.report_queries import entries, pairs
from impactlens.sources import projects, sinks
from impactlens.sources.adapter import AS_OF, Tables, sql
from impactlens.sources.cut import cut
from impactlens.streaming import files as file_stream
from impactlens.streaming import runs as run_stream


def text(c: str) -> Column:
    return F.col(c).cast("string")


def pick(key: str, *words: str | None) -> Column:
    """One of the words by a key's remainder."""
    return F.element_at(F.array(*(F.lit(w) for w in words)), (F.col(key) % len(words) + 1).cast("int"))


def cases(key: str, *words: str) -> str:
    return f"CASE {key} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def folder(t: Tables, name: str) -> str:
    """A new folder below the one that checkpoints are written to."""
    cut(t.spark.range(0))
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{t.spark.sql('select uuid()').first()[0]}"


# Sources, sinks and stores


@query("a4_source_files", "SELECT 'nation ' || n_nationkey AS content FROM nation")
def _(t):
    path = folder(t, "sources")
    t.raw("nation").select(F.concat(F.lit("nation "), text("n_nationkey")).alias("value"), F.col("n_nationkey").alias("n")).write.partitionBy("n").text(path)
    return projects.read_files(t.spark, path, "*.txt").select(F.rtrim(F.regexp_replace("content", "\n", "")).alias("content"))


CONFIG = '{"projects": {"include": ["/w/*"], "exclude": ["*7"], "excludeTypes": ["ui"], "testProjectsOnly": false}}'


@query("a12_configured_projects", "SELECT '/w/p' || p_partkey AS path FROM part WHERE p_partkey % 10 <> 7")
def _(t):
    return projects.filter_projects(t.raw("part").select(F.concat(F.lit("/w/p"), text("p_partkey")).alias("path")), projects.Config.parse(CONFIG)).select("path")


def stored(t: Tables) -> DataFrame:
    rows = t.raw("events")
    return rows.select(F.concat(F.lit("u"), text("user_id")).alias("key"), F.lpad(text("event_id"), 12, "0").alias("value"), F.col("ts").alias("created"), F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("expires"))


STORED = f"""newest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, lpad(event_id::VARCHAR, 12, '0') DESC) AS k FROM events WHERE ts <= TIMESTAMP '{AS_OF}')"""
ALIVE = f"k = 1 AND (event_id % 3 > 0 OR ts + INTERVAL 2 DAY > TIMESTAMP '{AS_OF}')"


@query("a13_stored_values", f"WITH {STORED} SELECT 'u' || user_id AS key, lpad(event_id::VARCHAR, 12, '0') AS value FROM newest WHERE {ALIVE}")
def _(t):
    store = artefacts.Store(t.spark, folder(t, "store"))
    store.put(stored(t))
    return store.get(AS_OF)


@query("a23_values_of_keys", f"WITH {STORED} SELECT 'u' || user_id AS key, lpad(event_id::VARCHAR, 12, '0') AS value FROM newest WHERE {ALIVE} AND user_id % 7 = 3")
def _(t):
    store = artefacts.Store(t.spark, folder(t, "store"))
    store.put(stored(t).where("key <= 'u5'"))
    store.put(stored(t).where("key > 'u5'"))
    return store.get(AS_OF, t.raw("events").where("user_id % 7 = 3").select(F.concat(F.lit("u"), text("user_id")).alias("key")).distinct())


@query("m3_get_or_make", f"""WITH {STORED}, had AS (SELECT 'u' || user_id AS key, lpad(event_id::VARCHAR, 12, '0') AS value FROM newest WHERE {ALIVE} AND user_id % 2 = 0)
SELECT 'u' || c_custkey AS key, coalesce(value, 'made') AS value FROM customer LEFT JOIN had ON key = 'u' || c_custkey""")
def _(t):
    store = artefacts.Store(t.spark, folder(t, "store"))
    store.put(stored(t).where("cast(substring(key, 2) as int) % 2 = 0"))
    wanted = t.raw("customer").select(F.concat(F.lit("u"), text("c_custkey")).alias("key"))
    return store.get_or_make(wanted, AS_OF, lambda keys: keys.withColumn("value", F.lit("made")))


@query("a14_json_and_back", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    path = folder(t, "json")
    sinks.write(t.raw("nation").select("n_nationkey", "n_name"), path, "json", compressed=True)
    return t.spark.read.schema("n_nationkey int, n_name string").json(path)


@query("a24_compressed_values", "SELECT 'n' || n_nationkey AS key, n_name AS value FROM nation WHERE n_nationkey % 5 > 0")
def _(t):
    store = artefacts.Store(t.spark, folder(t, "store"))
    expires = F.when(F.col("n_nationkey") % 5 == 0, F.lit("2024-01-02").cast("timestamp"))
    store.put(t.raw("nation").select(F.concat(F.lit("n"), text("n_nationkey")).alias("key"), F.col("n_name").alias("value"), F.lit("2024-01-01").alias("created"), expires.alias("expires")))
    return store.get(AS_OF)


@query("a17_written_text", "SELECT 'r_regionkey: ' || r_regionkey || ', r_name: ' || r_name AS value FROM region")
def _(t):
    path = folder(t, "text")
    sinks.write(t.raw("region").select("r_regionkey", "r_name"), path, "text")
    return t.spark.read.text(path)


@query("x8_added_format", "SELECT r_regionkey || ';' || r_name AS value FROM region")
def _(t):
    formats = dict(sinks.FORMATS)
    sinks.FORMATS["semicolons"] = (lambda df: df.select(F.concat_ws(";", *(F.col(c).cast("string") for c in df.columns)).alias("value")), "text")
    try:
        path = folder(t, "other")
        sinks.write(t.raw("region").select("r_regionkey", "r_name"), path, "semicolons")
    finally:
        sinks.FORMATS.clear()
        sinks.FORMATS.update(formats)
    return t.spark.read.text(path)


@query("a18_comparison_lines", sql("coverage", "tests") + f", {OVERLAP} SELECT 'i: ' || i || ', j: ' || j || ', label: ' || CASE WHEN jaccard >= 0.1 THEN 'some' ELSE 'few' END AS value FROM sims WHERE common >= 4")
def _(t):
    compared = similarity.overlaps(t.coverage(), least=4).select("i", "j", F.when(F.col("jaccard") >= 0.1, "some").otherwise("few").alias("label"), "jaccard")
    return sinks.comparison_text(compared, "Summary")


@query("f36_bytes", "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '512 B' WHEN 1 THEN '1.5 KB' WHEN 2 THEN '2 MB' ELSE '1.25 GB' END AS shown FROM part")
def _(t):
    size = F.element_at(F.array(F.lit(512), F.lit(1536), F.lit(2 * 1024**2), F.lit(1280 * 1024**2)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.raw("part").select(F.col("p_partkey").alias("k"), sinks.bytes_text(size).alias("shown"))


def fingerprints(t: Tables, later: bool = False) -> DataFrame:
    """A fingerprint for each customer's orders; in the later state, those of every third customer have changed."""
    more = F.when(F.col("o_custkey") % 3 == 0, "later").otherwise("") if later else F.lit("")
    return artefacts.content_fingerprints(t.raw("orders").select(text("o_custkey").alias("project"), text("o_orderkey").alias("path"), F.sha2(F.concat(text("o_orderkey"), more), 256).alias("sha256")))


@query("m5_stored_graphs", "SELECT DISTINCT o_custkey::VARCHAR AS project, 'C' || o_custkey AS caller, 'O' || o_orderkey AS callee FROM orders WHERE o_custkey % 3 <> 0")
def _(t):
    store = artefacts.GraphStore(t.spark, folder(t, "graphs"))
    edges = t.raw("orders").select(text("o_custkey").alias("project"), F.concat(F.lit("C"), text("o_custkey")).alias("caller"), F.concat(F.lit("O"), text("o_orderkey")).alias("callee"))
    store.put(edges, fingerprints(t))
    return store.get(fingerprints(t, later=True))


@query("m5_stale_graphs", "SELECT DISTINCT o_custkey::VARCHAR AS project FROM orders WHERE o_custkey % 3 = 0")
def _(t):
    store = artefacts.GraphStore(t.spark, folder(t, "graphs"))
    store.put(t.raw("orders").select(text("o_custkey").alias("project"), F.lit("a").alias("caller"), F.lit("b").alias("callee")).distinct(), fingerprints(t))
    return store.stale(fingerprints(t, later=True))


@query("m6_usable_projects", "SELECT DISTINCT o_custkey::VARCHAR AS project FROM orders WHERE o_custkey % 3 <> 0")
def _(t):
    return artefacts.usable(fingerprints(t), fingerprints(t, later=True)).select("project")


@query("m7_indexed_once", "SELECT 'type' AS kind, 'Repo' || p_partkey AS symbol, '/w/f' || p_partkey || '.cs' AS path FROM part")
def _(t):
    store = artefacts.IndexStore(t.spark, folder(t, "index"))
    store.warm(files(t).where("p_partkey % 2 = 0"))
    store.warm(files(t))
    return store.get(files(t)).where("kind = 'type' and symbol rlike '^Repo[0-9]+$'")


@query("m8_warmed_up", "SELECT count(*) FILTER (p_partkey % 2 = 0) AS first, count(*) FILTER (p_partkey % 2 = 1) AS second FROM part")
def _(t):
    store = artefacts.IndexStore(t.spark, folder(t, "index"))
    before = cut(store.warm(files(t).where("p_partkey % 2 = 0")).agg(F.count("*").alias("first")))
    even = files(t).where("p_partkey % 2 = 0").select(F.sha2("content", 256).alias("sha256"))
    every = files(t).select(F.sha2("content", 256).alias("sha256"))
    store.warm(files(t))
    return before.crossJoin(every.join(even, "sha256", "left_anti").agg(F.count("*").alias("second")))  # one row each


@query("m11_capacity", f"""WITH s AS (SELECT sum(event_id % 1000)::BIGINT AS bytes, coalesce(sum(event_id % 1000) FILTER (NOT (ts - INTERVAL 20 DAY < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY OR ts < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)), 0)::BIGINT AS fresh FROM events)
SELECT bytes, least(fresh, 700000) AS after_cleanup, bytes + 250000 > 1000000 AS needs_cleanup, bytes + 250000 <= 1000000 OR least(fresh, 700000) + 250000 <= 1000000 AS allowed FROM s""")
def _(t):
    return artefacts.capacity(entries(t), AS_OF, 1_000_000, 250_000, free_bytes=10**9)


@query("f38_estimated_saving")
def _(t):
    return rounded(t.raw("documents").select("doc_id", artefacts.estimated_saving(F.col("text")).alias("saving")), "saving")


# Streams


@query("x3_ingested_runs", "SELECT DISTINCT event_id AS run_id, 'C' || user_id AS test_id FROM events")
def _(t):
    path, table, checkpoint = folder(t, "runs"), folder(t, "history"), folder(t, "offsets")
    own = t.runs().withColumn("executed_at", F.col("executed_at").cast("timestamp"))
    own.write.parquet(path)
    own.limit(5).write.mode("append").parquet(path)  # repeats
    run_stream.append_runs(run_stream.runs_stream(t.spark, path, own.schema), table, checkpoint, "100 days").awaitTermination()
    return t.spark.read.parquet(table).select("run_id", "test_id")


@query("x3_daily_results", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1")
def _(t):
    path, table, checkpoint = folder(t, "runs"), folder(t, "daily"), folder(t, "offsets")
    own = t.runs().withColumn("executed_at", F.col("executed_at").cast("timestamp"))
    own.write.parquet(path)
    run_stream.daily(run_stream.runs_stream(t.spark, path, own.schema), table, checkpoint).awaitTermination()
    return t.spark.read.parquet(table).groupBy("day").agg(F.max("runs").alias("runs"), F.max("failures").alias("failures"))


@query("x2_stale_by_events", "SELECT DISTINCT 'K' || o_custkey AS cache_key FROM orders WHERE o_orderkey % 1000 < 100")
def _(t):
    path, stale, checkpoint = folder(t, "events"), folder(t, "stale"), folder(t, "offsets")
    t.spark.range(100).select(F.concat(F.lit("doc/"), text("id")).alias("path"), F.lit(AS_OF).cast("timestamp").alias("changed_at")).write.parquet(path)
    keys = lambda: t.raw("orders").groupBy(F.concat(F.lit("K"), text("o_custkey")).alias("cache_key")).agg(F.collect_set(F.concat(F.lit("DOC/"), (F.col("o_orderkey") % 1000).cast("string"))).alias("files"))
    file_stream.invalidate(t.spark.readStream.schema("path string, changed_at timestamp").parquet(path), keys, stale, checkpoint).awaitTermination()
    return t.spark.read.parquet(stale).select("cache_key").distinct()


def workspace(t: Tables) -> Workspace:
    return Workspace(t.methods(), t.edges(), t.tests(), t.runs(), as_of=AS_OF)


@query("x1_rows_one_by_one", sql("edges") + " SELECT DISTINCT 'P7' AS target, b.caller AS test_id, 2 AS depth FROM edges a JOIN edges b ON b.callee = a.caller WHERE a.callee = 'P7'")
def _(t):
    rows = [(r["target"], r["test_id"], r["depth"]) for r in workspace(t).find_tests_one_by_one("P7")]  # the tests of one method
    return t.spark.createDataFrame(rows, "target string, test_id string, depth int")


@query("a19_routes", "SELECT * FROM (VALUES ('GET', 6), ('POST', 11)) v(method, routes)")
def _(t):
    return t.spark.createDataFrame([(m, p) for m, p, _ in api.ROUTES], "method string, path string").groupBy("method").agg(F.count("*").cast("int").alias("routes"))


@query("a19_affected_tests", sql("edges") + ", n AS (SELECT DISTINCT caller AS m FROM edges WHERE callee LIKE 'P198%') SELECT DISTINCT caller AS test_id, 2 AS depth FROM edges WHERE callee IN (SELECT m FROM n)")
def _(t):
    diff = "diff --git a/a.cs b/a.cs\n+++ b/a.cs\n+    public void P198(int a) {\n"
    return api.answer(workspace(t), "POST", "/api/testselection/analyze-diff", {"diff": diff})


@query("a19_coverage_statistics", sql("coverage", "methods", "edges") + """, o AS (SELECT DISTINCT caller AS test_id, callee AS m FROM edges WHERE caller LIKE 'C%'), p AS (SELECT DISTINCT test_id, callee AS m FROM o JOIN edges ON caller = m),
s AS (SELECT DISTINCT test_id, callee AS m FROM p JOIN edges ON caller = m), n AS (SELECT DISTINCT test_id, callee AS m FROM s JOIN edges ON caller = m), r AS (SELECT DISTINCT test_id, callee AS m FROM n JOIN edges ON caller = m),
x AS (SELECT * FROM o UNION SELECT * FROM p UNION SELECT * FROM s UNION SELECT * FROM n UNION SELECT * FROM r)
SELECT (SELECT count(*) FROM methods WHERE NOT is_test) AS methods, count(DISTINCT m) AS covered, count(*) AS relationships, round(100.0::DOUBLE * count(DISTINCT m) / (SELECT count(*) FROM methods WHERE NOT is_test), 6) AS percentage FROM x""")
def _(t):
    return rounded(api.answer(workspace(t), "POST", "/api/testcoverage/statistics"), "percentage")


# Rules


@query("b15_test_methods", "SELECT p_partkey AS k, p_partkey % 5 = 0 OR p_partkey % 3 = 1 AND p_partkey % 4 <> 3 AS is_test FROM part")
def _(t):
    made = t.raw("part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 5 == 0).alias("flag"), pick("p_partkey", "/src/a.cs", "/my.Tests/a.cs", "/code/b.cs").alias("path"), pick("p_partkey", "ShouldRun", "LoadTests", "VerifyAll", "Load").alias("name"))
    return made.select("k", classify.is_test(F.col("flag"), F.col("path"), F.col("name")).alias("is_test"))


@query("b20_production_code", "SELECT p_partkey AS k, p_partkey % 2 = 1 AND p_partkey % 3 <> 0 AND p_partkey % 5 > 1 AS production FROM part")
def _(t):
    k = F.col("p_partkey")
    found = paths.is_production(k % 2 == 0, pick("p_partkey", "/Tests/a.cs", "/src/a.cs", "/src/b.cs"), pick("p_partkey", "Framework", "ThirdParty", "BusinessLogic", "DataAccess", "Unknown"))
    return t.raw("part").select(k.alias("k"), found.alias("production"))


@query("b21_change_types", "SELECT p_partkey AS k, CASE WHEN p_partkey % 5 < 3 THEN 'Configuration' ELSE 'Modified' END AS kind FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("k"), classify.change_type(pick("p_partkey", "/a/app.config", "b.JSON", "/c/d.xml", "/config/a.cs", "e.cs")).alias("kind"))


@query("b26_access_types", f"SELECT p_partkey AS k, {cases('p_partkey', 'Create', 'Update', 'Delete', 'Read', 'ReadWrite', 'Create')} AS access FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("k"), classify.access_type(pick("p_partkey", "InsertRow", "modify", "RemoveAll", "FindBy", "Save", "AddAndGet")).alias("access"))


@query("b27_levels", "SELECT * FROM (VALUES ('Fast', 0.7::DOUBLE, 30, 50), ('Medium', 0.85, 300, 200), ('High', 0.95, 900, 1000), ('Full', 0.99, 3600, NULL)) v(level, confidence, seconds, most)")
def _(t):
    return scoring.levels(t.spark).select("level", "confidence", "seconds", "most")


@query("b28_least_scores", sql("tests", "runs") + f", {HISTORY}, {SCORED}, l AS (SELECT * FROM (VALUES ('Fast', 0.6), ('Medium', 0.4), ('High', 0.2), ('Full', 0.0)) v(level, least)) SELECT level, count(*) FILTER ((0.4 * impact_score + 0.3 * time_score + 0.3 * history_score) / 1.0 >= least::DOUBLE) AS tests FROM scored, l GROUP BY level")
def _(t):
    found = scoring.scored(t.tests(), t.runs(), AS_OF)
    return found.crossJoin(scoring.levels(t.spark)).groupBy("level").agg(F.count_if(F.col("score") >= F.col("least")).alias("tests"))  # four rows


@query("b33_attribute_values", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'Slow' ELSE '' END AS categories, CASE WHEN p_partkey % 3 = 0 THEN '1,2' ELSE '' END AS cases FROM part")
def _(t):
    k = F.col("p_partkey")
    one = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    own = F.array(one("CategoryAttribute", F.when(k % 2 == 0, "Slow")), one("TestCaseAttribute", F.when(k % 3 == 0, "1,2").otherwise("")), one("OtherAttribute", F.lit("x")))
    return t.raw("part").select(k.alias("k"), F.array_join(attributes.values_of(own, "category"), ";").alias("categories"), F.array_join(attributes.values_of(own, "case"), ";").alias("cases"))


@query("d15_databases_in_memory", "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'db' || p_size WHEN 1 THEN ':memory:' ELSE '' END AS databases FROM part")
def _(t):
    source = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('o.UseInMemoryDatabase("db'), text("p_size"), F.lit('");\nrun();'))).when(F.col("p_partkey") % 3 == 1, 'c = "Data Source=:memory:";').otherwise("run();")
    return t.raw("part").select(F.col("p_partkey").alias("k"), F.array_join(seeding.in_memory(source), ",").alias("databases"))


# Look-ups


@query("c12_fuzzy_tests", """WITH t AS (SELECT 'Shop.Tests.' || c_mktsegment || 'Tests.Run' || c_custkey AS test_id, 'Run' || c_custkey AS method_name FROM customer),
w AS (SELECT * FROM (VALUES ('Run7'), ('buildingtests.run1'), ('X.Run12'), ('un3')) v(given))
SELECT given, test_id, CASE WHEN lower(method_name) = split_part(lower(given), '.', -1) THEN 1 WHEN ends_with(lower(test_id), CASE WHEN contains(given, '.') THEN split_part(lower(given), '.', -2) ELSE '' END || '.' || split_part(lower(given), '.', -1)) THEN 2
WHEN ends_with(lower(test_id), lower(given)) THEN 3 ELSE 4 END AS tier FROM t, w WHERE contains(lower(test_id), split_part(lower(given), '.', -1))""")
def _(t):
    made = t.raw("customer").select(F.concat(F.lit("Shop.Tests."), "c_mktsegment", F.lit("Tests.Run"), text("c_custkey")).alias("test_id"), F.concat(F.lit("Run"), text("c_custkey")).alias("method_name"))
    return coverage.fuzzy_matches(made, t.spark.createDataFrame([("Run7",), ("buildingtests.run1",), ("X.Run12",), ("un3",)], "given string"))


@query("c11_changed_by_many_names", "SELECT 'p' || a.p_partkey AS given, 'P' || b.p_partkey AS method_id FROM part a JOIN part b ON contains(b.p_partkey::VARCHAR, a.p_partkey::VARCHAR) AND starts_with('P' || b.p_partkey, 'P' || a.p_partkey)")
def _(t):
    """As many changed names as methods: joined by what they have in common."""
    key = F.concat(F.lit("P"), text("p_partkey"))
    return lookups.changed_methods(t.raw("part").select(key.alias("method_id")), t.raw("part").select(F.lower(key).alias("given")))


@query("c28_traces_by_pattern", sql("traces") + " SELECT test_id, seq FROM traces WHERE lower(test_id) = 'o7' OR lower(test_id) = 'o39'")
def _(t):
    wanted = names.matches(F.col("test_id"), F.lit("global::O7")) | names.matches(F.concat(F.lit("Shop.Run."), "test_id", F.lit("(int)")), F.lit("o39")) | names.matches(F.concat(F.lit("global::"), "test_id"), F.lit("o7"))
    return t.traces().where(wanted).select("test_id", "seq")


@query("f4_matching_names", "SELECT p_partkey AS k, p_partkey % 4 < 3 AS matches FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("k"), names.matches(pick("p_partkey", "global::A.Load(int)", "a.load", "X.Load(string)", "A.Loads"), pick("p_partkey", "A.LOAD(INT)", "A.Load", "load", "Load")).alias("matches"))


@query("f12_containers", f"SELECT p_partkey AS k, {cases('p_partkey', 'A.B', 'A', 'A.B.C')} AS container FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("k"), names.container(pick("p_partkey", "A.B.C.Load", "A.Load", "A.B.C.D.E")).alias("container"))


@query("f14_conventional_dependencies", f"SELECT p_partkey AS k, {cases('p_partkey', 'X.Foo', 'X.Y.Bar', 'X.Test.Plain')} AS about FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("k"), names.conventional_dependency(pick("p_partkey", "X.Tests", "X.Y.Test", "X.Test.Tests"), pick("p_partkey", "FooTests", "BarTest", "Plain")).alias("about"))


@query("f15_seconds", "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 30.0 WHEN 1 THEN 300.0 WHEN 2 THEN 3600.0 WHEN 3 THEN 45.0 END::DOUBLE AS seconds FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("k"), names.seconds(pick("p_partkey", "30s", "5M", "1h", "45", "soon")).alias("seconds"))


@query("f16_approximate_ids", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'Shop.' ELSE '' END || 'Repo.Load' || p_partkey || '.(' || p_size || ' params)' AS id FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("k"), names.approximate_id(pick("p_partkey", "Shop", None), F.lit("Repo"), F.concat(F.lit("Load"), text("p_partkey")), F.col("p_size")).alias("id"))


@query("f17_identifiers", "SELECT p_partkey AS k, p_type || '.Load(int,' || p_brand || ')' AS id FROM part")
def _(t):
    return t.raw("part").select(F.col("p_partkey").alias("k"), names.method_identifier(F.col("p_type"), F.lit("Load"), F.array(F.lit("int"), F.col("p_brand"))).alias("id"))


@query("f21_grams", sql("traces") + """, s AS (SELECT test_id, list(method_id ORDER BY seq) AS m FROM traces GROUP BY 1)
SELECT test_id, array_to_string(list_transform(range(1, len(m) - 1), lambda k: m[k] || '->' || m[k + 1] || '->' || m[k + 2]), ' ') AS grams FROM s""")
def _(t):
    own = paths.sequences(t.traces()).select("test_id", F.transform("calls", lambda c: c["method_id"]).alias("m"))
    return own.select("test_id", F.array_join(names.grams(F.col("m")), " ").alias("grams"))


NEXT = "x AS (SELECT test_id, list(method_id ORDER BY seq) AS m FROM traces GROUP BY 1), p AS (SELECT a.test_id AS i, b.test_id AS j, a.m AS a, b.m AS b FROM x a JOIN x b ON substr(b.test_id, 2)::BIGINT = substr(a.test_id, 2)::BIGINT + 20)"


def neighbours(t: Tables) -> DataFrame:
    """i, j, a, b: the calls of two traces each."""
    own = paths.sequences(t.traces()).select("test_id", F.transform("calls", lambda c: c["method_id"]).alias("m"))
    right = own.select(F.col("test_id").alias("j"), F.col("m").alias("b"))
    left = own.select(F.col("test_id").alias("i"), F.col("m").alias("a")).withColumn("j", F.concat(F.lit("O"), (F.substring("i", 2, 20).cast("long") + 20).cast("string")))
    return left.join(right, "j").select("i", "j", "a", "b")


@query("f22_common_prefixes", sql("traces") + f", {NEXT} SELECT i, j, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k])) AS prefix FROM p")
def _(t):
    return neighbours(t).select("i", "j", names.common_prefix(F.col("a"), F.col("b")).alias("prefix"))


def sequence_scores(rows: str, key: str = "i, j") -> str:
    """Common subsequences and edit distances of a and b, a row of the table for each element of a. Running greatest and least
    values carry each row's best on."""
    return f"""dp AS (SELECT {key}, a, b, 0 AS n, list_transform(range(0, len(b) + 1), lambda k: 0::BIGINT) AS lcs, range(0, len(b) + 1) AS edit FROM {rows}
UNION ALL SELECT {key}, a, b, n + 1,
list_transform(range(1, len(b) + 2), lambda k: list_max(list_transform(range(1, k + 1), lambda m: CASE WHEN m = 1 THEN lcs[1] ELSE greatest(lcs[m], CASE WHEN b[m - 1] = a[n + 1] THEN lcs[m - 1] + 1 ELSE 0 END) END))),
list_transform(range(1, len(b) + 2), lambda k: list_min(list_transform(range(1, k + 1), lambda m: k - m + CASE WHEN m = 1 THEN edit[1] + 1 ELSE least(edit[m] + 1, edit[m - 1] + CASE WHEN b[m - 1] = a[n + 1] THEN 0 ELSE 1 END) END)))
FROM dp WHERE n < len(a)),
done AS (SELECT {key}, a, b, lcs[len(b) + 1]::DOUBLE / greatest(len(a), len(b)) AS lcs, 1 - edit[len(b) + 1]::DOUBLE / greatest(len(a), len(b)) AS edit FROM dp WHERE n = len(a))"""


def recursive(prefix: str) -> str:
    return prefix.replace("WITH ", "WITH RECURSIVE ", 1)


@query("j25_sequence_scores", recursive(sql("traces")) + f", {NEXT}, {sequence_scores('p')} SELECT i, j, round(lcs, 6) AS lcs, round(edit, 6) AS edit FROM done")
def _(t):
    return rounded(similarity.path_similarity(neighbours(t)).select("i", "j", "lcs", "edit"), "lcs", "edit")


@query("w4_depth_changes", sql("traces") + " SELECT test_id, seq, method_id, change FROM (SELECT *, call_depth - lag(call_depth) OVER (PARTITION BY test_id ORDER BY seq) AS change FROM traces) WHERE abs(change) > 1")
def _(t):
    return paths.depth_changes(t.traces())


@query("e6_execution_report", sql("coverage", "methods") + """, m AS (SELECT method_id FROM methods WHERE NOT is_test)
SELECT count(DISTINCT test_id) AS tests, (SELECT count(*) FROM m) AS methods, count(DISTINCT method_id) AS covered, (SELECT count(*) FROM m) - count(DISTINCT method_id) AS uncovered, round(100.0::DOUBLE * count(DISTINCT method_id) / (SELECT count(*) FROM m), 6) AS percentage, 2.0::DOUBLE AS avg_depth, 2 AS max_depth FROM coverage""")
def _(t):
    return rounded(paths.execution_report(t.coverage().withColumn("depth", F.lit(2)), t.methods()), "percentage")


@query("e35_not_executed", sql("coverage", "methods") + " SELECT method_id FROM methods WHERE NOT is_test AND method_id NOT IN (SELECT method_id FROM coverage)")
def _(t):
    return paths.not_executed(t.coverage(), t.methods())


@query("e16_category_counts", sql("tests") + " SELECT category, count(*) AS tests, round(avg(avg_ms), 6) AS avg_ms FROM tests GROUP BY category")
def _(t):
    return rounded(workspace(t).analyze(), "avg_ms")


# Selection


def chosen(plan: str, least: float, most: int, budget: float, rows: str = "final") -> str:
    """Tests by score, passing over those that don't fit, within each plan: c the candidates, picked the places of those taken."""
    return f"""c AS (SELECT *, row_number() OVER (PARTITION BY {plan} ORDER BY score DESC, test_id) AS k FROM {rows} WHERE score >= {least} AND avg_ms <= {budget}),
pick AS (SELECT {plan}, 0::BIGINT AS k, 0::DOUBLE AS used, 0::BIGINT AS n, false AS taken FROM (SELECT DISTINCT {plan} FROM c)
UNION ALL SELECT pick.{plan}, c.k, CASE WHEN n < {most} AND used + avg_ms <= {budget} THEN used + avg_ms ELSE used END, CASE WHEN n < {most} AND used + avg_ms <= {budget} THEN n + 1 ELSE n END, n < {most} AND used + avg_ms <= {budget}
FROM pick JOIN c ON c.{plan} = pick.{plan} AND c.k = pick.k + 1),
picked AS (SELECT c.*, pick.n AS place FROM c JOIN pick ON c.{plan} = pick.{plan} AND c.k = pick.k WHERE taken)"""


FINAL = f"{HISTORY}, {SCORED}, final AS (SELECT *, category AS plan, (0.4 * impact_score + 0.3 * time_score + 0.3 * history_score) / 1.0 AS score FROM scored)"
SELECTION = recursive(sql("tests", "runs")) + f", {FINAL}, {chosen('plan', 0.4, 50, 100000)} SELECT plan, test_id, category, round(score, 6) AS score, avg_ms, place FROM picked"
ALONE = "category IN ('Database', 'UI', 'EndToEnd')"
BATCHES = recursive(sql("tests", "runs")) + f""", {FINAL}, {chosen('plan', 0.4, 50, 100000)}, b AS (SELECT *, (row_number() OVER (PARTITION BY plan ORDER BY CASE WHEN {ALONE} THEN -avg_ms ELSE 0 END, score DESC, test_id) - 1) // 4 + 1 AS batch FROM picked)
SELECT plan, batch, count(*) AS tests, max(avg_ms) AS batch_ms FROM b GROUP BY plan, batch"""
ONE_PLAN = FINAL.replace("category AS plan", "'all' AS plan")
DEALT = f"""g AS (SELECT *, sum(avg_ms) OVER (PARTITION BY CASE WHEN {ALONE} THEN test_id ELSE '' END) AS total FROM picked),
b AS (SELECT *, (row_number() OVER (ORDER BY total DESC, score DESC, test_id) - 1) // 4 + 1 AS batch FROM g)"""
PLAN_TIME = recursive(sql("tests", "runs")) + f", {ONE_PLAN}, {chosen('plan', 0.4, 50, 100000)}, {DEALT}, m AS (SELECT plan, batch, max(avg_ms) AS ms FROM b GROUP BY 1, 2) SELECT plan, round(sum(ms), 6) AS ms, count(*) AS batches FROM m GROUP BY plan"


@query("p10_dealt_plan", recursive(sql("tests", "runs")) + f", {ONE_PLAN}, {chosen('plan', 0.4, 50, 100000)}, {DEALT} SELECT test_id, round(score, 6) AS score, avg_ms, batch FROM b")
def _(t):
    return rounded(workspace(t).plan("Medium", 50, 100_000.0), "score")


@query("w5_running_budget", recursive(sql("tests", "runs")) + f", {FINAL}, {chosen('plan', 0.4, 1000000, 60000)} SELECT plan, count(*) AS tests, round(sum(avg_ms), 6) AS ms FROM picked GROUP BY plan")
def _(t):
    found = scoring.scored(t.tests(), t.runs(), AS_OF).withColumn("plan", F.col("category"))
    return rounded(scoring.select(found, "plan", "Medium", budget_ms=60_000.0, most=1_000_000).groupBy("plan").agg(F.count("*").alias("tests"), F.sum("avg_ms").alias("ms")), "ms")


@query("p15_compatible_groups", sql("tests") + f""", s AS (SELECT test_id, test_key // 10 AS plan, category, avg_ms FROM tests WHERE test_key % 10 < 6),
h AS (SELECT plan, min(test_id) FILTER (NOT {ALONE}) AS head FROM s GROUP BY plan) SELECT plan, test_id, CASE WHEN {ALONE} THEN test_id ELSE head END AS head FROM s JOIN h USING (plan)""")
def _(t):
    own = t.tests().where("test_key % 10 < 6").select(F.floor(F.col("test_key") / 10).alias("plan"), "test_id", "category", F.lit(0.5).alias("score"), "avg_ms")
    return scoring.compatible(own, "plan")


@query("p16_can_run_beside", sql("tests") + f"""SELECT a.test_id AS i, b.test_id AS j, NOT a.{ALONE} AND NOT b.{ALONE} AND a.nation <> b.nation AS beside FROM tests a JOIN tests b ON b.test_key = a.test_key + 1""")
def _(t):
    own = t.tests().select("test_id", "test_key", "category", F.array(F.col("tags")[1]).alias("dependencies"))
    a, b = own.toDF("i", "k", "kind_i", "needs_i"), own.select(F.col("test_id").alias("j"), (F.col("test_key") - 1).alias("k"), F.col("category").alias("kind_j"), F.col("dependencies").alias("needs_j"))
    return a.join(b, "k").select("i", "j", scoring.can_run_beside(F.col("kind_i"), F.col("kind_j"), F.col("needs_i"), F.col("needs_j")).alias("beside"))


@query("u6_shared_needs", sql("tests") + " SELECT a.test_id AS i, b.test_id AS j FROM tests a JOIN tests b ON b.test_key = a.test_key + 1 WHERE a.tag = b.tag OR a.nation = b.nation")
def _(t):
    own = t.tests()
    a, b = own.select(F.col("test_id").alias("i"), F.col("test_key").alias("k"), F.col("tags").alias("x")), own.select(F.col("test_id").alias("j"), (F.col("test_key") - 1).alias("k"), F.col("tags").alias("y"))
    return a.join(b, "k").where(F.arrays_overlap("x", "y")).select("i", "j")


@query("p23_affected_tests", sql("edges") + ", n AS (SELECT DISTINCT caller AS m FROM edges WHERE callee LIKE 'P198%') SELECT DISTINCT caller AS test_id, 2 AS depth FROM edges WHERE callee IN (SELECT m FROM n)")
def _(t):
    return workspace(t).affected_tests(t.spark.createDataFrame([(1, "diff --git a/a.cs b/a.cs\n+++ b/a.cs\n+    public void P198(int a) {\n")], "diff_id int, text string"))


@query("p18_diff_impact", sql("edges") + """, a AS (SELECT 'S1' AS m UNION SELECT caller FROM edges WHERE callee = 'S1'), b AS (SELECT m FROM a UNION SELECT caller FROM edges WHERE callee IN (SELECT m FROM a)), c AS (SELECT m FROM b UNION SELECT caller FROM edges WHERE callee IN (SELECT m FROM b))
SELECT m || 'Test' AS test_name, 0.8::DOUBLE AS confidence FROM c UNION ALL SELECT 'Stock' || 'IntegrationTest', 0.6::DOUBLE""")
def _(t):
    own = workspace(t)
    own.methods = own.methods.where("method_id = 'S1' or method_id not like 'S%'")
    return own.diff_impact(t.spark.createDataFrame([(1, "diff --git a/a.cs b/a.cs\n+++ b/a.cs\n+    public void S1(int a) {\n+  class Stock {\n")], "diff_id int, text string"))


@query("p13_plan_by_service", SELECTION.replace("FROM picked", "FROM picked WHERE plan = 'API'"))
def _(t):
    found = scoring.scored(t.tests().where("category = 'API'"), t.runs(), AS_OF, "Medium").withColumn("plan", F.col("category"))
    return rounded(scoring.select(found, "plan", "Medium", budget_ms=100_000.0, most=50), "score")


@query("p24_scored_by_facade", sql("tests", "runs") + f", {HISTORY}, {SCORED} SELECT test_id, round((0.4 * impact_score + 0.3 * time_score + 0.3 * history_score) / 1.0, 6) AS score FROM scored WHERE category = 'Unit'")
def _(t):
    own = workspace(t)
    return rounded(scoring.Scorers.standard().score(own.tests.where("category = 'Unit'").join(scoring.history.summary(own.runs, own.as_of), "test_id", "left")).select("test_id", "score"), "score")


@query("x5_added_scorer", sql("tests", "runs") + f", {HISTORY}, {SCORED} SELECT test_id, round((0.4 * impact_score + 0.3 * time_score + 0.3 * history_score + 0.5 * CASE WHEN tag = 'building' THEN 1 ELSE 0 END) / 1.5, 6) AS score FROM scored JOIN (SELECT test_id, tag FROM tests) USING (test_id)")
def _(t):
    scorers = scoring.Scorers.standard().add("segment", 0.5, lambda level: F.when(F.array_contains("tags", "building"), 1.0).otherwise(0.0))
    return rounded(scoring.scored(t.tests(), t.runs(), AS_OF, scorers=scorers).select("test_id", "score"), "score")


# Pairs and clusters


@query("j22_most_alike_pairs", sql("coverage") + f", {OVERLAP} SELECT i, j, round(jaccard, 6) AS jaccard FROM sims WHERE jaccard >= 0.05")
def _(t):
    return rounded(similarity.above(pairs(t), 0.05).select("i", "j", "jaccard"), "jaccard")


@query("j23_threshold_matrix", sql("coverage") + f", {OVERLAP} SELECT i, count(*) AS pairs, round(sum(CASE WHEN jaccard >= 0.05 THEN jaccard ELSE 0 END), 6) AS kept FROM sims GROUP BY i")
def _(t):
    return rounded(similarity.cut_off(pairs(t), 0.05).groupBy("i").agg(F.count("*").alias("pairs"), F.sum("jaccard").alias("kept")), "kept")


@query("k2_best_pair", sql("coverage") + f", {OVERLAP} SELECT i, j, round(jaccard, 6) AS jaccard FROM sims ORDER BY sims.jaccard DESC, i, j LIMIT 1")
def _(t):
    return rounded(similarity.best_pair(pairs(t)).select("i", "j", "jaccard"), "jaccard")


CLUSTERED = f"""{OVERLAP}, links AS (SELECT i, j FROM sims WHERE jaccard >= 0.06 UNION SELECT j, i FROM sims WHERE jaccard >= 0.06),
reach AS (SELECT i, j FROM links UNION SELECT reach.i, links.j FROM reach JOIN links ON links.i = reach.j), cl AS (SELECT i AS test_id, min(j) AS cluster FROM reach GROUP BY i)"""
LINKED = recursive(sql("coverage")) + f", {CLUSTERED} SELECT test_id, cluster FROM cl"
SIZES = "sz AS (SELECT cluster, count(*) AS n FROM cl GROUP BY 1), ins AS (SELECT a.cluster, sum(jaccard) AS s FROM sims JOIN cl a ON a.test_id = i JOIN cl b ON b.test_id = j WHERE a.cluster = b.cluster GROUP BY 1), coh AS (SELECT cluster, n AS size, CASE WHEN n < 2 THEN 1 ELSE coalesce(s, 0) / (n * (n - 1) / 2) END AS cohesion FROM sz LEFT JOIN ins USING (cluster))"
CLUSTER_FACTS = recursive(sql("coverage", "tests")) + f""", {CLUSTERED}, {SIZES},
bi AS (SELECT i, j, jaccard FROM sims UNION ALL SELECT j, i, jaccard FROM sims), near AS (SELECT bi.i, a.cluster AS own, b.cluster, sum(jaccard) AS s FROM bi JOIN cl a ON a.test_id = bi.i JOIN cl b ON b.test_id = bi.j GROUP BY 1, 2, 3),
m AS (SELECT i, max(CASE WHEN cluster = own AND n > 1 THEN s / (n - 1) END) AS a, max(CASE WHEN cluster <> own THEN s / n END) AS b FROM near JOIN sz USING (cluster) GROUP BY i),
sil AS (SELECT CASE WHEN greatest(coalesce(a, 0), coalesce(b, 0)) = 0 THEN NULL ELSE (coalesce(a, 0) - coalesce(b, 0)) / greatest(coalesce(a, 0), coalesce(b, 0)) END AS v FROM cl JOIN sz USING (cluster) LEFT JOIN m ON m.i = cl.test_id WHERE n > 1 AND (SELECT count(*) FROM sz) > 1),
f AS (SELECT (SELECT count(*) FROM coh) AS clusters, (SELECT coalesce(sum(size), 0)::BIGINT FROM coh) AS clustered, (SELECT coalesce(avg(cohesion), 0) FROM coh) AS cohesion, (SELECT coalesce(stddev_pop(size), 0) FROM coh) AS size_spread, (SELECT coalesce(avg(v), 0) FROM sil) AS silhouette, (SELECT count(*) FROM tests WHERE test_id NOT IN (SELECT test_id FROM cl)) AS unclustered)
SELECT clusters, clustered, round(cohesion, 6) AS cohesion, round(size_spread, 6) AS size_spread, round(silhouette, 6) AS silhouette, unclustered, CASE WHEN silhouette >= 0.7 THEN 'excellent' WHEN silhouette >= 0.5 THEN 'good' WHEN silhouette >= 0.3 THEN 'fair' ELSE 'poor' END AS quality FROM f"""


def linked(t: Tables) -> DataFrame:
    return similarity.single_linkage(pairs(t), 0.06)


@query("k4_cohesion", recursive(sql("coverage")) + f", {CLUSTERED}, {SIZES} SELECT cluster, size, round(cohesion, 6) AS cohesion FROM coh")
def _(t):
    return rounded(similarity.intra_similarity(linked(t), pairs(t)), "cohesion")


@query("k7_size_spread", recursive(sql("coverage")) + f", {CLUSTERED}, {SIZES} SELECT round(stddev_pop(n), 6) AS spread, count(*) AS clusters FROM sz")
def _(t):
    return rounded(linked(t).groupBy("cluster").agg(F.count("*").alias("n")).agg(F.stddev_pop("n").alias("spread"), F.count("*").alias("clusters")), "spread")


@query("k8_unclustered", recursive(sql("coverage", "tests")) + f", {CLUSTERED} SELECT test_id FROM tests WHERE test_id NOT IN (SELECT test_id FROM cl)")
def _(t):
    return similarity.unclustered(t.tests(), linked(t))


@query("k9_consolidations", "SELECT c_nationkey AS cluster, 0.8 + c_nationkey / 100.0 AS confidence, CASE WHEN count(*) <= 10 THEN 'Low' ELSE 'Medium' END AS effort FROM customer GROUP BY c_nationkey HAVING count(*) >= 5")
def _(t):
    sizes = t.raw("customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.count("*").alias("size")).withColumn("cohesion", 0.8 + F.col("cluster") / 100.0)
    return similarity.consolidations(sizes)


@query("k11_clusters_by_options", LINKED)
def _(t):
    return similarity.clusters(pairs(t), 0.06, "DBSCAN")


RECOMMENDED = f"""{OVERLAP}, {META}, x AS (SELECT *, 0.0::DOUBLE AS naming_sim, greatest(0, least(1, 0.3 * category_sim + 0.4 * 0.0 + 0.2 * tag_sim + 0.1 * time_sim)) AS metadata_sim FROM meta),
y AS (SELECT *, greatest(0, least(1, (0.4 * jaccard + 0.3 * metadata_sim + 0.2 * category_sim + 0.1 * naming_sim) * CASE WHEN time_sim < 0.5 THEN 0.9 ELSE 1 END)) AS surely, jaccard * 100 AS pct FROM x),
rec AS (SELECT i, j, 'Merge' AS kind, surely AS confidence FROM y WHERE pct >= 70 AND metadata_sim >= 0.6 UNION ALL SELECT i, j, 'PartialMerge', surely * 0.7 FROM y WHERE NOT (pct >= 70 AND metadata_sim >= 0.6) AND pct >= 50 AND metadata_sim >= 0.4
UNION ALL SELECT i, j, 'ExtractCommon', 4 * jaccard * (1 - jaccard) FROM y WHERE pct >= 30 AND pct < 70 UNION ALL SELECT i, j, 'MaintainSeparate', (1 - jaccard) * (1 - metadata_sim) FROM y WHERE pct < 30 OR metadata_sim < 0.3 UNION ALL SELECT i, j, 'Naming', 0.8 FROM y WHERE naming_sim < 0.3)"""


@query("r2_extract_common", sql("customer_pairs") + " SELECT i, j, round(4 * p * (1 - p), 6) AS confidence FROM customer_pairs WHERE p * 100 >= 30 AND p * 100 < 70")
def _(t):
    found = similarity.recommendations(t.customer_pairs().withColumnsRenamed({"p": "jaccard"}).withColumns({c: F.lit(0.5) for c in ("metadata_sim", "category_sim", "naming_sim", "time_sim")}))
    return rounded(found.where("kind = 'ExtractCommon'").select("i", "j", "confidence"), "confidence")


@query("r3_keep_apart", sql("customer_pairs") + " SELECT i, j, round((1 - p) * 0.5, 6) AS confidence FROM customer_pairs WHERE p * 100 < 30")
def _(t):
    found = similarity.recommendations(t.customer_pairs().withColumnsRenamed({"p": "jaccard"}).withColumns({c: F.lit(0.5) for c in ("metadata_sim", "category_sim", "naming_sim", "time_sim")}))
    return rounded(found.where("kind = 'MaintainSeparate'").select("i", "j", "confidence"), "confidence")


@query("r4_naming", sql("customer_pairs") + " SELECT i, j, 0.8::DOUBLE AS confidence FROM customer_pairs WHERE p < 0.3")
def _(t):
    own = t.customer_pairs().withColumn("naming_sim", F.col("p")).withColumnsRenamed({"p": "jaccard"}).withColumns({c: F.lit(0.5) for c in ("metadata_sim", "category_sim", "time_sim")})
    return similarity.recommendations(own).where("kind = 'Naming'").select("i", "j", "confidence")


@query("r5_merge_confidence", sql("customer_pairs") + " SELECT i, j, round(CASE WHEN p >= 0.7 THEN 1 ELSE 0.7 END * least(1, (0.4::DOUBLE * p + 0.3::DOUBLE * 0.7::DOUBLE + 0.2::DOUBLE * 0.7::DOUBLE + 0.1::DOUBLE * 0.7::DOUBLE) * CASE WHEN p < 0.75 THEN 0.9 ELSE 1 END), 4) AS confidence FROM customer_pairs WHERE p >= 0.5")
def _(t):
    own = t.customer_pairs().withColumn("time_sim", F.when(F.col("p") < 0.75, 0.4).otherwise(0.9)).withColumnsRenamed({"p": "jaccard"}).withColumns({c: F.lit(0.7) for c in ("metadata_sim", "category_sim", "naming_sim")})
    return similarity.recommendations(own).where("kind like '%Merge'").select("i", "j", F.round("confidence", 4).alias("confidence"))


@query("t5_ordered_recommendations", sql("customer_pairs") + " SELECT i, j, round((1 - p) * 0.5, 6) AS confidence, row_number() OVER (ORDER BY (1 - p) * 0.5 DESC, i, j) AS place FROM customer_pairs WHERE p * 100 < 30 AND (1 - p) * 0.5 >= 0.4")
def _(t):
    found = similarity.recommendations(t.customer_pairs().withColumnsRenamed({"p": "jaccard"}).withColumns({c: F.lit(0.5) for c in ("metadata_sim", "category_sim", "naming_sim", "time_sim")}))
    return rounded(similarity.ordered(found.where("kind = 'MaintainSeparate'"), 0.4).select("i", "j", "confidence", "place"), "confidence")


@query("f33_efforts", sql("customer_pairs") + " SELECT i, j, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 20 < 5 THEN 'Low' WHEN k % 20 < 15 THEN 'Medium' ELSE 'High' END ELSE CASE WHEN k % 40 < 10 AND p > 0.8 THEN 'Low' WHEN k % 40 < 25 AND p > 0.6 THEN 'Medium' ELSE 'High' END END AS effort FROM customer_pairs")
def _(t):
    k = F.col("k")
    return t.customer_pairs().select("i", "j", similarity.effort(F.when(k % 2 == 0, "ExtractCommon").otherwise("Merge"), k % 20, k % 40, F.col("p"), F.col("p")).alias("effort"))


@query("f31_shown_weights", f"SELECT p_partkey AS k, {cases('p_partkey', '1.38', '1.1', '0.7', '1.0', '0.805')}::DOUBLE AS weight FROM part")
def _(t):
    return rounded(t.raw("part").select(F.col("p_partkey").alias("k"), similarity.shown_weight(pick("p_partkey", "Shop.List<int>.AddAsync", "Shop.Repo..ctor", "Shop.Repo.get_Name", "Shop.Repo.Load", "Shop.set_Async")).alias("weight")), "weight")


@query("j11_path_records", recursive(sql("traces")) + f""", {NEXT}, {sequence_scores('p')}, g AS (SELECT i, j, a, b, lcs, edit, list_distinct(list_transform(range(1, len(a) - 1), lambda k: a[k] || '>' || a[k + 1] || '>' || a[k + 2])) AS ga, list_distinct(list_transform(range(1, len(b) - 1), lambda k: b[k] || '>' || b[k + 1] || '>' || b[k + 2])) AS gb FROM done)
SELECT i, j, round(0.5 * lcs + 0.3 * edit + 0.2 * CASE WHEN len(ga) + len(gb) = 0 THEN 1 WHEN len(ga) = 0 OR len(gb) = 0 THEN 0 ELSE len(list_intersect(ga, gb))::DOUBLE / len(list_distinct(ga || gb)) END, 6) AS sequential FROM g""")
def _(t):
    own = neighbours(t)
    record = paths.path_record(own.select("i", "j").withColumn("structural", F.lit(0.0)), similarity.path_similarity(own))
    return rounded(record.select("i", "j", (2 * F.col("path_sim")).alias("sequential")), "sequential")


PATHS = """x AS (SELECT l_orderkey AS k, list('S' || l_suppkey ORDER BY l_linenumber, l_suppkey) AS m FROM lineitem GROUP BY 1), p AS (SELECT a.k AS i, b.k AS j, a.m AS a, b.m AS b FROM x a JOIN x b ON b.k = a.k + 500)"""
PATH_SIMILARITY = f"""WITH RECURSIVE {PATHS}, {sequence_scores('p')}, g AS (SELECT *, list_distinct(list_transform(range(1, len(a) - 1), lambda k: a[k] || '->' || a[k + 1] || '->' || a[k + 2])) AS ga, list_distinct(list_transform(range(1, len(b) - 1), lambda k: b[k] || '->' || b[k + 1] || '->' || b[k + 2])) AS gb FROM done),
s AS (SELECT *, CASE WHEN len(ga) + len(gb) = 0 THEN 1 WHEN len(ga) = 0 OR len(gb) = 0 THEN 0 ELSE len(list_intersect(ga, gb))::DOUBLE / len(list_distinct(ga || gb)) END AS trigram FROM g)
SELECT i, j, round(lcs, 6) AS lcs, round(edit, 6) AS edit, round(trigram, 6) AS trigram, round(0.5 * lcs + 0.3 * edit + 0.2 * trigram, 6) AS sequential, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k])) AS prefix FROM s"""
DIVERGENCES = sql("traces") + """, s AS (SELECT test_id, method_id, (row_number() OVER w - 1)::INT AS p, call_depth - lag(call_depth) OVER w AS change FROM traces WINDOW w AS (PARTITION BY test_id ORDER BY seq)),
pr AS (SELECT 'O' || o_orderkey AS i, 'O' || (o_orderkey + 20) AS j FROM orders),
firsts AS (SELECT pr.i, pr.j, min(a.p) AS p FROM pr JOIN s a ON a.test_id = pr.i JOIN s b ON b.test_id = pr.j AND b.p = a.p WHERE a.method_id <> b.method_id GROUP BY 1, 2),
twins AS (SELECT test_id, method_id, change FROM (SELECT *, row_number() OVER (PARTITION BY test_id, method_id ORDER BY p) AS k FROM s WHERE abs(change) > 1) WHERE k = 1)
SELECT f.i, f.j, 'sequential' AS kind, s.method_id AS method, f.p AS position FROM firsts f JOIN s ON s.test_id = f.i AND s.p = f.p
UNION ALL SELECT pr.i, pr.j, 'conditional', a.method_id, a.p FROM pr JOIN s a ON a.test_id = pr.i AND abs(a.change) > 1 JOIN twins b ON b.test_id = pr.j AND b.method_id = a.method_id WHERE b.change <> a.change"""


@query("t10_capped_divergences", f"WITH d AS ({DIVERGENCES}) SELECT i, j, count(*) - count(*) FILTER (kind = 'conditional' AND false) AS points FROM d GROUP BY i, j HAVING count(*) < 3 UNION ALL SELECT i, j, 2 FROM d GROUP BY i, j HAVING count(*) >= 3")
def _(t):
    from impactlens.plans.path_queries import trace_pairs

    return paths.divergences(trace_pairs(t), t.traces(), most=2).groupBy("i", "j").agg(F.count("*").alias("points"))


@query("b34_conflicts_by_severity", sql("data_deps") + f", {CONFLICTS} SELECT severity, count(*) AS pairs FROM conflicts WHERE severity IN ('High', 'Medium') GROUP BY severity")
def _(t):
    return conflict.conflicts(t.data_deps()).where(F.col("severity").isin("High", "Medium")).groupBy("severity").agg(F.count("*").alias("pairs"))


@query("t7_by_confidence", sql("edges") + f" SELECT target, test_id, row_number() OVER (PARTITION BY target ORDER BY test_id) AS place FROM (SELECT DISTINCT a.callee AS target, b.caller AS test_id FROM edges a JOIN edges b ON b.callee = a.caller WHERE a.callee IN ({SMALL_PARTS}) AND b.caller LIKE 'C%')")
def _(t):
    from impactlens.operators import graph

    return graph.by_confidence(graph.tests_exercising(t.edges(), small_parts(t), t.tests())).select("target", "test_id", "place")


@query("t8_by_depth", sql("edges") + """, o AS (SELECT DISTINCT caller AS test_id, callee AS m FROM edges WHERE caller LIKE 'C%'), p AS (SELECT DISTINCT test_id, callee AS m FROM o JOIN edges ON caller = m)
SELECT test_id, depth, count(*) AS methods FROM (SELECT test_id, m, 1 AS depth FROM o UNION ALL SELECT test_id, m, 2 FROM p) GROUP BY 1, 2""")
def _(t):
    from impactlens.operators import graph

    return graph.trace(t.edges(), t.methods(), t.tests(), 3, breadth=1_000_000).groupBy("test_id", "depth").agg(F.count("*").alias("methods"))


@query("m1_snapshot", "SELECT 'doc/' || doc_id AS path, sha256(text) AS sha256 FROM documents")
def _(t):
    return changes.snapshot(t.raw("documents").select(F.concat(F.lit("doc/"), text("doc_id")).alias("path"), F.col("text").alias("content")))



# SQL of queries that are registered elsewhere.


def by_level(time: str, flaky: float) -> str:
    """Scores as above at another level: its time score, and what is left of a flaky test's history."""
    medium = f"{BASE_TIME} * CASE WHEN avg_ms > 5000 THEN 0.6::DOUBLE ELSE 1 END * {FACTOR}"
    assert medium in SCORED
    return SCORED.replace(medium, time).replace("CASE WHEN flaky THEN 0.6::DOUBLE", f"CASE WHEN flaky THEN {flaky}::DOUBLE")


def turn(name: str, candidates: str, quota: int, used: str, n: str) -> str:
    """One of the turns of the fast selection: its own candidates by score, up to a quota, with the time and places left."""
    fits = f"own < {quota} AND n < 50 AND used + avg_ms <= 100000"
    return f"""{name}_c AS (SELECT *, row_number() OVER (ORDER BY score DESC, test_id) AS k FROM {candidates}),
{name}_p AS (SELECT 0::BIGINT AS k, {used} AS used, {n} AS n, 0::BIGINT AS own, false AS taken
UNION ALL SELECT c.k, CASE WHEN {fits} THEN used + avg_ms ELSE used END, CASE WHEN {fits} THEN n + 1 ELSE n END, CASE WHEN {fits} THEN own + 1 ELSE own END, {fits} FROM {name}_p JOIN {name}_c c ON c.k = {name}_p.k + 1),
{name} AS (SELECT c.*, p.n AS place FROM {name}_c c JOIN {name}_p p USING (k) WHERE taken),
{name}_end AS (SELECT used, n FROM {name}_p ORDER BY k DESC LIMIT 1)"""


FAST = f"""{HISTORY}, {by_level(f"least(1::DOUBLE, {BASE_TIME} * CASE WHEN avg_ms > 500 THEN 0.3::DOUBLE ELSE 1.2 END * {FACTOR})", 0.3)},
final AS (SELECT *, (0.4 * impact_score + 0.3 * time_score + 0.3 * history_score) / 1.0 AS score FROM scored WHERE avg_ms <= 100000)"""
FAST_SELECTION = recursive(sql("tests", "runs")) + f""", {FAST}, {turn("one", "(SELECT * FROM final WHERE category = 'Unit' AND score >= 0.5)", 40, "0::DOUBLE", "0::BIGINT")},
{turn("two", "(SELECT * FROM final WHERE category = 'Integration' AND score >= 0.4)", 10, "(SELECT used FROM one_end)", "(SELECT n FROM one_end)")},
{turn("rest", "(SELECT * FROM final WHERE score >= 0.4 AND test_id NOT IN (SELECT test_id FROM one UNION SELECT test_id FROM two))", 50, "(SELECT used FROM two_end)", "(SELECT n FROM two_end)")}
SELECT 'all' AS plan, test_id, category, round(score, 6) AS score, avg_ms, place FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM rest)"""
HIGH_SELECTION = recursive(sql("tests", "runs")) + f""", {HISTORY}, {by_level(f"{BASE_TIME} * {FACTOR}", 0.8)}, final AS (SELECT *, 'plan' AS plan, (0.4 * impact_score + 0.3 * time_score + 0.3 * history_score) / 1.0 AS score FROM scored WHERE category <> 'Database'),
{chosen('plan', 0.2, 100, 200000)} SELECT test_id, category, round(score, 6) AS score, avg_ms, place FROM picked"""

ORACLE_SQL.update({
    "p12_fast_selection": FAST_SELECTION,
    "a20_select": HIGH_SELECTION,
    "p11_selection": SELECTION,
    "p14_batches": BATCHES,
    "p17_plan_time": PLAN_TIME,
    "k1_single_linkage": LINKED,
    "k6_cluster_statistics": CLUSTER_FACTS,
    "j9_path_similarity": PATH_SIMILARITY,
    "j12_divergences": DIVERGENCES,
    "r1_recommendations": sql("coverage", "tests") + f", {RECOMMENDED} SELECT i, j, kind, round(confidence, 6) AS confidence FROM rec",
    "t6_primary_recommendation": sql("coverage", "tests") + f", {RECOMMENDED} SELECT i, j, kind, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY confidence DESC, kind) AS k FROM rec) WHERE k = 1",
})
