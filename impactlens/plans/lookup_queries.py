"""Queries that find tests and methods by what a user gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlens.operators import history, lookups
from impactlens.plans.project_queries import asked
from impactlens.plans.registry import query
from impactlens.sources.adapter import AS_OF, Tables, sql

IDS = "SELECT 'Shop.' || c_mktsegment || 'Tests.Run' || c_custkey AS test_id, c_name AS test_name FROM customer"


def ids(t: Tables) -> DataFrame:
    return t.raw("customer").select(F.concat(F.lit("Shop."), "c_mktsegment", F.lit("Tests.Run"), F.col("c_custkey").cast("string")).alias("test_id"), F.col("c_name").alias("test_name"))


GIVEN = ("run17", "BUILDINGTests.Run33", "customer#000000042", "Shop.MACHINERYTests.Run8", "un17", "Tests.Run5")


@query("c9_provided_tests", f"""WITH g AS (SELECT lower(unnest({list(GIVEN)!r})) AS given), i AS ({IDS})
SELECT DISTINCT test_id FROM i JOIN g ON lower(test_id) = given OR ends_with(lower(test_id), '.' || given) OR lower(test_name) = given""")
def _(t):
    return lookups.provided(ids(t), asked(t, *GIVEN)).select("test_id")


@query("c8_candidate_tests", sql("coverage") + " SELECT test_id, method_id FROM coverage WHERE test_id IN ('C1', 'C22', 'C333')")
def _(t):
    return lookups.among(t.coverage(), t.spark.createDataFrame([("c1",), ("C22",), ("c333",)], "test_id string"))


METHODS = "m AS (SELECT 'Shop.' || p_type || 'Repo.Load' || p_size || '(System.Int32,Shop.' || p_type || ')' AS method_id, 'T' || p_partkey AS test_id FROM part)"


def method_coverage(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    return t.raw("part").select(F.concat(F.lit("Shop."), "p_type", F.lit("Repo.Load"), size, F.lit("(System.Int32,Shop."), "p_type", F.lit(")")).alias("method_id"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("test_id"))


@query("c10_tests_by_pattern", f"""WITH {METHODS} SELECT 'Load7' AS pattern, method_id, test_id FROM m WHERE contains(method_id, '.Load7(') UNION SELECT 'MOTORepo.Load8', method_id, test_id FROM m WHERE false
UNION SELECT 'PROMORepo.Load9', method_id, test_id FROM m WHERE contains(method_id, '.PROMORepo.Load9(') UNION SELECT 'MORepo.Load9(Int32,PROMO)', method_id, test_id FROM m WHERE contains(method_id, '.PROMORepo.Load9(')
UNION SELECT 'Shop.SMALLRepo.Load3(System.Int32,Shop.SMALL)', method_id, test_id FROM m WHERE method_id = 'Shop.SMALLRepo.Load3(System.Int32,Shop.SMALL)'""")
def _(t):
    patterns = ("Load7", "MOTORepo.Load8", "PROMORepo.Load9", "MORepo.Load9(Int32,PROMO)", "Load9(Int32)", "Shop.SMALLRepo.Load3(System.Int32,Shop.SMALL)")
    return lookups.by_pattern(method_coverage(t), t.spark.createDataFrame([(p,) for p in patterns], "pattern string"))


@query("c11_changed_methods", f"WITH {METHODS}, g AS (SELECT unnest(['load4', 'PromoRepo', 'none']) AS given) SELECT DISTINCT given, method_id FROM m JOIN g ON contains(lower(method_id), lower(given))")
def _(t):
    return lookups.changed_methods(method_coverage(t), asked(t, "load4", "PromoRepo", "none", ""))


@query("c24_validated_tests", f"WITH g AS (SELECT unnest({list(GIVEN)!r}) AS given) SELECT given, given = 'Shop.MACHINERYTests.Run8' AND EXISTS (SELECT 1 FROM ({IDS}) WHERE test_id = 'Shop.MACHINERYTests.Run8') AS valid FROM g")
def _(t):
    return lookups.validated(asked(t, *GIVEN), ids(t))


WRONG = ("Customer#00000004x", "Custmer#000000017", "NATION", "Customer#0000000100")


@query("t3_suggestions", f"""WITH g AS (SELECT unnest({list(WRONG)!r}) AS given), d AS (SELECT given, c_name AS test_id, levenshtein(given, c_name)::INT AS distance FROM g, customer)
SELECT given, test_id, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY given ORDER BY distance, length(test_id), test_id)::INT AS place FROM d WHERE distance <= greatest(3, length(given) // 3)) WHERE place <= 5""")
def _(t):
    return lookups.suggestions(asked(t, *WRONG), t.raw("customer").select(F.col("c_name").alias("test_id")))


@query("b1_wanted_tests", sql("tests") + " SELECT test_id FROM tests WHERE category <> 'Database' AND category IN ('Unit', 'API', 'Database') AND (nation IN (1, 2, 3) OR tag = 'household') AND nation <> 7")
def _(t):
    return t.tests().where(lookups.wanted_tests(["Unit", "API", "Database"], ["Database"], ["nation1", "nation2", "nation3", "household"], ["nation7"])).select("test_id")


@query("b1_steady_tests", sql("tests", "runs") + """, h AS (SELECT test_id, count(*) AS n, count(*) FILTER (NOT passed) AS f FROM runs GROUP BY test_id)
SELECT test_id FROM tests LEFT JOIN h USING (test_id) WHERE NOT coalesce(n >= 5 AND f::DOUBLE / n > 0.1 AND f::DOUBLE / n < 0.9, false)""")
def _(t):
    known = t.tests().join(history.summary(t.runs(), AS_OF), "test_id", "left")
    return known.where(lookups.wanted_tests(flaky=history.is_flaky())).select("test_id")


@query("b3_history_search", sql("tests") + " SELECT test_id FROM tests WHERE contains(lower(test_id), 'c12') OR contains(lower(name), 'er#0000003')")
def _(t):
    found = lookups.search(t.tests(), "C12").select("test_id").unionByName(lookups.search(t.tests(), "ER#0000003").select("test_id"))
    return found.distinct()


@query("j26_methods_of_test", sql("coverage") + " SELECT method_id FROM coverage WHERE test_id = 'C7'")
def _(t):
    return lookups.among(t.coverage(), t.spark.createDataFrame([("c7",)], "test_id string")).select("method_id").distinct()
