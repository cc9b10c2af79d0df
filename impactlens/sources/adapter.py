"""The logical tables (methods, edges, tests, test_runs, coverage, data_deps, snapshots) derived from the star schema.

Customers stand for tests, orders, parts, suppliers, nations and regions for production methods, and foreign keys for
calls; events are test runs. Every derivation is a plain projection, so filters and pruning reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scores look back from here; nothing reads the clock.
AS_OF = "2024-01-31 00:00:00"
CATEGORY_BY_SEGMENT = {"AUTOMOBILE": "Unit", "BUILDING": "Integration", "FURNITURE": "Database", "HOUSEHOLD": "API", "MACHINERY": "EndToEnd"}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def edges(self) -> DataFrame:
        def pairs(table, a, caller, b, callee):
            return self.raw(table).select(F.concat(F.lit(a), F.col(caller).cast("string")).alias("caller"), F.concat(F.lit(b), F.col(callee).cast("string")).alias("callee"))

        found = pairs("orders", "C", "o_custkey", "O", "o_orderkey")
        for more in (pairs("lineitem", "O", "l_orderkey", "P", "l_partkey"), pairs("lineitem", "P", "l_partkey", "S", "l_suppkey"), pairs("supplier", "S", "s_suppkey", "N", "s_nationkey"), pairs("nation", "N", "n_nationkey", "R", "n_regionkey")):
            found = found.unionByName(more)
        return found.distinct()

    def methods(self) -> DataFrame:
        def vertices(table, letter, key, name, kind, test):
            return self.raw(table).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("method_id"), name.alias("name"), F.lit(kind).alias("containing_type"), F.lit(f"/{'tests' if test else 'src'}/{kind}.cs").alias("file_path"), F.lit(test).alias("is_test"))

        found = vertices("customer", "C", "c_custkey", F.col("c_name"), "CustomerTests", True)
        for more in (
            vertices("orders", "O", "o_orderkey", F.col("o_orderpriority"), "OrderService", False),
            vertices("part", "P", "p_partkey", F.col("p_name"), "PartRepository", False),
            vertices("supplier", "S", "s_suppkey", F.col("s_name"), "SupplierFactory", False),
            vertices("nation", "N", "n_nationkey", F.col("n_name"), "Nation", False),
            vertices("region", "R", "r_regionkey", F.col("r_name"), "Region", False),
        ):
            found = found.unionByName(more)
        return found

    def tests(self) -> DataFrame:
        category = F.lit("Unit")
        for segment, kind in CATEGORY_BY_SEGMENT.items():
            category = F.when(F.col("c_mktsegment") == segment, kind).otherwise(category)
        return self.raw("customer").select(
            F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("test_id"), F.col("c_custkey").alias("test_key"), F.col("c_name").alias("name"), category.alias("category"),
            F.abs("c_acctbal").alias("avg_ms"), F.array(F.lower("c_mktsegment"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))).alias("tags"),
        )

    def runs(self) -> DataFrame:
        return self.raw("events").select(F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("test_id"), F.col("event_id").alias("run_id"), (F.col("event_type") != "error").alias("passed"), F.col("value").alias("duration_ms"), F.col("ts").alias("executed_at"))

    def coverage(self) -> DataFrame:
        """test_id, method_id: which parts a customer's orders hold; depth 2 in the call graph."""
        orders, lines = self.raw("orders"), self.raw("lineitem")
        joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
        return joined.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("test_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("method_id")).distinct()

    def data_deps(self) -> DataFrame:
        """A line's stock (a part at a supplier) is the resource that its order's test uses, the part the entity; what it
        does there goes by the flags."""
        access = F.when(F.col("l_returnflag") == "R", "Write").when(F.col("l_linestatus") == "O", "ReadWrite").otherwise("Read")
        return self.raw("lineitem").select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("test_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit("/P"), F.col("l_partkey").cast("string")).alias("resource_id"), access.alias("access"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("entity")).distinct()

    def traces(self) -> DataFrame:
        """What the orders' tests executed, in the order of their lines: test_id, seq, method_id, call_depth, category, is_production."""
        lines = self.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
        category = F.when(F.col("f") == "R", "Framework").otherwise("BusinessLogic")
        return lines.select(
            F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("test_id"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("S"), (F.col("s") % 5).cast("string")).alias("method_id"),
            (F.col("q") % 5).cast("int").alias("call_depth"), category.alias("category"), (category != "Framework").alias("is_production"),
        )

    def customer_pairs(self) -> DataFrame:
        """i, j, k, p: each customer with the next one, and a number in [0, 1]."""
        k = F.col("c_custkey")
        name = lambda x: F.concat(F.lit("C"), x.cast("string"))
        return self.raw("customer").select(name(k).alias("i"), name(k + 1).alias("j"), k.alias("k"), (k % 67 / 67.0).alias("p"))

    def snapshots(self) -> tuple[DataFrame, DataFrame]:
        """Two states of a tree of files: in the second, some are gone, some are new and some have changed."""
        files = self.raw("documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("n"))
        old = files.where("n % 11 != 0").select("path", "sha256")
        new = files.where("n % 13 != 0").select("path", F.when(F.col("n") % 10 == 0, F.sha2(F.concat("sha256", F.lit("edited")), 256)).otherwise(F.col("sha256")).alias("sha256"))
        return old, new


#: The same derivations for DuckDB, as common table expressions.
SQL = {
    "edges": """SELECT 'C' || o_custkey AS caller, 'O' || o_orderkey AS callee FROM orders
        UNION SELECT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem UNION SELECT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem
        UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation""",
    "methods": """SELECT 'C' || c_custkey AS method_id, c_name AS name, 'CustomerTests' AS containing_type, '/tests/CustomerTests.cs' AS file_path, true AS is_test FROM customer
        UNION ALL SELECT 'O' || o_orderkey, o_orderpriority, 'OrderService', '/src/OrderService.cs', false FROM orders
        UNION ALL SELECT 'P' || p_partkey, p_name, 'PartRepository', '/src/PartRepository.cs', false FROM part
        UNION ALL SELECT 'S' || s_suppkey, s_name, 'SupplierFactory', '/src/SupplierFactory.cs', false FROM supplier
        UNION ALL SELECT 'N' || n_nationkey, n_name, 'Nation', '/src/Nation.cs', false FROM nation
        UNION ALL SELECT 'R' || r_regionkey, r_name, 'Region', '/src/Region.cs', false FROM region""",
    "tests": """SELECT 'C' || c_custkey AS test_id, c_custkey AS test_key, c_name AS name,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Unit' WHEN 'BUILDING' THEN 'Integration' WHEN 'FURNITURE' THEN 'Database'
          WHEN 'HOUSEHOLD' THEN 'API' WHEN 'MACHINERY' THEN 'EndToEnd' ELSE 'Unit' END AS category,
        abs(c_acctbal) AS avg_ms, lower(c_mktsegment) AS tag, c_nationkey AS nation FROM customer""",
    "runs": """SELECT 'C' || user_id AS test_id, event_id AS run_id, event_type <> 'error' AS passed, value AS duration_ms, ts AS executed_at FROM events""",
    "coverage": """SELECT DISTINCT 'C' || o_custkey AS test_id, 'P' || l_partkey AS method_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "data_deps": """SELECT DISTINCT 'O' || l_orderkey AS test_id, 'S' || l_suppkey || '/P' || l_partkey AS resource_id,
        CASE WHEN l_returnflag = 'R' THEN 'Write' WHEN l_linestatus = 'O' THEN 'ReadWrite' ELSE 'Read' END AS access, 'P' || l_partkey AS entity
        FROM lineitem""",
    "customer_pairs": "SELECT 'C' || c_custkey AS i, 'C' || (c_custkey + 1) AS j, c_custkey AS k, (c_custkey % 67) / 67.0::DOUBLE AS p FROM customer",
    "traces": """SELECT 'O' || l_orderkey AS test_id, l_linenumber AS seq, 'S' || (min(l_suppkey) % 5) AS method_id, (min(l_quantity) % 5)::INT AS call_depth,
        CASE WHEN min(l_returnflag) = 'R' THEN 'Framework' ELSE 'BusinessLogic' END AS category, min(l_returnflag) <> 'R' AS is_production
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
}


def sql(*names: str) -> str:
    """WITH clause of the named tables, ready to be followed by more expressions or a SELECT."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
