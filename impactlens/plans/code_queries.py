"""Queries on source text (calls, types, tests, databases); the files are made of parts, one for each, from a template."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlens.operators import code, conflict, databases, graph, symbols
from impactlens.plans.registry import query
from impactlens.sources import projects
from impactlens.sources.adapter import Tables
from impactlens.sources.cut import dealt

#: # is the part's key, @ its type.
TEMPLATE = """using System;
namespace Shop.@
{
  public interface IStore#
  {
    void Save#(int a);
  }
  // a comment: Wrong(1);
  public class Repo# : Base, IStore#
  {
    public void Save#(int a)
    {
      var x = new Helper#(a);
      x.Run#(1);
      if (a > 1) Log.Write(a); // Not(here)
      total = Load#();
      this.Total = a;
      done += Finished;
    }
    public static int Load#()
    {
      return Store.Total;
    }
    public static int Twice(this Helper# h, int n) => Load#() * 2;
  }
  public class Helper#
  {
    public Helper#(int a) { }
    public virtual void Run#(int n)
    {
      while (n > 0) { Step(n); }
    }
  }
  [TestFixture]
  public class Repo#Tests
  {
    [SetUp]
    public void Init()
    {
      db = new ShopContext(options.UseInMemoryDatabase("mem#"));
    }
    [Test]
    [Category("Slow")]
    public void SavesRow#()
    {
      new Repo#().Save#(1);
      db.Parts.Add(row);
    }
    [TestCase(1)]
    public void Loads#(int n)
    {
      Repo#.Load#();
      db.Orders.Where(o => o.Id == n);
    }
    private void NoTest() { }
  }
}
"""


def files(t: Tables) -> DataFrame:
    """The keys are dealt out before the text is made of them: a few MB of parts become GB of text."""
    made = F.replace(F.replace(F.lit(TEMPLATE), F.lit("#"), F.col("p_partkey").cast("string")), F.lit("@"), F.initcap("p_type"))
    return dealt(t.raw("part").select("p_partkey", "p_type")).select(F.concat(F.lit("/w/f"), F.col("p_partkey").cast("string"), F.lit(".cs")).alias("path"), made.alias("content"), "p_partkey")


NS = "'Shop.' || upper(p_type[1]) || lower(p_type[2:]) || '.'"


def listed(*rows: tuple, columns: str) -> str:
    """part with the rows given, # put in; columns that begin with id get the namespace, too."""
    names = columns.split()
    values = ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in rows)
    shown = []
    for k, name in enumerate(names):
        text = isinstance(next((r[k] for r in rows if r[k] is not None), None), str)
        put = f"replace(v.{name}, '#', p_partkey::VARCHAR)" if text else f"v.{name}"
        shown.append(f"{NS + ' || ' if name.startswith('id') else ''}{put} AS {name.removeprefix('id_')}")
    return f"SELECT {', '.join(shown)} FROM part, (VALUES {values}) v({', '.join(names)})"


METHODS = [
    ("IStore#.Save#", "interface", 1, False, False, False), ("Repo#.Save#", "class", 1, False, False, False), ("Repo#.Load#", "class", 0, True, False, False), ("Repo#.Twice", "class", 2, True, False, True),
    ("Helper#.Helper#", "class", 1, False, False, False), ("Helper#.Run#", "class", 1, False, True, False), ("Repo#Tests.Init", "class", 0, False, False, False), ("Repo#Tests.SavesRow#", "class", 0, False, False, False),
    ("Repo#Tests.Loads#", "class", 1, False, False, False), ("Repo#Tests.NoTest", "class", 0, False, False, False),
]


@query("d7_declared_methods", listed(*METHODS, columns="id_method_id kind parameters static virtual extension"))
def _(t):
    return code.declared(files(t)).select("method_id", "kind", "parameters", "static", "virtual", "extension")


CALLS = [
    ("Repo#.Save#", "", "Helper#", "Constructor"), ("Repo#.Save#", "x", "Run#", "Method"), ("Repo#.Save#", "Log", "Write", "Method"), ("Repo#.Save#", "", "Load#", "Method"), ("Repo#.Save#", "this", "Total", "PropertySet"),
    ("Repo#.Save#", "", "Finished", "Delegate"), ("Repo#.Load#", "Store", "Total", "PropertyGet"), ("Helper#.Run#", "", "Step", "Method"), ("Repo#Tests.Init", "", "ShopContext", "Constructor"),
    ("Repo#Tests.Init", "options", "UseInMemoryDatabase", "Method"), ("Repo#Tests.SavesRow#", "", "Repo#", "Constructor"), ("Repo#Tests.SavesRow#", "", "Save#", "Method"), ("Repo#Tests.SavesRow#", "Parts", "Add", "Method"),
    ("Repo#Tests.Loads#", "Repo#", "Load#", "Method"), ("Repo#Tests.Loads#", "Orders", "Where", "Method"), ("Repo#Tests.Loads#", "o", "Id", "PropertyGet"),
]


@query("d11_calls", listed(*CALLS, columns="id_caller qualifier callee kind"))
def _(t):
    return code.calls(files(t)).select("caller", "qualifier", "callee", "kind")


RESOLVED = [
    ("Repo#.Save#", "Helper#.Helper#", "Direct"), ("Repo#.Save#", "Helper#.Run#", "Virtual"), ("Repo#.Save#", "Repo#.Load#", "Static"), ("Repo#Tests.SavesRow#", "Repo#.Save#", "Direct"),
    ("Repo#Tests.SavesRow#", "IStore#.Save#", "Interface"), ("Repo#Tests.Loads#", "Repo#.Load#", "Static"),
]


@query("d16_call_types", listed(*RESOLVED, columns="id_caller id_callee_id call_type"))
def _(t):
    own = files(t)
    return code.resolved(code.calls(own), code.declared(own)).select("caller", "callee_id", "call_type")


@query("c25_overrides", listed(("IStore#.Save#", "Repo#.Save#"), columns="id_base id_impl"))
def _(t):
    return code.overrides(files(t))


BOTH = [(a, b) for a, b, _ in RESOLVED] + [("IStore#.Save#", "Repo#.Save#"), ("Repo#.Save#", "IStore#.Save#")]


@query("d12_polymorphic_graph", listed(*BOTH, columns="id_caller id_callee"))
def _(t):
    return code.call_graph(files(t))


@query("g2_tests_of_code", listed(("Repo#.Load#", "Repo#Tests.Loads#", 1), ("Repo#.Load#", "Repo#Tests.SavesRow#", 2), columns="id_target id_test_id depth"))
def _(t):
    """From source text to the tests of a method: calls are extracted, tests discovered, and the graph searched."""
    own = files(t)
    targets = code.declared(own).where("name like 'Load%'").select("method_id")
    return graph.tests_exercising(code.call_graph(own), targets, code.discovered(own)).select("target", "test_id", "depth")


def used() -> list[tuple]:
    """Where the template names its types."""
    lines = [re.sub(r"//.*", "", x) for x in TEMPLATE.split("\n")]
    return [(name, n, bool(re.search(rf"(class|interface) {name}(?!\w)", x))) for name in ("IStore#", "Repo#", "Helper#", "Repo#Tests") for n, x in enumerate(lines, 1) if re.search(rf"\b{name}(?!\w)", x)]


@query("d10_type_usage", listed(*used(), columns="type line declares"))
def _(t):
    return code.type_usage(files(t)).select("type", "line", "declares")


@query("d9_scoped_index", "SELECT 'Repo' || p_partkey AS symbol, '/w/f' || p_partkey || '.cs' AS path FROM part WHERE p_size = 1")
def _(t):
    scope = t.raw("part").where("p_size = 1").select(F.concat(F.lit("/w/f"), F.col("p_partkey").cast("string"), F.lit(".cs")).alias("path"))
    return symbols.scoped(files(t), scope).where("kind = 'type' and symbol rlike '^Repo[0-9]+$'").select("symbol", "path")


# Tests


@query("a7_discovered_tests", listed(("Repo#Tests.SavesRow#", "Repo#Tests", "Slow", ""), ("Repo#Tests.Loads#", "Repo#Tests", "", "1"), columns="id_test_id id_fixture categories cases"))
def _(t):
    return code.discovered(files(t)).select("test_id", "fixture", F.array_join("categories", ",").alias("categories"), F.array_join("cases", ",").alias("cases"))


def some_empty(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 7
    return files(t).withColumn("content", F.when(k == 0, None).when(k == 1, "class Plain { }").otherwise(F.col("content")))


@query("a8_discovery_results", "SELECT '/w/f' || p_partkey || '.cs' AS path, CASE WHEN p_partkey % 7 < 2 THEN 0 ELSE 1 END::BIGINT AS fixtures, CASE WHEN p_partkey % 7 < 2 THEN 0 ELSE 2 END::BIGINT AS tests, CASE WHEN p_partkey % 7 = 0 THEN 'no content' END AS error FROM part")
def _(t):
    return code.discovery_results(some_empty(t))


@query("e17_analysis_summary", "SELECT count(*) AS files, count(*) FILTER (p_partkey % 7 > 0) AS read, count(*) FILTER (p_partkey % 7 = 0) AS failed, count(*) FILTER (p_partkey % 7 > 1) AS fixtures, 2 * count(*) FILTER (p_partkey % 7 > 1) AS tests FROM part")
def _(t):
    return code.discovery_summary(code.discovery_results(some_empty(t)))


@query("e21_discovery_summary", "SELECT 'Slow' AS category, count(*) AS tests, count(*) AS fixtures FROM part UNION ALL SELECT 'none', count(*), count(*) FROM part")
def _(t):
    found = code.discovered(files(t)).withColumn("category", F.explode(F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit("none")))))
    return found.groupBy("category").agg(F.count("*").alias("tests"), F.count_distinct("fixture").alias("fixtures"))


@query("e33_tests_by_fixture", "SELECT '/w/f' || p_partkey || '.cs' AS path, 2::BIGINT AS tests, 1::BIGINT AS setups FROM part")
def _(t):
    return code.fixtures(files(t)).select("path", "tests", "setups")


def rules(t: Tables) -> DataFrame:
    pick = lambda *w: F.element_at(F.array(*(F.lit(x) for x in w)), (F.col("p_partkey") % len(w) + 1).cast("int"))
    return t.raw("part").select(F.col("p_partkey").alias("k"), F.array(pick("Fact", "Obsolete", "Obsolete", "Obsolete", "Obsolete")).alias("a"), pick("Load", "RunTests", "Load", "ShouldRun", "Load").alias("n"), pick("Shop", "Shop", "ShopTest", "Shop", "Shop").alias("c"), pick("/src/a.cs", "/src/a.cs", "/src/a.cs", "/test/a.cs", "/test/a.cs").alias("p"))


@query("b24_three_test_rules", "SELECT p_partkey AS k, p_partkey % 5 IN (0, 1, 2) AS graph, p_partkey % 5 IN (0, 1) AS incremental, p_partkey % 5 IN (0, 3) AS source FROM part")
def _(t):
    own = lambda rule: code.is_test(F.col("a"), F.col("n"), F.col("c"), F.col("p"), rule).alias(rule)
    return rules(t).select("k", own("graph"), own("incremental"), own("source"))


@query("a22_loaded_assemblies", """SELECT '/out/' || CASE p_partkey % 6 WHEN 0 THEN 'net8.0' WHEN 1 THEN 'net48' WHEN 2 THEN 'netstandard2.0' WHEN 3 THEN 'netcoreapp3.1' ELSE 'x' END || '/a' || p_partkey || '.dll' AS path,
CASE p_partkey % 6 WHEN 0 THEN 'net8.0' WHEN 1 THEN 'net48' WHEN 2 THEN 'netstandard2.0' WHEN 3 THEN 'netcoreapp3.1' WHEN 4 THEN 'net6.0' ELSE 'Unknown' END AS framework,
CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CASE p_partkey % 6 WHEN 0 THEN 'Net5Plus' WHEN 1 THEN 'Framework48' WHEN 2 THEN 'Standard' WHEN 3 THEN 'NetCore' WHEN 4 THEN 'Net5Plus' END END AS loader,
CASE WHEN p_partkey % 11 = 0 THEN 'not found: /out/' || CASE p_partkey % 6 WHEN 0 THEN 'net8.0' WHEN 1 THEN 'net48' WHEN 2 THEN 'netstandard2.0' WHEN 3 THEN 'netcoreapp3.1' ELSE 'x' END || '/a' || p_partkey || '.dll' WHEN p_partkey % 6 = 5 THEN 'no loader for Unknown' END AS error FROM part""")
def _(t):
    k = F.col("p_partkey")
    folder = F.element_at(F.array(*(F.lit(x) for x in ("net8.0", "net48", "netstandard2.0", "netcoreapp3.1", "x", "x"))), (k % 6 + 1).cast("int"))
    path = F.concat(F.lit("/out/"), folder, F.lit("/a"), k.cast("string"), F.lit(".dll"))
    return projects.loads(t.raw("part").select(path.alias("path"), (k % 11 != 0).alias("exists"), F.lit("").alias("metadata"), F.when(k % 6 == 4, "net6.0").alias("references")))


@query("a10_frameworks", "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'net8.0' WHEN 1 THEN 'net6.0' WHEN 2 THEN 'net48' ELSE 'Unknown' END AS framework FROM part")
def _(t):
    k = F.col("p_partkey")
    found = projects.framework_version(F.when(k % 4 == 0, "net8.0").otherwise(" "), F.when(k % 4 < 2, "net6.0"), F.when(k % 4 < 3, "net48").otherwise(""))
    return t.raw("part").select(k.alias("k"), found.alias("framework"))


# Databases


def sources(t: Tables) -> DataFrame:
    """A test for each part, whose source uses one of two contexts or a database in memory that three parts share."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, "using var db = new ShopContext();\ndb.Parts.Add(p);\ndb.SaveChanges();").when(k % 3 == 1, F.concat(F.lit('o.UseInMemoryDatabase("m'), F.floor(k / 9).cast("string"), F.lit('");'))).otherwise("var x = 1;")
    return t.raw("part").select(F.concat(F.lit("T"), k.cast("string")).alias("test_id"), text.alias("source"), k.alias("k"))


DETECTED = """found AS (SELECT 'T' || p_partkey AS test_id, 'Database' AS kind, 'EFCore:ShopContext' AS resource_id, 'Create' AS access, 'Parts' AS entity, p_partkey AS k FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'T' || p_partkey, 'Database', 'EFCore:InMemory:m' || (p_partkey // 9), 'ReadWrite', NULL, p_partkey FROM part WHERE p_partkey % 3 = 1)"""


@query("d13_database_operations", f"WITH {DETECTED} SELECT test_id, kind, resource_id, access, entity FROM found")
def _(t):
    return databases.Detectors().detect(sources(t))


@query("x7_added_detector", f"WITH {DETECTED} SELECT test_id, resource_id FROM found UNION ALL SELECT 'T' || p_partkey, 'File:none' FROM part WHERE p_partkey % 3 = 2")
def _(t):
    plain = lambda tests: tests.where(~F.col("source").rlike("Context|Database")).select("test_id", F.lit("File").alias("kind"), F.lit("File:none").alias("resource_id"), F.lit("Read").alias("access"), F.lit(None).cast("string").alias("entity"))
    return databases.Detectors().add("plain", plain).detect(sources(t)).select("test_id", "resource_id")


@query("h7_shared_databases", f"WITH {DETECTED} SELECT a.test_id AS i, b.test_id AS j FROM found a JOIN found b ON a.resource_id = b.resource_id AND a.test_id < b.test_id WHERE a.entity IS NULL")
def _(t):
    """Among the tests with a database in memory; the other context is everybody's."""
    return databases.sharing(databases.in_memory(sources(t)))


@query("h7_pairs_that_share", "SELECT 'T' || p_partkey AS i, 'T' || (p_partkey + 3) AS j, p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_partkey // 9 = (p_partkey + 3) // 9) AS shares FROM part WHERE p_partkey + 3 <= (SELECT max(p_partkey) FROM part)")
def _(t):
    own = sources(t)
    most = own.agg(F.max("k").alias("most"))
    pairs = own.crossJoin(most).where("k + 3 <= most").select(F.col("test_id").alias("i"), F.concat(F.lit("T"), (F.col("k") + 3).cast("string")).alias("j"))  # one row
    return databases.shares(pairs, databases.Detectors().detect(own))


@query("h8_exclusive_by_source", f"WITH {DETECTED} SELECT test_id, resource_id NOT LIKE '%InMemory%' AS exclusive FROM found")
def _(t):
    found = databases.Detectors().detect(sources(t)).withColumn("access", F.when(F.col("access") == "Create", "Write").otherwise(F.col("access")))
    return conflict.exclusive(found)
