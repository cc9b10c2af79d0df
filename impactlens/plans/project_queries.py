"""Queries on solutions, projects, files, symbols and attributes; the files are made of nations and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens.functions import attributes
from impactlens.operators import symbols
from impactlens.plans.registry import query
from impactlens.sources import projects
from impactlens.sources.adapter import Tables


def text(c: str) -> Column:
    return F.col(c).cast("string")


def solutions(t: Tables) -> DataFrame:
    kind = F.when(F.col("n_nationkey") % 5 == 0, ".vbproj").otherwise(".csproj")
    line = F.concat(F.lit('Project("{FAE04EC0-301F-11D3-BF4B-00C04F79EFBC}") = "'), F.col("n_name"), F.lit('", "src\\..\\code\\'), F.col("n_name"), kind, F.lit('", "{00000000-0000-0000-0000-'), F.lpad(text("n_nationkey"), 12, "0"), F.lit('}"\r\nEndProject'))
    made = t.raw("nation").groupBy(F.concat(F.lit("/w/r"), text("n_regionkey"), F.lit("/all.sln")).alias("path")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    return made.withColumn("content", F.concat(F.lit("Microsoft Visual Studio Solution File\r\n"), "content", F.lit("\nGlobal")))


@query("a1_solution_projects", """SELECT '/w/r' || n_regionkey || '/all.sln' AS solution, n_name AS name, '/w/r' || n_regionkey || '/code/' || n_name || '.csproj' AS path,
'00000000-0000-0000-0000-' || lpad(n_nationkey::VARCHAR, 12, '0') AS guid FROM nation WHERE n_nationkey % 5 <> 0""")
def _(t):
    return projects.solution_projects(solutions(t))


def project_files(t: Tables) -> DataFrame:
    n = text("n_nationkey")
    framework = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("<TargetFramework>net"), n, F.lit(".0</TargetFramework>"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("<TargetFrameworks>net"), n, F.lit(".0;net48</TargetFrameworks>"))).otherwise("")
    body = F.concat(
        F.lit('<Project Sdk="Microsoft.NET.Sdk">\n<PropertyGroup>'), framework, F.lit('</PropertyGroup><ItemGroup>\n<!-- <PackageReference Include="Gone" Version="1"/> -->\n<PackageReference Include="NUnit" Version="3.'), n,
        F.lit('" />\n<PackageReference Include="Other"><Version>2.'), n, F.lit("</Version></PackageReference>\n<PackageReference Include='Bare' />\n"),
        F.lit('<ProjectReference Include="..\\NATION_'), (F.col("n_nationkey") + 1).cast("string"), F.lit("\\p.csproj\" />\n<Reference Include=\"System.Xml\" /></ItemGroup></Project>"),
    )
    return t.raw("nation").select(F.concat(F.lit("/w/"), "n_name", F.lit("/p.csproj")).alias("path"), body.alias("content"))


@query("a3_project_details", """SELECT '/w/' || n_name || '/p.csproj' AS path, CASE WHEN n_nationkey % 3 = 2 THEN 'net8.0' ELSE 'net' || n_nationkey || '.0' END AS target_framework, '/w/NATION_' || (n_nationkey + 1) || '/p.csproj' AS refs,
'NUnit 3.' || n_nationkey || ',Other 2.' || n_nationkey || ',Bare latest' AS packages, 'System.Xml' AS assemblies FROM nation""")
def _(t):
    packages = F.array_join(F.transform("packages", lambda p: F.concat_ws(" ", p["name"], p["version"])), ",")
    return projects.project_details(project_files(t)).select("path", "target_framework", F.array_join("project_refs", ",").alias("refs"), packages.alias("packages"), F.array_join("assembly_refs", ",").alias("assemblies"))


@query("g9_project_graph", "SELECT '/w/' || a.n_name || '/p.csproj' AS caller, '/w/' || b.n_name || '/p.csproj' AS callee FROM nation a JOIN nation b ON b.n_name = 'NATION_' || (a.n_nationkey + 1)")
def _(t):
    return projects.project_edges(projects.project_details(project_files(t)))


def paths(t: Tables) -> DataFrame:
    folder = F.element_at(F.array(*(F.lit(x) for x in ("src", "obj", "bin", "objects"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.raw("part").select("p_partkey", F.concat(F.lit("/w/"), "p_brand", F.lit("/"), folder, F.lit("/File"), text("p_partkey"), F.when(F.col("p_partkey") % 6 == 0, ".txt").otherwise(".cs")).alias("path"))


@query("a5_source_files", """WITH f AS (SELECT p_partkey, '/w/' || p_brand || '/' || CASE p_partkey % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'obj' WHEN 2 THEN 'bin' ELSE 'objects' END || '/File' || p_partkey || '.cs' AS path FROM part WHERE p_partkey % 6 <> 0)
SELECT path, p_partkey % 4 = 0 AS indexed FROM f WHERE p_partkey % 4 IN (0, 3)""")
def _(t):
    files = paths(t)
    indexed = projects.source_files(files, whole_parts=False).select("path", F.lit(True).alias("indexed"))
    return projects.source_files(files).select("path").join(indexed, "path", "left").select("path", F.coalesce("indexed", F.lit(False)).alias("indexed"))


@query("c21_project_of_files", """SELECT '/w/' || p_brand || '/' || CASE p_partkey % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'obj' WHEN 2 THEN 'bin' ELSE 'objects' END || '/File' || p_partkey || CASE WHEN p_partkey % 6 = 0 THEN '.txt' ELSE '.cs' END AS path,
'/w/' || p_brand || CASE WHEN p_partkey % 4 = 0 THEN '/src' ELSE '' END || '/p.csproj' AS project FROM part""")
def _(t):
    brands = t.raw("part").select(F.explode(F.array(F.concat(F.lit("/w/"), "p_brand", F.lit("/p.csproj")), F.concat(F.lit("/w/"), "p_brand", F.lit("/src/p.csproj")))).alias("path")).distinct()
    return projects.project_of_files(paths(t).select("path"), brands)


@query("a9_test_assemblies", """WITH f AS (SELECT DISTINCT '/out/' || CASE WHEN p_partkey % 2 = 0 THEN 'Release' ELSE 'Debug' END || '/' || CASE WHEN p_size > 25 THEN upper(p_type) ELSE lower(p_type) END || CASE WHEN p_partkey % 3 = 0 THEN '.Specs' WHEN p_partkey % 3 = 1 THEN '.Tests' ELSE '.Core' END || '.dll' AS path FROM part)
SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY lower(regexp_extract(path, '([^/]*)$', 1)) ORDER BY contains(path, 'Release'), path) AS k FROM f WHERE NOT contains(path, '.Core')) WHERE k = 1""")
def _(t):
    side = F.when(F.col("p_partkey") % 2 == 0, "Release").otherwise("Debug")
    kind = F.when(F.col("p_partkey") % 3 == 0, ".Specs").when(F.col("p_partkey") % 3 == 1, ".Tests").otherwise(".Core")
    return projects.test_assemblies(t.raw("part").select(F.concat(F.lit("/out/"), side, F.lit("/"), F.when(F.col("p_size") > 25, F.upper("p_type")).otherwise(F.lower("p_type")), kind, F.lit(".dll")).alias("path")).distinct())


NAMED = "f AS (SELECT p_partkey, '/w/' || replace(p_name, ' ', '_') || CASE p_partkey % 8 WHEN 0 THEN '.Orm' WHEN 1 THEN '.Sql' WHEN 2 THEN '.Migrations' WHEN 3 THEN '.Integration' WHEN 4 THEN '.WebApi' WHEN 5 THEN '.Client' WHEN 6 THEN '.Tests' ELSE '' END || '/' || p_partkey || CASE p_partkey % 8 WHEN 0 THEN '.Orm' WHEN 1 THEN '.Sql' WHEN 2 THEN '.Migrations' WHEN 3 THEN '.Integration' WHEN 4 THEN '.Api' WHEN 5 THEN '.Client' WHEN 6 THEN '.Tests' ELSE '' END || '.csproj' AS path FROM part)"
KIND = "CASE p_partkey % 8 WHEN 0 THEN 'orm' WHEN 1 THEN 'database' WHEN 2 THEN 'migration' WHEN 3 THEN 'integration' WHEN 4 THEN 'api' WHEN 5 THEN 'ui' END"


def named_projects(t: Tables) -> DataFrame:
    words = lambda *w: F.element_at(F.array(*(F.lit(x) for x in w)), (F.col("p_partkey") % 8 + 1).cast("int"))
    folder = F.concat(F.lit("/w/"), F.replace("p_name", F.lit(" "), F.lit("_")), words(".Orm", ".Sql", ".Migrations", ".Integration", ".WebApi", ".Client", ".Tests", ""))
    content = F.when(F.col("p_partkey") % 16 == 15, '<PackageReference Include="XUnit" />').otherwise("<Project />")
    return t.raw("part").select(F.concat(folder, F.lit("/"), text("p_partkey"), words(".Orm", ".Sql", ".Migrations", ".Integration", ".Api", ".Client", ".Tests", ""), F.lit(".csproj")).alias("path"), content.alias("content"))


#: In a pattern with *, a dot is any character: everything with a bolt goes.
RULES = projects.Config(include=["/w/*"], exclude=["*BOLT.*", "red_"], exclude_types=["orm", "UI"])


@query("b4_filtered_projects", f"WITH {NAMED} SELECT path FROM f WHERE NOT contains(path, 'bolt') AND NOT contains(path, 'red_') AND p_partkey % 8 NOT IN (0, 5)")
def _(t):
    return projects.filter_projects(named_projects(t), RULES).select("path")


@query("b8_explained_projects", f"""WITH {NAMED} SELECT path, {KIND} AS kind, p_partkey % 8 = 6 OR p_partkey % 16 = 15 AS is_test,
CASE WHEN contains(path, 'bolt') THEN 'exclude *BOLT.*' WHEN contains(path, 'red_') THEN 'exclude red_' WHEN p_partkey % 8 = 0 THEN 'type orm' WHEN p_partkey % 8 = 5 THEN 'type ui' END AS reason FROM f""")
def _(t):
    return projects.explained(named_projects(t), RULES).select("path", "kind", "is_test", "reason")


@query("e20_filter_summary", f"""WITH {NAMED}, x AS (SELECT p_partkey % 8 = 6 OR p_partkey % 16 = 15 AS is_test, contains(path, 'bolt') OR contains(path, 'red_') OR p_partkey % 8 IN (0, 5) AS gone FROM f)
SELECT count(*) AS projects, count(*) FILTER (is_test) AS tests, count(*) FILTER (NOT is_test) AS production, count(*) FILTER (NOT gone) AS included, count(*) FILTER (gone) AS excluded FROM x""")
def _(t):
    return projects.filter_summary(projects.explained(named_projects(t), RULES))


def code(t: Tables) -> DataFrame:
    head = F.concat(F.lit("namespace Shop."), F.initcap("p_type"), F.lit("\n{\n  public class "), F.initcap(F.substring_index("p_name", " ", 1)), F.lit("Repo\n  {\n    public async Task<int> Load"), text("p_size"))
    body = F.concat(head, F.lit("(int a, string b)\n    {\n      return Other(a);\n    }\n    private static void "), F.initcap(F.substring_index("p_name", " ", -1)), F.lit("() => 1;\n  }\n}\n"))
    return t.raw("part").select(F.concat(F.lit("f"), text("p_partkey")).alias("path"), body.alias("content"), "p_partkey")


CODE = """w AS (SELECT 'f' || p_partkey AS path, p_size, p_type, upper(p_type[1]) || lower(p_type[2:]) AS ns, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
ix AS (SELECT 'namespace' AS kind, 'Shop.' || ns AS symbol, path FROM w UNION SELECT 'type', upper(a[1]) || a[2:] || 'Repo', path FROM w UNION SELECT 'method', 'Load' || p_size, path FROM w UNION SELECT 'method', upper(b[1]) || b[2:], path FROM w)"""


@query("d6_symbol_index", f"WITH {CODE} SELECT kind, symbol, path FROM ix")
def _(t):
    return symbols.index(code(t))


@query("d8_index_refresh", f"WITH {CODE} SELECT kind, symbol, path FROM ix WHERE substr(path, 2)::BIGINT % 10 <> 3")
def _(t):
    files = code(t)
    return symbols.refresh(symbols.index(files), files.where("p_partkey % 10 in (3, 4)").select("path"), files.where("p_partkey % 10 != 3"))


def asked(t: Tables, *given: str) -> DataFrame:
    return t.spark.createDataFrame([(g,) for g in given], "given string")


@query("c19_files_with_method", f"WITH {CODE} SELECT DISTINCT 'Shop.X.Load7' AS given, path FROM ix WHERE kind = 'method' AND contains(symbol, 'Load7') UNION SELECT 'Load12', path FROM ix WHERE kind = 'method' AND symbol = 'Load12' UNION SELECT 'Load(int)', path FROM ix WHERE kind = 'method' AND contains(symbol, 'Load')")
def _(t):
    return symbols.files_with_method(symbols.index(code(t)), asked(t, "Shop.X.Load7", "Load12", "Load(int)", "None"))


@query("c20_files_with_type", f"WITH {CODE} SELECT 'RedRepo' AS given, path FROM ix WHERE kind = 'type' AND symbol = 'RedRepo' UNION SELECT 'SmallRepository', path FROM ix WHERE kind = 'type' AND symbol = 'SmallRepo' UNION SELECT 'otRepo', path FROM ix WHERE kind = 'type' AND contains(symbol, 'otRepo')")
def _(t):
    return symbols.files_with_type(symbols.index(code(t)), asked(t, "RedRepo", "SmallRepository", "otRepo"))


@query("c26_files_in_namespace", f"WITH {CODE} SELECT symbol AS given, path FROM ix WHERE symbol IN ('Shop.Promo', 'Shop.Large')")
def _(t):
    return symbols.files_in_namespace(symbols.index(code(t)), asked(t, "Shop.Promo", "Shop.Large", "Shop"))


MARKED = "CASE o_orderkey % 5 WHEN 0 THEN ['TestAttribute', 'CategoryAttribute'] WHEN 1 THEN ['theoryattribute', 'SlowAttribute'] WHEN 2 THEN ['SetUpAttribute'] WHEN 3 THEN ['TestFixtureAttribute', 'NonParallelizable'] ELSE ['ObsoleteAttribute'] END"


@query("b29_attributes", """SELECT o_orderkey AS k, o_orderkey % 5 IN (0, 1) AS executable, o_orderkey % 5 IN (0, 1, 2) AS test_method, o_orderkey % 5 = 3 AS fixture, o_orderkey % 5 = 3 AS alone,
CASE o_orderkey % 5 WHEN 0 THEN 'category' WHEN 1 THEN 'slow' ELSE '' END AS tags, CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 1 END AS related FROM orders""")
def _(t):
    sets = (["TestAttribute", "CategoryAttribute"], ["theoryattribute", "SlowAttribute"], ["SetUpAttribute"], ["TestFixtureAttribute", "NonParallelizable"], ["ObsoleteAttribute"])
    own = F.element_at(F.array(*(F.array(*(F.lit(a) for a in s)) for s in sets)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    made = t.raw("orders").select(F.col("o_orderkey").alias("k"), own.alias("a"))
    return made.select(
        "k", attributes.is_executable(F.col("a")).alias("executable"), attributes.is_test_method(F.col("a")).alias("test_method"), attributes.any_marks(F.col("a"), "fixture").alias("fixture"),
        attributes.wants_to_be_alone(F.col("a")).alias("alone"), F.array_join(attributes.tags(F.col("a")), ",").alias("tags"), F.size(F.filter("a", attributes.is_related)).alias("related"),
    )


@query("f40_external_dependencies", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_type || ',' || 'Shop.Core' ELSE p_type END AS dependencies FROM part WHERE p_type < 'Shop'")
def _(t):
    refs = F.array(F.lit("System.Xml"), F.lit("NUnit.Framework"), F.when(F.col("p_partkey") % 2 == 0, "Shop.Core"), F.col("p_type"), F.lit("moq"), F.col("p_type"))
    return t.raw("part").where("p_type < 'Shop'").select(F.col("p_partkey").alias("k"), F.array_join(projects.external_dependencies(refs), ",").alias("dependencies"))
