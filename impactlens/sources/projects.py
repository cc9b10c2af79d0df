"""Solutions, project files and the rules that say which projects and assemblies take part.

Files come as (path, content), such as spark.read.text(folder, wholetext=True) with input_file_name() gives them. All of
it is expressions on columns; a file that isn't well formed gives fewer rows and never stops the read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from impactlens.functions.names import contains_any, glob_matches

# Words in a project's name, by type, in the order in which types are tried.
TYPES = {
    "orm": "orm entityframework ef dapper", "database": "database db sql", "migration": "migration migrations", "integration": "integration",
    "api": "api webapi rest", "ui": "ui web client",
}
# What a test project's file mentions.
INDICATORS = "Microsoft.NET.Test.Sdk xunit nunit mstest FluentAssertions Shouldly Moq NSubstitute FakeItEasy"
# How names of assemblies begin.
TEST_ASSEMBLIES = "nunit xunit mstest Microsoft.VisualStudio.TestPlatform Microsoft.TestPlatform FluentAssertions Moq NSubstitute AutoFixture Shouldly Machine.Specifications"
SYSTEM_ASSEMBLIES = "System Microsoft.Extensions Microsoft.AspNetCore Microsoft.EntityFrameworkCore Newtonsoft mscorlib netstandard Microsoft.CSharp Microsoft.Win32"
DECLARATION = r'^Project\([^=]*=[^="]*"([^"]*)"[^"=]*"([^"=]*)"[^"=]*"\{?([0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12})\}?"[^=]*$'


@dataclass
class Config:
    """Which projects take part: glob or plain patterns, and types."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    exclude_types: list[str] = field(default_factory=list)
    test_projects_only: bool = False

    @staticmethod
    def parse(text: str) -> Config:
        """From JSON: {"projects": {"include": [...], "exclude": [...], "excludeTypes": [...], "testProjectsOnly": ...}}."""
        own = {k.lower(): v for k, v in {k.lower(): v for k, v in json.loads(text).items()}.get("projects", {}).items()}
        return Config(own.get("include") or [], own.get("exclude") or [], own.get("excludetypes") or [], bool(own.get("testprojectsonly", False)))


def read_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """path, content of the files below a folder whose names match."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def resolved(path: Column) -> Column:
    """A path with / between its parts and without . and .. parts."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    none = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(clean, "/"), none,
        lambda kept, p: F.when(p == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(p.isin("", "."), kept).otherwise(F.concat(kept, F.array(p))),
    )
    return F.concat(F.when(clean.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def solution_projects(solutions: DataFrame) -> DataFrame:
    """solution, name, path, guid of the C# projects that solution files declare."""
    lines = solutions.select(F.col("path").alias("solution"), F.explode(F.split("content", r"\r?\n")).alias("line")).withColumn("line", F.trim("line"))
    part = lambda k: F.regexp_extract("line", DECLARATION, k)
    found = lines.where(F.col("line").rlike(DECLARATION)).select("solution", part(1).alias("name"), resolved(F.concat_ws("/", folder_of(F.col("solution")), part(2))).alias("path"), F.lower(part(3)).alias("guid"))
    return found.where(F.lower("path").endswith(".csproj"))


def _includes(tag: str) -> Column:
    return F.filter(F.regexp_extract_all("xml", F.lit(rf"<{tag}\s[^>]*?\bInclude\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)), lambda x: x != "")


def project_details(projects: DataFrame) -> DataFrame:
    """path, target_framework, sources, project_refs (resolved), packages (name, version), assembly_refs."""
    one = lambda c, pattern: F.nullif(F.trim(F.regexp_extract(c, pattern, 1)), F.lit(""))
    xml = projects.select("path", F.regexp_replace(F.coalesce("content", F.lit("")), r"(?s)<!--.*?-->", "").alias("xml")).withColumn("folder", folder_of(F.col("path")))
    several = F.get(F.filter(F.split(one(F.col("xml"), r"<TargetFrameworks>([^<]*)<"), ";"), lambda x: x != ""), 0)
    items = F.regexp_extract_all("xml", F.lit(r"(?s)<PackageReference\s(?:[^>]*/>|.*?</PackageReference>)"), F.lit(0))
    packages = F.transform(items, lambda t: F.struct(
        F.regexp_extract(t, r"\bInclude\s*=\s*[\"']([^\"']*)[\"']", 1).alias("name"),
        F.coalesce(one(t, r"\bVersion\s*=\s*[\"']([^\"']*)[\"']"), one(t, r"<Version>([^<]*)<"), F.lit("latest")).alias("version"),
    ))
    absolute = lambda refs: F.transform(refs, lambda r: resolved(F.concat_ws("/", F.col("folder"), r)))
    return xml.select(
        "path", F.coalesce(one(F.col("xml"), r"<TargetFramework>([^<]*)<"), several, F.lit("net8.0")).alias("target_framework"),
        absolute(_includes("Compile")).alias("sources"), absolute(_includes("ProjectReference")).alias("project_refs"),
        F.filter(packages, lambda p: p["name"] != "").alias("packages"), _includes("Reference").alias("assembly_refs"),
    )


def project_edges(details: DataFrame) -> DataFrame:
    """caller, callee: references between projects that are both listed."""
    refs = details.select(F.col("path").alias("caller"), F.explode("project_refs").alias("callee")).distinct()
    return refs.join(details.select(F.col("path").alias("callee")), "callee", "left_semi").select("caller", "callee")


def source_files(paths: DataFrame, whole_parts: bool = True) -> DataFrame:
    """The .cs files outside build folders. The index look-up takes bin and obj anywhere in a path (whole_parts=False)."""
    built = F.col("path").rlike(r"/(bin|obj|\.git|\.vs)/") if whole_parts else F.col("path").rlike("bin|obj")
    return paths.where(F.col("path").endswith(".cs") & ~built)


def project_of_files(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """path, project: the project whose folder is nearest above each file; an equi-join on the folders above it."""
    parts = F.split(folder_of(F.col("path")), "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("folder"))
    near = above.join(projects.select(F.col("path").alias("project"), folder_of(F.col("path")).alias("folder")), "folder")
    return near.groupBy("path").agg(F.max_by("project", F.struct(F.length("folder"), F.col("project"))).alias("project"))


def test_assemblies(paths: DataFrame) -> DataFrame:
    """The .dll files with test or spec in their names; of equal names (ignoring case) one, rather not a Release build."""
    own = paths.where(F.lower("path").endswith(".dll") & contains_any(file_name(F.col("path")), ["test", "spec"])).select("path")
    first = Window.partitionBy(F.lower(file_name(F.col("path")))).orderBy(F.contains(F.col("path"), F.lit("Release")), "path")
    return own.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def type_matches(path: Column, kind: str) -> Column:
    return contains_any(stem(path), TYPES.get(kind.lower(), kind.lower()).split())


def project_type(path: Column) -> Column:
    """The first type that a project's name speaks of; null if none."""
    return F.coalesce(*(F.when(type_matches(path, kind), kind) for kind in TYPES))


def is_test_project(path: Column, content: Column) -> Column:
    return contains_any(stem(path), ["test", "spec"]) | contains_any(content, INDICATORS.lower().split())


def _begins(name: Column, words: str) -> Column:
    return F.coalesce(name.rlike("(?i)^(" + "|".join(w.replace(".", r"\.") for w in words.split()) + ")"), F.lit(False))


def is_test_assembly(name: Column) -> Column:
    return _begins(name, TEST_ASSEMBLIES)


def is_system_assembly(name: Column) -> Column:
    return _begins(name, SYSTEM_ASSEMBLIES)


def external_dependencies(references: Column) -> Column:
    """Distinct references that are neither test frameworks nor the system's, in order."""
    return F.array_sort(F.array_distinct(F.filter(references, lambda r: r.isNotNull() & (r != "") & ~is_test_assembly(r) & ~is_system_assembly(r))))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def filter_projects(projects: DataFrame, config: Config) -> DataFrame:
    """Included by any pattern (or none is given), excluded by no pattern and no type."""
    p = F.col("path")
    kept = _any([glob_matches(p, x) for x in config.include]) if config.include else F.lit(True)
    return projects.where(kept & ~_any([glob_matches(p, x) for x in config.exclude]) & ~_any([type_matches(p, x) for x in config.exclude_types]))


def explained(projects: DataFrame, config: Config) -> DataFrame:
    """projects (path, content) with is_test, kind, included and reason: the first rule that leaves a project out."""
    p = F.col("path")
    found = projects.withColumn("is_test", is_test_project(p, F.col("content"))).withColumn("kind", project_type(p))
    reason = F.lit(None).cast("string")
    reason = F.when(F.col("kind").isin([x.lower() for x in config.exclude_types]), F.concat(F.lit("type "), F.col("kind"))).otherwise(reason)
    for pattern in reversed(config.exclude):
        reason = F.when(glob_matches(p, pattern), f"exclude {pattern}").otherwise(reason)
    if config.include:
        reason = F.when(~_any([glob_matches(p, x) for x in config.include]), "no include pattern").otherwise(reason)
    if config.test_projects_only:
        reason = F.when(~F.col("is_test"), "not a test project").otherwise(reason)
    return found.withColumn("reason", reason).withColumn("included", F.col("reason").isNull())


def filter_summary(explained_: DataFrame) -> DataFrame:
    """One row: projects, tests, production projects, included and excluded ones."""
    return explained_.agg(
        F.count("*").alias("projects"), F.count_if("is_test").alias("tests"), F.count_if(~F.col("is_test")).alias("production"),
        F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("excluded"),
    )


def framework_version(*candidates: Column) -> Column:
    """The first candidate (metadata, references, path) that says anything; Unknown if none does."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in candidates), F.lit("Unknown"))


#: Which kind of loader takes a framework, by how its name begins.
LOADERS = [("netstandard", "Standard"), ("netcoreapp", "NetCore"), ("net4", "Framework48"), ("net", "Net5Plus")]


def loads(assemblies: DataFrame) -> DataFrame:
    """path, framework, loader, error for each assembly once (path, exists, and what speaks of its framework: metadata,
    references, path), or why it can't be loaded."""
    by_path = F.regexp_extract(F.lower("path"), r"[/\\](net(?:standard|coreapp)?[0-9][0-9.]*)[/\\]", 1)
    framework = framework_version(F.lower("metadata"), F.lower("references"), by_path)
    loader = F.lit(None).cast("string")
    for begins, kind in reversed(LOADERS):
        loader = F.when(F.col("framework").startswith(begins), kind).otherwise(loader)
    none = F.coalesce(F.trim("path"), F.lit("")) == ""
    found = assemblies.dropDuplicates(["path"]).withColumn("framework", framework).withColumn("loader", loader)
    error = F.when(none, "no path").when(~F.col("exists"), F.concat(F.lit("not found: "), "path")).when(F.col("loader").isNull(), F.concat(F.lit("no loader for "), "framework"))
    return found.select("path", "framework", F.when(error.isNull(), F.col("loader")).alias("loader"), error.alias("error"))
