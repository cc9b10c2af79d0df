"""An inverted index of symbols: which files declare a method, a type or a namespace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlens.functions import diff, names
from impactlens.operators.containment import containing

NAMESPACE = r"\bnamespace\s+([A-Za-z_][\w.]*)"
METHOD = r"\b(?:public|private|protected|internal|static|async|override|virtual)\s+(?:[\w<>\[\],?.]+\s+)+(\w+)\s*(?:<[^>]*>)?\s*\([^)]*\)\s*(?:\{|=>|where|;)"


def index(files: DataFrame) -> DataFrame:
    """files (path, content): kind (method, type, namespace), symbol, path, each once."""
    body = F.coalesce("content", F.lit(""))
    found = lambda kind, pattern: F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("symbol")))
    all_ = F.concat(found("method", METHOD), found("type", diff.TYPE), found("namespace", NAMESPACE))
    return files.select("path", F.explode(F.array_distinct(all_)).alias("s")).select("s.kind", "s.symbol", "path").distinct()


def refresh(index_: DataFrame, changed: DataFrame, present: DataFrame) -> DataFrame:
    """The index after the changed files (path) were read again; those that aren't among `present` (path, content) are gone."""
    return index_.join(changed, "path", "left_anti").select("kind", "symbol", "path").unionByName(index(present.join(changed, "path", "left_semi")))


def scoped(files: DataFrame, scope: DataFrame) -> DataFrame:
    """The index of the files of a scope (path) only."""
    return index(files.join(scope, "path", "left_semi"))


def _exact_or(index_: DataFrame, wanted: DataFrame, kind: str, name, either: bool = False) -> DataFrame:
    """wanted (given), path: files with the very symbol; for names without any, those with a symbol that contains the name
    (or, either way round, is contained in it). Near matches are looked for among the distinct symbols, not the files."""
    own = index_.where(F.col("kind") == kind).select("symbol", "path")
    exact = wanted.select("given").distinct().join(own, F.col("given") == F.col("symbol"))
    missed = wanted.select("given").distinct().join(own.select(F.col("symbol").alias("given")), "given", "left_anti")
    short = missed.select("given", name(F.col("given")).alias("name"))
    symbols = own.select("symbol").distinct()
    near = containing(short.select(F.col("name").alias("given")), symbols.withColumn("value", F.col("symbol"))).select(F.col("given").alias("name"), "symbol")
    if either:
        near = near.unionByName(containing(symbols.select(F.col("symbol").alias("given")), short.select(F.col("name").alias("value"))).select(F.col("value").alias("name"), F.col("given").alias("symbol")))
    close = short.join(near.distinct(), "name").join(own, "symbol")
    return exact.select("given", "path").unionByName(close.select("given", "path")).distinct()


def files_with_method(index_: DataFrame, wanted: DataFrame) -> DataFrame:
    return _exact_or(index_, wanted, "method", names.name_only)


def files_with_type(index_: DataFrame, wanted: DataFrame) -> DataFrame:
    return _exact_or(index_, wanted, "type", lambda g: g, either=True)


def files_in_namespace(index_: DataFrame, wanted: DataFrame) -> DataFrame:
    own = index_.where("kind = 'namespace'").select("symbol", "path")
    return wanted.select("given").distinct().join(own, F.col("given") == F.col("symbol")).select("given", "path")


def projects_with_method(index_: DataFrame, wanted: DataFrame, owners: DataFrame) -> DataFrame:
    """given, project. owners: path, project."""
    return files_with_method(index_, wanted).join(owners, "path").select("given", "project").distinct()
