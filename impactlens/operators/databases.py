"""Which databases a test's source uses, and which tests share one. Detectors can be added by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens.functions import classify, seeding

CONTEXT = r"\b(\w*Context)\b"
ENTITY = r"\.([A-Z]\w*)\s*\.\s*(Add|AddRange|Update|UpdateRange|Remove|RemoveRange|Find|FindAsync|Where|First|Single|ToList|ToListAsync|Any|Count)\w*\s*\("
DEPENDENCY = "test_id string, kind string, resource_id string, access string, entity string"


def _rows(tests: DataFrame, resource: Column, access: Column, entity: Column) -> DataFrame:
    return tests.select("test_id", F.lit("Database").alias("kind"), resource.alias("resource_id"), access.alias("access"), entity.alias("entity")).distinct()


def contexts(tests: DataFrame) -> DataFrame:
    """A row for each context and entity set that a test's source (test_id, source) names; the access goes by the call."""
    named = tests.withColumn("context", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(CONTEXT), F.lit(1)))))
    sets, verbs = F.regexp_extract_all("source", F.lit(ENTITY), F.lit(1)), F.regexp_extract_all("source", F.lit(ENTITY), F.lit(2))
    uses = F.zip_with(sets, verbs, lambda s, v: F.struct(s.alias("entity"), v.alias("verb")))
    found = named.withColumn("use", F.explode_outer(uses))
    verb = F.when(F.col("use.verb").rlike("^(Where|First|Single|ToList|Any|Count)"), "get").otherwise(F.col("use.verb"))
    return _rows(found, F.concat(F.lit("EFCore:"), "context"), F.coalesce(F.when(F.col("use").isNotNull(), classify.access_type(verb)), F.lit("ReadWrite")), F.col("use.entity"))


def in_memory(tests: DataFrame) -> DataFrame:
    """A row for each database in memory that a test's source sets up."""
    named = tests.withColumn("name", F.explode(F.array_distinct(seeding.in_memory(F.col("source")))))
    return _rows(named, F.concat(F.lit("EFCore:InMemory:"), "name"), F.lit("ReadWrite"), F.lit(None).cast("string"))


@dataclass
class Detectors:
    """Functions from tests (test_id, source) to dependencies (test_id, kind, resource_id, access, entity), by name."""

    held: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=lambda: {"contexts": contexts, "in_memory": in_memory})

    def add(self, name: str, detector: Callable[[DataFrame], DataFrame]) -> Detectors:
        self.held[name] = detector
        return self

    def detect(self, tests: DataFrame) -> DataFrame:
        """The dependencies that any detector finds, each once."""
        out = tests.sparkSession.createDataFrame([], DEPENDENCY)
        for detector in self.held.values():
            out = out.unionByName(detector(tests).select("test_id", "kind", "resource_id", "access", "entity"))
        return out.distinct()


def sharing(dependencies: DataFrame) -> DataFrame:
    """i < j of tests that use the same database or the same entity. Keyed by either, so unrelated tests never meet."""
    own = dependencies.where("kind = 'Database'")
    keys = own.select("test_id", F.concat(F.lit("r:"), "resource_id").alias("key")).unionByName(own.where("entity is not null").select("test_id", F.concat(F.lit("e:"), "entity").alias("key"))).distinct()
    return keys.withColumnRenamed("test_id", "i").join(keys.withColumnRenamed("test_id", "j"), "key").where("i < j").select("i", "j").distinct()


def shares(pairs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """pairs (i, j) with `shares`: whether they use the same database or entity. Only the pairs asked for are joined."""
    own = dependencies.where("kind = 'Database'").groupBy("test_id").agg(F.collect_set("resource_id").alias("r"), F.collect_set("entity").alias("e"))
    both = pairs.join(own.toDF("i", "r_i", "e_i"), "i", "left").join(own.toDF("j", "r_j", "e_j"), "j", "left")
    return both.select(*pairs.columns, F.coalesce(F.arrays_overlap("r_i", "r_j") | F.arrays_overlap("e_i", "e_j"), F.lit(False)).alias("shares"))
