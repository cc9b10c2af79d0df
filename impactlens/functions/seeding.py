"""What a method's source says about the data it sets up, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How databases in memory are named in code.
IN_MEMORY = ["UseInMemoryDatabase", "UseSqlite", ":memory:"]


def _lines(source: Column) -> Column:
    return F.transform(F.split(F.coalesce(source, F.lit("")), r"\r?\n"), F.trim)


def seeding(source: Column) -> Column:
    """Lines that add rows, each with its entity (what is added to) and a guess at the rows: 5 for a range, else 1."""
    adds = F.filter(_lines(source), lambda t: F.contains(t, F.lit(".Add(")) | F.contains(t, F.lit(".AddRange(")))
    return F.transform(adds, lambda t: F.struct(F.regexp_extract(t, r"(\w+)\s*\.Add(?:Range)?\(", 1).alias("entity"), F.when(F.contains(t, F.lit("AddRange")), 5).otherwise(1).alias("records")))


def in_memory(source: Column) -> Column:
    """Names of the databases in memory that lines set up; Default where a line gives none."""
    hits = F.filter(_lines(source), lambda t: F.greatest(*(F.contains(t, F.lit(w)) for w in IN_MEMORY)))
    named = lambda t: F.regexp_extract(t, r'UseInMemoryDatabase[^"]*"([^"]*)"', 1)
    return F.transform(hits, lambda t: F.when(named(t) != "", named(t)).when(F.contains(t, F.lit(":memory:")), ":memory:").otherwise("Default"))
