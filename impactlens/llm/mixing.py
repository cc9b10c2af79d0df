"""Mixing sources to target weights: repetition rates by source, whole copies plus a hash-seeded Bernoulli copy.

Semantics
- A document's size is its number of words (runs of bytes other than space and 0x09-0x0D); null or blank text: 0.
- A source's weight goes by its rank by code point (null last): `weights`, repeating. Sources share the total of all
  sizes by weight; a target stops at `most` times its source's size and the excess is shared again by weight.
- rate = target / source size; a document is emitted floor(rate) times, and once more if its hash falls below the
  fraction. The hash is of the doc_id's text and `seed`, so reruns agree and repeated rows agree with each other.
- An empty table gives an empty result; a source with no words has target 0. Extra columns are kept by `mix`, and
  columns that this operator adds replace columns of the same name.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactlens.llm.common import own_name, stored

WORDS = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds each source's weight by its rank. Range partitions are ranked apart and offset by their counts, so that
    no task sees all sources; only a count per partition comes to the driver."""
    parts = sources.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source")
    parts = stored(parts.withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}
    first, before = 0, {}
    for part in sorted(counts):
        before[part], first = first, first + counts[part]
    if not before:
        return parts.withColumn("weight", F.lit(0).cast("long")).drop("last", "part")
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("part")]
    rank = offset + F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    return parts.withColumn("weight", weight.cast("long")).drop("last", "part")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, weight, target. The level (target for each unit of weight) rises until what the stopped
    sources leave is dealt out; each step is one aggregation of which two sums come back."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(ranked(sources, weights), "mix-weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = Fraction(0), -1
    while True:
        full = F.col("source_size") * most * level.denominator <= F.col("weight") * level.numerator
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(full, 1)).alias("stopped"),
        ).first()
        if row["open"] == 0 or row["stopped"] == stopped:
            break
        stopped, level = row["stopped"], Fraction(int(total) - int(row["taken"]), int(row["open"]))
        level = level.limit_denominator(1 << 30) if level.numerator > 1 << 50 else level
    each = F.lit(float(level.numerator)) / F.lit(float(level.denominator))
    return sources.withColumn("target", F.least(F.col("source_size") * float(most), F.col("weight") * each))


def chance(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1): the first 32 bits of an MD5 of the id, or, without one, of the document's text."""
    key = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix:") -> DataFrame:
    """docs with size, source_size, target, copies and taken added; copies is how often the mix emits the document."""
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    sized = docs.withColumn("size", words_in(F.col("text")))
    goal = targets(stored(sized.select("source", "size"), "mix-sizes"), weights, most)
    key = own_name(sized, "_source")
    goal = goal.select(F.col("source").alias(key), "source_size", "target")
    # As many rows as sources: small beside the documents, and joined by Spark's own choice of side.
    out = sized.join(goal, sized["source"].eqNullSafe(goal[key]), "left").drop(key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + F.when(chance(F.col("doc_id"), F.col("text"), seed) < rate - whole, 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix:") -> DataFrame:
    """The mixed documents, with docs' own columns: each row as often as the plan says."""
    names = docs.columns
    whole = own_name(docs, "_row")
    # docs' own columns travel in a struct, apart from those that the plan adds.
    packed = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in names if c != "text")).alias(whole))
    times = F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)))
    planned = plan(packed, weights, most, seed).where("copies > 0").withColumn("copies", F.explode(times))
    return planned.select(*(F.col("text") if c == "text" else F.col(f"{whole}.`{c}`").alias(c) for c in names))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM per
), ordered AS (
  SELECT *, 3 * source_size / weight AS stops_at,
         coalesce(sum(3 * source_size) OVER before, 0) AS below, sum(weight) OVER from_here AS open,
         sum(source_size) OVER () AS total
  FROM weighed
  WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         from_here AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT (total - below) / open AS each FROM ordered WHERE (total - below) / open <= stops_at ORDER BY stops_at, source NULLS LAST LIMIT 1
), goal AS (
  SELECT source, source_size, least(source_size * 3, weight * each) AS target FROM ordered, level
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS chance
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
