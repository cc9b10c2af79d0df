"""Which texts hold which of some given ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many given texts go to every executor; more are joined by what they have in common with a text.
FEW, GRAM = 1000, 3


def grams(c: Column, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda k: F.substring(c, k, F.lit(n))))


def containing(given: DataFrame, values: DataFrame, few: int = FEW) -> DataFrame:
    """given, and the columns of values (value, ...), for each value that contains a given text (not empty).

    A few given texts are broadcast, as many as were counted. More of them are keyed by one of their runs of three
    characters (shorter ones by themselves), values by all of theirs, and only those that share a key are compared."""
    given = given.where("given != ''").select("given").distinct()
    holds = F.contains(F.col("value"), F.col("given"))
    if given.limit(few + 1).count() <= few:
        return values.join(F.broadcast(given), holds)
    size = F.least(F.length("given"), F.lit(GRAM))
    # Of a text's runs that with the greatest hash: beginnings that many texts share are no key of all of them.
    own = F.transform(F.sequence(F.lit(1), F.length("given") - size + 1), lambda k: F.substring("given", k, size))
    keyed = given.withColumn("key", F.array_max(F.transform(own, lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"])
    keys = F.array_distinct(F.concat(*(grams(F.col("value"), n) for n in range(1, GRAM + 1))))
    return values.withColumn("key", F.explode(keys)).join(keyed, "key").where(holds).drop("key")
