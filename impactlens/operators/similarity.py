"""Similarity of tests by coverage, metadata and execution path; clusters and recommendations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from impactlens.functions import names
from impactlens.operators.components import connected
from impactlens.operators.history import clamp
from impactlens.sources.cut import cut


def jaccard(both: Column, left: Column, right: Column) -> Column:
    union = left + right - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def overlaps(coverage: DataFrame, tests: DataFrame | None = None, least: int = 1) -> DataFrame:
    """i < j, common, n_i, n_j, jaccard of every pair of tests that share a method.

    An inverted index join on the method: pairs without a common method are never made. tests: a restriction of one
    side (test_id), such as the tests of a change."""
    own = coverage.select("test_id", "method_id").distinct()
    size = own.groupBy("test_id").agg(F.count("*").alias("n"))
    left = own if tests is None else own.join(tests.select("test_id"), "test_id", "left_semi")
    a, b = left.select(F.col("test_id").alias("i"), "method_id"), own.select(F.col("test_id").alias("j"), "method_id")
    order = F.col("i") < F.col("j") if tests is None else F.col("i") != F.col("j")
    pairs = a.join(b, "method_id").where(order).groupBy("i", "j").agg(F.count("*").alias("common")).where(F.col("common") >= least)
    pairs = pairs.join(size.select(F.col("test_id").alias("i"), F.col("n").alias("n_i")), "i").join(size.select(F.col("test_id").alias("j"), F.col("n").alias("n_j")), "j")
    return pairs.withColumn("jaccard", jaccard(F.col("common"), F.col("n_i"), F.col("n_j")))


def weighted_overlaps(coverage: DataFrame, weights: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """As overlaps, with methods weighted (method_id, weight): weight of the common ones over that of all.

    Weights count to six decimals and are added exactly, so that the result doesn't hang on the order of rows."""
    own = coverage.select("test_id", "method_id").distinct().join(weights, "method_id").withColumn("weight", F.col("weight").cast("decimal(18,6)"))
    total = own.groupBy("test_id").agg(F.sum("weight").alias("w"))
    left = own if tests is None else own.join(tests.select("test_id"), "test_id", "left_semi")
    a = left.select(F.col("test_id").alias("i"), "method_id", "weight")
    pairs = a.join(own.select(F.col("test_id").alias("j"), "method_id"), "method_id").where("i < j" if tests is None else "i != j").groupBy("i", "j").agg(F.sum("weight").alias("common"))
    pairs = pairs.join(total.select(F.col("test_id").alias("i"), F.col("w").alias("w_i")), "i").join(total.select(F.col("test_id").alias("j"), F.col("w").alias("w_j")), "j")
    union = F.col("w_i") + F.col("w_j") - F.col("common")
    return pairs.select("i", "j", F.when(union <= 0, 0.0).otherwise(F.col("common").cast("double") / union.cast("double")).alias("weighted"))


def framework_weight(method: Column) -> Column:
    return F.when(F.lower(method).rlike(r"^(system\.|microsoft\.|nunit\.|xunit\.|moq\.)"), 0.3).otherwise(1.0)


def complexity_weight(method: Column) -> Column:
    generic, ctor = F.when(method.contains("<"), 1.2).otherwise(1.0), F.when(method.contains(".ctor"), 0.8).otherwise(1.0)
    accessor = F.when(method.rlike(r"(^|\.)(get_|set_)"), 0.6).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(2.0), generic * ctor * accessor))


def shown_weight(method: Column) -> Column:
    """The weight that reports of common methods show; it also counts asynchronous methods."""
    factor = lambda pattern, value: F.when(method.rlike(pattern), value).otherwise(1.0)
    return factor("<", 1.2) * factor(r"\.ctor", 1.1) * factor(r"(^|\.)(get_|set_)", 0.7) * factor("Async", 1.15)


def method_weights(methods: DataFrame) -> DataFrame:
    """method_id, weight: frameworks count less, generic methods more, constructors and accessors less."""
    return methods.select("method_id", (framework_weight(F.col("method_id")) * complexity_weight(F.col("method_id"))).alias("weight")).distinct()


def category_similarity(a: Column, b: Column) -> Column:
    pair = F.array_join(F.array_sort(F.array(a, b)), "~")
    return F.when(a == b, 1.0).when(pair == "Integration~Unit", 0.3).when(pair == "EndToEnd~Integration", 0.4).when(pair == "Database~Integration", 0.5).otherwise(0.0)


def array_jaccard(a: Column, b: Column, one_empty: float = 0.0) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), one_empty).otherwise(both / F.greatest(either, F.lit(1)))


def naming_similarity(a: Column, b: Column) -> Column:
    none = F.coalesce(a == "", F.lit(True)) | F.coalesce(b == "", F.lit(True))
    return F.when(none, 0.0).otherwise(array_jaccard(names.tokens(a), names.tokens(b)))


def tag_similarity(a: Column, b: Column) -> Column:
    low = lambda x: F.array_distinct(F.transform(x, F.lower))
    return array_jaccard(low(a), low(b), 0.5)


def time_similarity(a: Column, b: Column) -> Column:
    return F.when((a < 1) & (b < 1), 1.0).when((a <= 0) | (b <= 0), 0.0).otherwise(F.sqrt(F.least(a, b) / F.greatest(a, b)))


def metadata(pairs: DataFrame, tests: DataFrame) -> DataFrame:
    """pairs (i, j, ...) with category, naming, tag, time and metadata similarity. tests: test_id, name, category, tags, avg_ms."""
    side = lambda k: tests.select(F.col("test_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("name", "category", "tags", "avg_ms")))
    found = pairs.join(side("i"), "i").join(side("j"), "j")
    found = found.withColumn("category_sim", category_similarity(F.col("category_i"), F.col("category_j"))).withColumn("naming_sim", naming_similarity(F.col("name_i"), F.col("name_j")))
    found = found.withColumn("tag_sim", tag_similarity(F.col("tags_i"), F.col("tags_j"))).withColumn("time_sim", time_similarity(F.col("avg_ms_i"), F.col("avg_ms_j")))
    total = 0.3 * F.col("category_sim") + 0.4 * F.col("naming_sim") + 0.2 * F.col("tag_sim") + 0.1 * F.col("time_sim")
    return found.withColumn("metadata_sim", clamp(total)).drop(*(f"{c}_{k}" for k in "ij" for c in ("name", "category", "tags", "avg_ms")))


def overall(depth: str = "Medium") -> Column:
    """Of coverage, metadata and, if the column is there, path similarity."""
    a, b = {"Shallow": (1.0, 0.0), "Medium": (0.7, 0.3), "Deep": (0.6, 0.4)}[depth]
    return a * F.col("jaccard") + b * F.col("metadata_sim")


def recommendations(pairs: DataFrame) -> DataFrame:
    """i, j, kind, confidence for compared pairs (jaccard, metadata_sim, category_sim, naming_sim, time_sim)."""
    p, m, pct = F.col("jaccard"), F.col("metadata_sim"), F.col("jaccard") * 100
    merge = clamp((0.4 * p + 0.3 * m + 0.2 * F.col("category_sim") + 0.1 * F.col("naming_sim")) * F.when(F.col("time_sim") < 0.5, 0.9).otherwise(1.0))
    one = lambda when, kind, confidence: F.when(when, F.struct(F.lit(kind).alias("kind"), confidence.alias("confidence")))
    found = F.array(
        one((pct >= 70) & (m >= 0.6), "Merge", merge), one(~((pct >= 70) & (m >= 0.6)) & (pct >= 50) & (m >= 0.4), "PartialMerge", merge * 0.7),
        one((pct >= 30) & (pct < 70), "ExtractCommon", 4 * p * (1 - p)), one((pct < 30) | (m < 0.3), "MaintainSeparate", (1 - p) * (1 - m)), one(F.col("naming_sim") < 0.3, "Naming", F.lit(0.8)),
    )
    return pairs.select("i", "j", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("r")).select("i", "j", "r.kind", "r.confidence")


def matrix_statistics(pairs: DataFrame, sim: str = "jaccard") -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs"), F.avg(sim).alias("mean"), F.stddev_pop(sim).alias("sd"), F.min(sim).alias("least"), F.max(sim).alias("most"), F.percentile(sim, 0.5).alias("median"))


def average_per_test(pairs: DataFrame, sim: str = "jaccard") -> DataFrame:
    both = pairs.select(F.col("i").alias("test_id"), sim).unionByName(pairs.select(F.col("j").alias("test_id"), sim))
    return both.groupBy("test_id").agg(F.avg(sim).alias("average"))


def single_linkage(pairs: DataFrame, threshold: float = 0.6, sim: str = "jaccard") -> DataFrame:
    """test_id, cluster (its least test): connected components at the threshold."""
    return connected(pairs.where(F.col(sim) >= threshold).select("i", "j")).select(F.col("node").alias("test_id"), F.col("root").alias("cluster"))


def linkage(pairs: DataFrame, threshold: float = 0.6, kind: str = "complete", sim: str = "jaccard") -> DataFrame:
    """test_id, cluster (its least test): complete or average linkage of the tests that have a pair at the threshold.

    In each round every two clusters that are nearest to each other are put together; neither linkage ever brings a third
    one nearer by that, so this comes to what merging one best pair after the other does. Ties go by id. Only pairs that
    can still meet are kept: for complete linkage those at the threshold, else those within a component."""
    component = single_linkage(pairs, threshold, sim)
    if kind == "complete":
        own = pairs.where(F.col(sim) >= threshold)
    else:
        own = pairs.join(component.withColumnRenamed("test_id", "i"), "i").join(component.select(F.col("test_id").alias("j"), F.col("cluster").alias("c")), "j").where("cluster = c")
    live = cut(own.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col(sim).cast("double").alias("s")))
    groups = cut(component.select("test_id", F.col("test_id").alias("cluster")))
    while True:
        size = groups.groupBy("cluster").agg(F.count("*").alias("n"))
        valued = live.join(size.select(F.col("cluster").alias("i"), F.col("n").alias("n_i")), "i").join(size.select(F.col("cluster").alias("j"), F.col("n").alias("n_j")), "j")
        value = F.col("s") if kind == "complete" else F.col("s") / (F.col("n_i") * F.col("n_j"))
        near = valued.select("i", "j", value.alias("v")).where(F.col("v") >= threshold)
        near = near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).groupBy("i").agg(F.min(F.struct((-F.col("v")).alias("v"), "j")).alias("m")).select("i", F.col("m.j").alias("j"))
        back = near.select(F.col("j").alias("i"), F.col("i").alias("j"))
        mutual = cut(near.where("i < j").join(back, ["i", "j"], "left_semi"))
        if mutual.isEmpty():
            return groups
        moved = live.join(mutual.select(F.col("j").alias("old_i"), F.col("i").alias("new_i")), F.col("i") == F.col("old_i"), "left").join(mutual.select(F.col("j").alias("old_j"), F.col("i").alias("new_j")), F.col("j") == F.col("old_j"), "left")
        x, y = F.coalesce("new_i", "i"), F.coalesce("new_j", "j")
        moved = moved.select(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"), "s").where("i != j")
        if kind == "complete":  # a pair that isn't there counts as 0: all of those that fall together must be
            grown = mutual.select(F.col("i").alias("k"), F.lit(2).alias("times"))
            moved = moved.groupBy("i", "j").agg(F.min("s").alias("s"), F.count("*").alias("have"))
            moved = moved.join(grown.toDF("i", "times_i"), "i", "left").join(grown.toDF("j", "times_j"), "j", "left")
            moved = moved.where(F.col("have") == F.coalesce("times_i", F.lit(1)) * F.coalesce("times_j", F.lit(1))).select("i", "j", "s")
        else:
            moved = moved.groupBy("i", "j").agg(F.sum("s").alias("s"))
        live = cut(moved)
        groups = cut(groups.join(mutual.toDF("into", "cluster"), "cluster", "left").select("test_id", F.coalesce("into", "cluster").alias("cluster")))


#: Ways of clustering that can be asked for; all of them come to hierarchical clustering.
ALGORITHMS = ("Hierarchical", "KMeans", "DBSCAN")


def clusters(pairs: DataFrame, threshold: float = 0.6, algorithm: str = "Hierarchical", linked: str = "single", sim: str = "jaccard") -> DataFrame:
    """test_id, cluster by the options given."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {', '.join(ALGORITHMS)}")
    return single_linkage(pairs, threshold, sim) if linked == "single" else linkage(pairs, threshold, linked, sim)


def intra_similarity(clusters: DataFrame, pairs: DataFrame, sim: str = "jaccard") -> DataFrame:
    """cluster, size, cohesion: mean over all pairs of a cluster; pairs that aren't listed count as 0, one test as 1."""
    inside = pairs.join(clusters.select(F.col("test_id").alias("i"), "cluster"), "i").join(clusters.select(F.col("test_id").alias("j"), F.col("cluster").alias("c")), "j").where("cluster = c")
    total = inside.groupBy("cluster").agg(F.sum(sim).alias("s"))
    n = F.col("size")
    return clusters.groupBy("cluster").agg(F.count("*").alias("size")).join(total, "cluster", "left").select("cluster", "size", F.when(n < 2, 1.0).otherwise(F.coalesce("s", F.lit(0.0)) / F.greatest(n * (n - 1) / 2, F.lit(1.0))).alias("cohesion"))


@F.pandas_udf(StructType().add("lcs", DoubleType()).add("edit", DoubleType()))
def _sequence_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Normalised longest common subsequence and edit similarity of pairs of sequences: one vector step per element of
    the first one. A running maximum (minimum) carries a row's best over to the places after it."""
    out = np.ones((len(a), 2))
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        n, most = len(y), max(len(x), len(y))
        if not most:
            continue
        if not len(x) or not n:
            out[k] = 0
            continue
        codes = np.unique(np.concatenate([x, y]).astype(str), return_inverse=True)[1]
        right, place = codes[len(x) :], np.arange(n + 1)
        lcs, edit = np.zeros(n + 1, np.int64), place.copy()
        for code in codes[: len(x)]:
            same = right == code
            grown, moved = lcs.copy(), edit + 1
            grown[1:] = np.maximum(grown[1:], (lcs[:-1] + 1) * same)
            moved[1:] = np.minimum(moved[1:], edit[:-1] + ~same)
            lcs, edit = np.maximum.accumulate(grown), np.minimum.accumulate(moved - place) + place
        out[k] = lcs[-1] / most, 1 - edit[-1] / most
    return pd.DataFrame(out, columns=["lcs", "edit"])


def path_similarity(pairs: DataFrame) -> DataFrame:
    """pairs (i, j, a, b: the two tests' method sequences) with lcs, edit, trigram and sequential similarity."""
    found = pairs.withColumn("s", _sequence_scores("a", "b")).withColumn("lcs", F.col("s.lcs")).withColumn("edit", F.col("s.edit")).drop("s")
    found = found.withColumn("trigram", array_jaccard(names.grams(F.col("a")), names.grams(F.col("b"))))
    return found.withColumn("sequential", 0.5 * F.col("lcs") + 0.3 * F.col("edit") + 0.2 * F.col("trigram")).withColumn("prefix", names.common_prefix(F.col("a"), F.col("b")))


def overlap_facts(pairs: DataFrame) -> DataFrame:
    """pairs (i, j, common, n_i, n_j, jaccard) with only_i, only_j and percentage."""
    return pairs.withColumn("only_i", F.col("n_i") - F.col("common")).withColumn("only_j", F.col("n_j") - F.col("common")).withColumn("percentage", 100 * F.col("jaccard"))


def common_methods(coverage: DataFrame, pairs: DataFrame) -> DataFrame:
    """i, j, method_id, side (both, i, j): the methods of each pair asked for, by an equi-join per side."""
    own = coverage.select("test_id", "method_id").distinct()
    a = pairs.select("i", "j").join(own.toDF("i", "method_id"), "i").withColumn("a", F.lit(1))
    b = pairs.select("i", "j").join(own.toDF("j", "method_id"), "j").withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNull(), "j").when(F.col("b").isNull(), "i").otherwise("both")
    return a.join(b, ["i", "j", "method_id"], "full_outer").select("i", "j", "method_id", side.alias("side"))


def tag_sets(pairs: DataFrame, tests: DataFrame) -> DataFrame:
    """pairs with the tags (ignoring case) of both, of i only and of j only."""
    low = lambda k: tests.select(F.col("test_id").alias(k), F.array_distinct(F.transform("tags", F.lower)).alias(f"t_{k}"))
    both = pairs.join(low("i"), "i").join(low("j"), "j")
    return both.select(*pairs.columns, F.array_intersect("t_i", "t_j").alias("common_tags"), F.array_except("t_i", "t_j").alias("tags_i"), F.array_except("t_j", "t_i").alias("tags_j"))


def symmetric(pairs: DataFrame, sim: str = "jaccard") -> DataFrame:
    """i, j, sim: each pair once in either direction."""
    return pairs.select("i", "j", sim).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), sim)).distinct()


def most_similar(pairs: DataFrame, sim: str = "jaccard") -> DataFrame:
    """test_id, nearest, sim: the least id among the most similar."""
    first = Window.partitionBy("i").orderBy(F.desc(sim), "j")
    return symmetric(pairs, sim).withColumn("k", F.row_number().over(first)).where("k = 1").select(F.col("i").alias("test_id"), F.col("j").alias("nearest"), sim)


def above(pairs: DataFrame, threshold: float, sim: str = "jaccard") -> DataFrame:
    """Pairs at the threshold; below it a matrix holds 0."""
    return pairs.where(F.col(sim) >= threshold)


def cut_off(pairs: DataFrame, threshold: float, sim: str = "jaccard") -> DataFrame:
    """All pairs, with 0 below the threshold."""
    return pairs.withColumn(sim, F.when(F.col(sim) >= threshold, F.col(sim)).otherwise(0.0))


def best_pair(pairs: DataFrame, sim: str = "jaccard") -> DataFrame:
    """The most similar pair; of several the first by id."""
    return pairs.orderBy(F.desc(sim), "i", "j").limit(1)


def ordered(recommended: DataFrame, least: float = 0.0) -> DataFrame:
    """Recommendations of at least this confidence with their place, surest first. Ranges of confidence are sorted apart and
    offset by how many come before, of which a count per partition comes to the driver."""
    own = recommended.where(F.col("confidence") >= least)
    parts = cut(own.repartitionByRange(F.desc("confidence"), "i", "j").sortWithinPartitions(F.desc("confidence"), "i", "j").withColumn("part", F.spark_partition_id()))
    before, first = {}, 0
    for row in parts.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        before[row["part"]], first = first, first + row["n"]
    if not before:
        return parts.withColumn("place", F.lit(0).cast("long")).drop("part")
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("part")]
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("confidence"), "i", "j"))
    return parts.withColumn("place", (offset + rank).cast("long")).drop("part")


def primary(recommended: DataFrame) -> DataFrame:
    """The surest recommendation of each pair (i, j, kind, confidence)."""
    first = Window.partitionBy("i", "j").orderBy(F.desc("confidence"), "kind")
    return recommended.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def silhouettes(clusters: DataFrame, pairs: DataFrame, sim: str = "jaccard") -> DataFrame:
    """test_id, cluster, silhouette: (a - b) / max(a, b), a the mean similarity to the rest of its cluster and b that to the
    nearest other cluster; only for clusters of two or more, none with one cluster. Pairs that aren't listed count as 0,
    so only clusters with a listed pair are compared: no test is joined with every cluster."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    sums = symmetric(pairs, sim).join(clusters.select(F.col("test_id").alias("i"), F.col("cluster").alias("own")), "i").join(clusters.select(F.col("test_id").alias("j"), "cluster"), "j").groupBy("i", "own", "cluster").agg(F.sum(sim).alias("s"))
    near = sums.join(size, "cluster").withColumn("m", F.when(F.col("cluster") == F.col("own"), F.try_divide(F.col("s"), F.col("n") - 1)).otherwise(F.col("s") / F.col("n")))
    found = near.groupBy("i").agg(F.max(F.when(F.col("cluster") == F.col("own"), F.col("m"))).alias("a"), F.max(F.when(F.col("cluster") != F.col("own"), F.col("m"))).alias("b"))
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    several = size.agg(F.count("*").alias("clusters"))
    rows = clusters.join(size.where("n > 1"), "cluster").join(found, clusters["test_id"] == found["i"], "left").crossJoin(several).where("clusters > 1")  # one row
    return rows.select("test_id", "cluster", F.try_divide(a - b, F.greatest(a, b)).alias("silhouette"))


def cluster_statistics(clusters: DataFrame, pairs: DataFrame, tests: DataFrame, sim: str = "jaccard") -> DataFrame:
    """One row: clusters, clustered and unclustered tests, mean cohesion, spread of sizes, silhouette and its label."""
    own = intra_similarity(clusters, pairs, sim)
    found = own.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("clustered"), F.coalesce(F.avg("cohesion"), F.lit(0.0)).alias("cohesion"), F.coalesce(F.stddev_pop("size"), F.lit(0.0)).alias("size_spread"))
    score = silhouettes(clusters, pairs, sim).agg(F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("silhouette"))
    left = unclustered(tests, clusters).agg(F.count("*").alias("unclustered"))
    return found.crossJoin(score).crossJoin(left).withColumn("quality", quality(F.col("silhouette")))  # one row each


def quality(score: Column) -> Column:
    return F.when(score >= 0.7, "excellent").when(score >= 0.5, "good").when(score >= 0.3, "fair").otherwise("poor")


def unclustered(tests: DataFrame, clusters: DataFrame) -> DataFrame:
    return tests.join(clusters.select("test_id"), "test_id", "left_anti").select("test_id")


def cluster_profile(clusters: DataFrame) -> DataFrame:
    """cluster, namespaces, name, pattern: what the ids (namespace.class.method) of a cluster have in common. The counts of
    each namespace and pattern are made before they are gathered."""
    named = clusters.withColumn("ns", names.namespace(F.col("test_id"))).withColumn("p", F.when(names.type_qualifier(F.col("test_id")).contains("Test"), names.pattern_of_class(names.type_qualifier(F.col("test_id")))))
    few = named.groupBy("cluster", "ns", "p").agg(F.count("*").alias("n"))
    patterns = few.where("p is not null").groupBy("cluster", "p").agg(F.sum("n").alias("n")).groupBy("cluster").agg(F.max_by("p", F.struct(F.col("n"), F.col("p"))).alias("pattern"))
    spaces = few.groupBy("cluster").agg(F.array_sort(F.collect_set(F.nullif("ns", F.lit("")))).alias("namespaces"))
    name = F.when(F.size("namespaces") == 1, F.concat(F.col("namespaces")[0], F.lit("_Cluster_"), "cluster")).otherwise(F.concat(F.lit("TestCluster_"), "cluster"))
    return spaces.join(patterns, "cluster", "left").select("cluster", "namespaces", name.alias("name"), F.coalesce("pattern", F.lit("Unknown")).alias("pattern"))


def consolidations(cohesion: DataFrame) -> DataFrame:
    """cluster, confidence, effort of clusters (cluster, size, cohesion) large and alike enough to be put together."""
    own = cohesion.where((F.col("size") >= 5) & (F.col("cohesion") >= 0.8))
    return own.select("cluster", F.col("cohesion").alias("confidence"), F.when(F.col("size") <= 10, "Low").otherwise("Medium").alias("effort"))


def effort(kind: Column, common: Column, total: Column, category_sim: Column, metadata_sim: Column) -> Column:
    """What a recommendation would cost: by the methods of both tests, or, to extract what is common, by those."""
    merge = F.when((total < 10) & (category_sim > 0.8), "Low").when((total < 25) & (metadata_sim > 0.6), "Medium").otherwise("High")
    return F.when(kind == "ExtractCommon", F.when(common < 5, "Low").when(common < 15, "Medium").otherwise("High")).otherwise(merge)


def similarity_label(score: Column) -> Column:
    return F.when(score >= 0.8, "very high").when(score >= 0.6, "high").when(score >= 0.4, "moderate").when(score >= 0.2, "low").otherwise("very low")


def plain_metadata(pairs: DataFrame, tests: DataFrame) -> DataFrame:
    """pairs (i, j, ...) with category_sim (1 or 0), tag_sim (0 if one side has none) and time_sim (1 if neither took time)."""
    side = lambda k: tests.select(F.col("test_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("category", "tags", "avg_ms")))
    both = pairs.join(side("i"), "i").join(side("j"), "j")
    low = lambda k: F.array_distinct(F.transform(f"tags_{k}", F.lower))
    a, b = F.col("avg_ms_i"), F.col("avg_ms_j")
    time = F.when((a <= 0) & (b <= 0), 1.0).otherwise(time_similarity(a, b))
    return both.select(*pairs.columns, F.when(F.col("category_i") == F.col("category_j"), 1.0).otherwise(0.0).alias("category_sim"), array_jaccard(low("i"), low("j")).alias("tag_sim"), time.alias("time_sim"))


def overall_with_paths(depth: str = "Medium") -> Column:
    """Of coverage (jaccard), metadata (metadata_sim) and paths (path_sim: the mean of structural and sequential similarity)."""
    a, b, c = {"Shallow": (1.0, 0.0, 0.0), "Medium": (0.5, 0.2, 0.3), "Deep": (0.4, 0.3, 0.3)}[depth]
    return a * F.col("jaccard") + b * F.col("metadata_sim") + c * F.col("path_sim")
