"""From documents to packed token ids: language, near duplicates, benchmark passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and read again as the next one's docs. All
but the last keep the columns of documents. Repeats that the mixture asks for are rows of their own. Nulls, ties, repeated
rows, empty tables and extra columns are treated as each operator's docstring says; no stage adds or drops a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from impactlens.llm import decontam, langid, mixing, ngram_join, tokens
from impactlens.llm.common import stored

#: Near duplicates: shingles of five words, a similarity of 0.8 or more.
NEAR = ngram_join.Rule(words=5, num=80, den=100)


#: Languages to be kept; None: all that the labelled documents have.
LANGUAGES = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a wanted language; those in none that the labelled ones teach go, and so do texts without letters."""
    return langid.accepted(docs, langid.fit(docs.where(~langid.held_out(docs["doc_id"]))), LANGUAGES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.kept(docs, NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.packed(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mixture", mixture), ("token_ids", token_ids)]

#: Language identification and the packing of ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")  # kept: the result may be computed again from it
    return STAGES[-1][1](spark, docs, sf_dir)
