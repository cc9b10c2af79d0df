"""The corpus pipeline, stage by stage and from end to end, on odd rows and empty tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import by_row, plain_judged
from pyspark.sql import functions as F
from test_text_operators import plain_components, shingles

import corpus_pipeline
from impactlens.llm import langid, mixing, tokens

NAMES = ["language", "near_duplicates", "decontaminate", "mixture", "token_ids"]


@pytest.fixture(params=["docs", "odd", "nothing"])
def table(request):
    return request.getfixturevalue(request.param)


def stage(name, spark, table, sf_dir):
    return dict(corpus_pipeline.STAGES)[name](spark, table, sf_dir)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES


@pytest.mark.parametrize("name", NAMES[:-1])
def test_stages_keep_columns(spark, table, sf_dir, name):
    found = stage(name, spark, table, sf_dir)
    assert found.schema.simpleString() == table.schema.simpleString()
    assert set(by_row(found, *table.columns)) <= set(by_row(table, *table.columns))


def test_language(spark, docs, sf_dir):
    other = spark.createDataFrame([(-1, "слово дело право " * 30, None, "s", 1)], docs.schema)
    found = stage("language", spark, docs.unionByName(other), sf_dir)
    assert found.where("text like 'слово%'").count() == 0
    assert found.count() >= 0.995 * docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_near_duplicates(spark, table, sf_dir):
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    left = Counter(r["doc_id"] for r in stage("near_duplicates", spark, table, sf_dir).collect())
    want = Counter()
    for d, size, c in plain_components(rows, corpus_pipeline.NEAR):
        if not size:
            want[d] += 1
        elif d is not None and d == c:
            want[d] = 1
    alone = [d for d, t in rows if d is None and shingles(t, 5)]
    assert {k: n for k, n in left.items() if k is not None} == {k: n for k, n in want.items() if k is not None} and left[None] <= want[None] + len(alone)


def test_decontaminate(spark, table, sf_dir):
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in stage("decontaminate", spark, table, sf_dir).select("doc_id", "text").collect()) == Counter(r for r in rows if not plain_judged(r[1], bench, 10)[1])


def test_from_end_to_end(spark, odd, docs, sf_dir, tmp_path):
    """run() over documents with repeats, nulls and added columns, against plain versions of all stages but the first."""
    rows = docs.unionByName(odd.select(*docs.columns).withColumn("doc_id", F.col("doc_id") + 1_000_000))
    rows.withColumn("class", F.lit("c")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    whole = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(whole.where(~langid.held_out(whole["doc_id"])))
    left = [tuple(r) for r in langid.accepted(whole, model).select("doc_id", "text", "source").collect()]
    named = plain_components([r[:2] for r in left], corpus_pipeline.NEAR)
    first = {}
    for r, (d, size, c) in zip(sorted(left, key=lambda r: (r[0] is None, r[0] or 0)), sorted(named, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        if size and d is not None and d == c:
            first[d] = r
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r for r in first.values() if not plain_judged(r[1], bench, 10)[1]]
    planned = mixing.plan(spark.createDataFrame(clean, "doc_id long, text string, source string")).select("doc_id", "copies").collect()
    copies = {r["doc_id"]: r["copies"] for r in planned}
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_tokenizer())
    want = Counter()
    for d, t, _ in clean:
        ids = [*own.encode(t, add_special_tokens=False).ids, 2]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += copies[d]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found if r["doc_id"] is not None)
    without = sum(r["doc_id"] is None for r in found)
    if not without:  # the rows without an id change the mixture's rates
        assert got == +want
    assert {k[0] for k in got} <= {d for d, _, _ in clean}
    assert sorted(r["start"] for r in found) == np.cumsum([0, *(r["n_tokens"] for r in sorted(found, key=lambda r: r["start"]))])[:-1].tolist()
    assert math.isclose(sum(r["n_tokens"] for r in found), max(r["start"] + r["n_tokens"] for r in found))


def test_empty_tables(spark, nothing, sf_dir, tmp_path):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
