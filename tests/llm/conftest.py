import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use themselves.
    T.StructField("size", T.StringType()), T.StructField("score", T.StringType()), T.StructField("class", T.StringType()),
    T.StructField("chunk", T.StringType()), T.StructField("target", T.StringType()), T.StructField("lang_pred", T.StringType()),
    T.StructField("copies", T.StringType()), T.StructField("_class", T.StringType()),
])


def odd_rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gämma", "delta", "eps1", "zeta-x", "η", "θ's", "iota.", "kappa"]
    some = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base = some(120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, None, "en", "a"), (1, "", "en", "a"), (2, " \t\r\n\x0b\x0c ", None, None), (3, "one", "en", None), (4, "One", "de", "b"),
        (5, "two words", "en", "b"), (6, base, "en", "a"), (7, base, "en", "a"), (7, base, "en", "a"), (8, " ".join(near), "de", "c"),
        (None, base + " more", "de", "c"), (None, None, None, None), (None, "", "fr", "b"), (9, some(20_000), "en", "c"),
        (10, "é\x1cü ß x \U0001f600 <|endoftext|> it's 12345 İ. \u0958. É, abc<| x<|endoftext|>, Ǆ! ﬁn.", "fr", "d"), (11, "+++ 123 --- !!", "en", "d"),
        (12, base.upper(), "en", "d"), (13, "\x00 a\x00b", "en", "d"), (14, "ALPHA " * 300, "en", "a"), (15, "alpha " * 301, "en", "a"),
        *[(20 + i, some(rng.randrange(1, 60)), rng.choice(["en", "de"]), rng.choice("abcd")) for i in range(60)],
    ]
    return [(*r, None, "s", "t", "u", "v", "w", "x", "y", "z") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeats, ties, a long text, clashing names."""
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
