import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, equal texts, odd characters, and columns with the operators' own names."""
    long = " ".join(f"wörd{i % 997}x{i}" for i in range(30_000))
    rows = [(1, "same text of some words here"), (2, "same text of some words here"), (3, None), (4, ""), (5, long), (6, "á 日本 \u0000 <|endoftext|>"), (6, "á 日本 \u0000 <|endoftext|>"), (None, "no id at all"), (7, " \n\t "), (8, "x"), (9, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(f"{c}!") for c in ("id", "length", "label", "score", "shard", "n", "key", "lang", "piece", "hub", "rid", "start")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_chars long, id string")


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(3, 8))) for _ in range(n)]


@pytest.fixture(scope="session")
def make_prose():
    return prose
