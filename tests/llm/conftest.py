import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Columns whose names operators use themselves.
        *[T.StructField(n, T.StringType()) for n in ("size", "score", "predicted", "digest", "tid", "spans", "times", "target", "kinds", "_gone", "words", "shard")],
    ]
)


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows and clashing columns."""
    r = random.Random(7)
    base = [sentence(r, 120) for _ in range(6)]
    near = base[0].split()
    near[50] = "changed"
    texts = [
        (None, base[0]), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, base[0]), (7, base[0]),
        (8, " ".join(near)), (9, base[1] + "\n" + base[2][:300]), (10, base[2]), (11, base[3] + " é\U0001f600 " + base[1][200:]), (11, base[3] + " é\U0001f600 " + base[1][200:]),
        (12, "x " * 3000), (13, "y" * 5000), (14, sentence(r, 30_000)), (15, base[4]), (15, base[5]), (16, "password = hunter22hunter, AKIA" + "Z9" * 9), (-3, base[4]), (17, "\n\nline a b c d e\nline a b c d e\nline a b c d f\n"),
    ]
    return [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None, *["clash"] * 12) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
