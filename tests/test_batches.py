"""Arrow functions take a few rows at a time, however many Spark hands over."""

import hashlib

import pyarrow as pa
import pytest
from lexiloom.functions import batches
from lexiloom.functions import text as tx
from lexiloom.operators import sbd
from lexiloom.operators import segment as sg
from lexiloom.operators.graphemes import count, graphemes
from pyspark.sql import functions as F


def test_slices_hold_all_rows_in_order():
    texts = ["a" * 100_000, None, "", "b" * 200_000, "c" * 900_000, None, "d"]
    parts = list(batches.slices(pa.array(texts), pa.array(range(7))))
    assert [x for p, _ in parts for x in p.to_pylist()] == texts and [x for _, q in parts for x in q.to_pylist()] == list(range(7))
    assert len(parts) > 2 and all(len(p) == 1 or sum(len(x or "") for x in p.to_pylist()) <= batches.SLICE for p, _ in parts)
    assert [len(p) for p, in batches.slices(pa.array([], pa.string()))] == [0]


def test_a_batch_of_many_texts_is_tokenised_in_parts():
    """Tokens of a whole batch at once would take over a gigabyte for each 20 MB of text."""
    text, lang = pa.array(["ab cd. " * 9_000] * 40), pa.array(["en"] * 40)
    parts = list(sg._tokens.func(iter([(text, lang)])))
    assert sum(map(len, parts)) == 40 and max(map(len, parts)) <= 4


@pytest.mark.parametrize("texts", [["éa\r\n\U0001f1e9\U0001f1ea", "", None, "﻿ab"]])
def test_counts_of_clusters(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(1)
    got = dict(rows.select("i", sg.grapheme_count("text")).collect())
    assert got == {i: None if t is None else len(graphemes(t)) for i, t in enumerate(texts)} and count("﻿") == 0


def test_narrow_forms_are_those_of_the_tokens(spark):
    texts = ["A b. C d.e. F", ". .", "", None, "x.", "﻿Mr. X!! 4.5 é. ¿Y"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    tokens = rows.select("i", sg.tokens("text", "en").alias("t"))
    words = F.transform(F.filter("t", lambda t: t["type"] == "LATIN"), lambda t: t["str"])
    for whole, narrow in ((sbd.contexts_in(F.col("t")), sg.period_contexts("text", "en")), (words, sg.token_strings("text", "en", "LATIN"))):
        got = rows.select("i", F.explode(narrow).alias("x")).collect()
        assert got and sorted(map(str, got)) == sorted(map(str, tokens.select("i", F.explode(whole).alias("x")).collect()))


def test_text_functions_over_more_than_a_slice(spark):
    rows = spark.range(6).select("id", F.repeat(F.concat(F.lit("ẞÉﬁ­͸"), F.col("id").cast("string")), 20_000).alias("text")).repartition(1)
    cols = [F.md5(c) for c in (tx.case_folded("text"), tx.normalized("text", "NFC"), sbd.cleaned("text"))]
    for r in rows.select("id", *cols).collect():
        unit = f"ẞÉﬁ­͸{r[0]}"
        want = [unit.casefold(), f"ẞÉﬁ­͸{r[0]}", f"ẞÉfi{r[0]}"]
        assert list(r[1:]) == [hashlib.md5((w * 20_000).encode()).hexdigest() for w in want]


def test_batches_of_queries_are_bounded(spark):
    """A batch of 10,000 texts was held whole, with its results: it grew with the texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, found in (("64mb", batches.BATCH), (1000, 1000)):
            spark.conf.set(key, given)
            batches.bound_batches(spark)
            assert int(spark.conf.get(key).rstrip("b")) == found
    finally:
        spark.conf.set(key, before)
