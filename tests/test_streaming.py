"""Streams against their batch twins."""

import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiloom import streaming
from lexiloom.functions import formatting
from lexiloom.operators import sbd
from lexiloom.operators import segment as sg
from lexiloom.operators.sentences import rule_sentences
from pyspark.sql import functions as F

BITS = ["Hello", "Dr.", "no.", "a@b.c", "www.x.org/y.", "Yes!", "why?", '"So."', "(end.)", "e.g. this", "X.", "\n", "\n\n", " ", ".", ",", "é", "..."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(BITS), st.sampled_from(["", " ", "\n"])), max_size=20), st.lists(st.sampled_from(BITS), max_size=8))
def test_settled_sentences_stay(before, after):
    text = "".join(a + b for a, b in before)
    done, rest, offset = streaming.settled(text, "en")
    assert text.encode()[offset:].decode() == rest
    for more in ("", " ".join(after), "".join(after)):
        whole = rule_sentences(text + "\n" + more, "en")
        assert whole[: len(done)] == done
        tail = rule_sentences(rest + "\n" + more, "en")
        assert [[(t, n, o + offset, k) for t, n, o, k in s] for s in tail] == whole[len(done) :]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def test_sentences_of_parts(spark, folder):
    r = random.Random(5)
    rows = [(c, t, None if r.random() < 0.1 else "".join(r.choice(BITS) + r.choice(["", " "]) for _ in range(r.randint(0, 9))), t // 3) for c in range(12) for t in range(r.randint(1, 9))]
    parts = spark.createDataFrame(rows, "conv long, turn int, text string, step int")
    for step in range(3):
        parts.where(f"step = {step}").drop("step").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("conv long, turn int, text string").parquet(f"{folder}/in")
        found = streaming.sentences_of_parts(stream, "conv", "turn")
        found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    got = {}
    for x in streaming.latest(spark.read.parquet(f"{folder}/out"), "conv").collect():
        got.setdefault(x.conv, []).append((x.sent_no, x.offset, x.n_tokens, x.sentence))
    for c in range(12):
        whole = "\n".join(t or "" for i, _, t, _ in rows if i == c)
        want = [(k, s[0][2], len(s), " ".join(t[0] for t in s)) for k, s in enumerate(rule_sentences(whole, "en"))]
        assert sorted(got.get(c, [])) == want


def test_counts_of_batches_count_once(spark, folder):
    rows = [("EOS" if i % 3 else "!EOS", f"w{i % 5}", "LATIN", "R" if i % 2 else "r", "LATIN", i // 10) for i in range(40)]
    all_ = spark.createDataFrame(rows, "label string, l string, l_type string, r string, r_type string, step int")
    features = ("l_word", "r_case+l_len")
    for step in range(4):
        all_.where(f"step = {step}").drop("step").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(all_.drop("step").schema).parquet(f"{folder}/in")
        streaming.count_batches(stream, features, f"{folder}/counts", f"{folder}/state").awaitTermination()
    # A batch that comes again: its table is replaced.
    again = all_.where("step = 2")
    sbd.feature_counts(again, features).write.mode("overwrite").parquet(f"{folder}/counts/batch=2")
    got = sorted(map(tuple, streaming.merged_counts(spark, f"{folder}/counts").collect()))
    assert got == sorted(map(tuple, sbd.feature_counts(all_, features).collect())) and len(got) > 4
    assert spark.read.parquet(f"{folder}/counts").select("batch").distinct().count() == 4
    assert streaming.sbd.model_of(streaming.merged_counts(spark, f"{folder}/counts")).prior.count() == 2


@pytest.mark.parametrize("live", [False, True])
def test_formatted_text_is_written_as_it_is(spark, folder, live):
    docs = spark.createDataFrame([(i, f"Text {i}: it isn't\tlong. \n\nNo?") for i in range(20)], "id long, text string").repartition(3)
    docs.write.parquet(f"{folder}/in")
    rows = spark.readStream.schema(docs.schema).parquet(f"{folder}/in") if live else spark.read.parquet(f"{folder}/in")
    fmt = "%s\\t%t\\n"
    values = rows.select(formatting.format_tokens(sg.tokens("text"), fmt).alias("value"))
    query = streaming.write_formatted(values, f"{folder}/out", formatting.common_end(fmt), f"{folder}/state" if live else None)
    if live:
        query.awaitTermination()
    want = docs.select(F.explode(F.split(formatting.format_tokens(sg.tokens("text"), fmt), "\n")).alias("v")).where("v != ''")
    got = spark.read.text(f"{folder}/out").where("value != ''")
    assert sorted(x[0] for x in got.collect()) == sorted(x[0] for x in want.collect())


@pytest.mark.parametrize(("fmt", "end", "want"), [("%s\\n", None, "\n"), ("%s|", None, "|"), ("%s", None, ""), ("%s", "\\n", "\n"), ("%s ", "", " "), ("%t", "EOS", "S"), ("", None, "")])
def test_common_ends(fmt, end, want):
    assert formatting.common_end(fmt, end) == want
    if not want:
        with pytest.raises(ValueError):
            streaming.write_formatted(None, "", want)
