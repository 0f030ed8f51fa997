"""Sentences in set form against the in-row splitter, and the labels of a corpus."""

import pytest
from lexiloom.operators import judged, sbd
from lexiloom.operators import segment as sg
from lexiloom.operators.sentences import MAX_TOKENS
from pyspark.sql import functions as F

FEATURES = ("r_case", "l_len")
TEXTS = [
    "Mr. Fox ran. He hid at 5 p.m. today! \"So.\" it went... Why? no. End",
    "", None, " \n", "One.\n\nTwo .three. four.﹒ Five﹒ six", "﻿Back. ﻿forth. Él vino. Ça va.", "a." * 40, "x. Y. " * 30 + "é.", ". . . . a", "... !? (no.) [Yes.] 'Ah.' B.",
    "word " * (MAX_TOKENS + 200) + "end. Then b. c " * 20 + "\n\n" + "more " * MAX_TOKENS + "A. b. C.", "go to www.a.org/b. Then x@y.org. End.",
]


@pytest.fixture(scope="module")
def model(spark):
    values = {(0, "LCAP"): (-0.1, -4.0), (0, "LLOW"): (-4.0, -0.1), (1, "1"): (-3.0, -0.2)}
    return sbd.Model("en_own", FEATURES, (-1.0, -1.5), [(-9.0, -9.0), (-1.0, -1.2)], values)


@pytest.mark.parametrize("lang", ["en", "fr", "de", "es"])
def test_set_form_is_the_in_row_splitter(spark, model, lang):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(TEXTS)], "id int, text string, sent_no string, offset string")
    want = sg.sentence_token_table(docs.select("id", "text"), lang, sbd="bayes", model=model)
    got = judged.sentence_tokens(docs, ["id"], lang, FEATURES, model.tables(spark))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_set_form_of_nothing(spark, model):
    docs = spark.createDataFrame([], "id int, text string")
    assert judged.sentence_tokens(docs, ["id"], "en", FEATURES, model.tables(spark)).collect() == []


def test_events_count_bytes():
    assert judged.events_of("﻿É vu. Ça!") == [(True, 8, 9), (False, 13, 14)]


@pytest.mark.parametrize(
    ("tokens", "end"),
    [
        ([("Go", "VB"), (".", "SYM")], 1), ([("Go", "VB"), (".", "SYM"), ('"', "SYM")], 1), ([("said", "VBD"), ('"', "SYM")], 1), ([("one", "CD"), ("two", "CD")], 1), ([(")", "SYM"), ("(", "SYM")], 1),
        ([("a", "X"), ("?", "X"), (")", "SYM"), ("!", "SYM"), ("]", "SYM")], 3), ([("a", "X"), (".", "SYM"), ("b", "X"), (")", "SYM")], 3),
    ],
)
def test_where_a_tagged_sentence_ends(spark, tokens, end):
    rows = spark.createDataFrame([("f", 0, i, *t) for i, t in enumerate(tokens)], "path string, sent_no int, tok_no int, str string, type string")
    assert [r.tok_no for r in sbd.labelled_tokens(rows, ["path"]).where(F.col("is_end")).collect()] == [end]


def test_cleaning_keeps_control_characters():
    assert sbd.clean_token("«a­\x01ﬁ͸»") == '"a\x01fi"'


def test_contained_ranges(spark):
    import random

    from lexiloom.operators import ranges

    r = random.Random(3)
    outer = [(d, i, r.randint(0, 300), r.randint(0, 200)) for d in range(3) for i in range(30)] + [(None, 0, 0, 500), (1, 99, None, 5)]
    inner = [(d, i, r.randint(0, 400), r.randint(0, 30)) for d in range(3) for i in range(60)] + [(None, 0, 1, 1), (1, 99, 5, None)]
    a = spark.createDataFrame(outer, "doc int, name int, offset long, len long")
    b = spark.createDataFrame(inner, "doc int, name int, offset long, len long")
    for size in (1, 16, 1000):
        got = sorted((x.doc, x.name, x.inner_name) for x in ranges.contained(b, a, ["doc"], size).collect())
        ok = lambda o, i: None not in (*o, *i) and o[0] == i[0] and o[2] <= i[2] and i[2] + i[3] <= o[2] + o[3]
        assert got == sorted((o[0], o[1], i[1]) for o in outer for i in inner if ok(o, i))
    plan = ranges.contained(b, a, ["doc"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_feature_sets_are_judged_as_by_training_each(spark):
    import random

    r = random.Random(6)
    rows = [(i, i % 5, r.choice(["EOS", "EOS", "!EOS"]), r.choice(["Mr", "end", "etc", "x" * 200, "No"]), "LATIN", r.choice(["The", "the", "5", ""]), r.choice(["LATIN", "NUM"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, fold int, label string, l string, l_type string, r string, r_type string")
    names = ("l_word", "r_shape", "r_len")
    got = {x.features: x for x in sbd.search_features(df, ["id"], names, most=3).collect()}
    assert len(got) == 7
    for features in (("l_word",), ("l_word", "r_len"), names):
        judged_ = None
        for k in range(5):
            model = sbd.train(df.where(F.col("fold") != k), features)
            own = sbd.score(df.where(F.col("fold") == k), ["id", "label"], features, model)
            judged_ = own if judged_ is None else judged_.unionByName(own)
        want = {x.method: x for x in sbd.evaluate(judged_).collect()}["bayes"]
        x = got[" ".join(features)]
        assert (x.accuracy, x.precision, x.recall, x.f1) == pytest.approx((want.accuracy, want.precision, want.recall, want.f1))


def test_kinds_of_errors(spark, tmp_path):
    assert [sbd.error_text(k) for k in (-1, 0, 5, 6)] == ["unknown error", "no error", "cannot read model file", "unknown error"]
    good = sbd.dump_model(sbd.Model("en_x", ("l_case",), (-1.0, -1.0), [(-9.0, -9.0)], {(0, "LCAP"): (-1.0, -1.0)}))
    (tmp_path / "en_x.mdl").write_bytes(good)
    (tmp_path / "en_y.mdl").write_bytes(good)
    assert sbd.load_model(spark, f"file://{tmp_path}/en_x.mdl").name == "en_x"
    for path, kind in ((f"file://{tmp_path}/none.mdl", sbd.CannotOpen), (f"file://{tmp_path}/en_y.mdl", sbd.WrongModel)):
        with pytest.raises(kind):
            sbd.load_model(spark, path)
    with pytest.raises(sbd.NoModels, match="models directory"):
        sbd.load_models(spark, f"file://{tmp_path}/nowhere")
    for data, kind in ((b"", sbd.CorruptModel), (b"other\n", sbd.WrongModel), (good[:-3], sbd.CorruptModel), (good + b"x", sbd.CorruptModel)):
        with pytest.raises(kind):
            sbd.parse_model(data)
    (tmp_path / "en_x.mdl").unlink()
    (tmp_path / "en_y.mdl").unlink()
    model = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    assert sbd._content(model) == []
