import math

import __spark_entry__ as entry
import pytest
from lexiloom import streaming
from lexiloom.functions import formatting
from lexiloom.functions import text as tx
from lexiloom.operators import sbd
from lexiloom.operators import segment as sg
from lexiloom.sources import text as src
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Dr. Who came. He left!", "en"), (2, "", "fr"), (3, None, "en"), (4, "l'été 2, (x)", "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_tables(docs):
    found = sg.token_table(docs, F.col("lang")).collect()
    assert [(r.doc_id, r.seq, r.str, r.offset, r.type) for r in found if r.doc_id == 4][:3] == [(4, 0, "l'", 0, "PREFIX"), (4, 1, "été", 2, "LATIN"), (4, 2, "2", 8, "NUM")]
    by = {r.doc_id: r for r in docs.select("doc_id", sg.tokens("text", "en").alias("t"), sg.graphemes("text").alias("g"), sg.sentences("text", "en", "fsm").alias("s")).collect()}
    assert by[2].t == by[2].g == by[2].s == [] and by[3].t is by[3].g is by[3].s is None
    sents = sg.sentence_token_table(docs, "en", sbd="fsm").where("doc_id = 1").orderBy("sent_no", "tok_no").collect()
    assert [(r.sent_no, r.str) for r in sents] == [(0, "Dr."), (0, "Who"), (0, "came"), (0, "."), (1, "He"), (1, "left"), (1, "!")]


def test_modes_and_configs(docs):
    assert sg.parse_config("fr bayes") == ("fr", "bayes") and sg.parse_config("de fsm") == ("de", "fsm")
    assert sg.parse_config("english") == ("zz", "bayes") and sg.parse_config("fr x") == ("fr", "fsm")
    assert sg.segment(docs, "sentence", "en fsm").count() == 3
    assert sg.segment(docs, "grapheme").count() == sum(len(r.text or "") for r in docs.collect())
    with pytest.raises(ValueError, match="cannot open model"):
        sg.segment(docs, "sentence", "en")
    with pytest.raises(ValueError):
        sg.segment(docs, "word")


def test_filters_are_pushed_below_segmentation(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "d"))
    plan = sg.token_table(spark.read.parquet(str(tmp_path / "d")), "en").where("doc_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,1)" in plan


def test_sql(spark, docs):
    sg.register(spark)
    docs.createOrReplaceTempView("sql_docs")
    assert spark.sql("select sum(size(tokens(text, lang))) from sql_docs").first()[0] == 8 + 7
    assert spark.sql("select count(*) from sql_docs, lateral tokenize(text, lang)").first()[0] == 15


def test_stream_equals_batch(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "d"))
    rows = streaming.token_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "d")), F.col("lang"))
    q = rows.writeStream.format("memory").queryName("stream_tokens").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("stream_tokens").collect()) == sorted(sg.token_table(docs, F.col("lang")).collect())


def test_text_functions(spark):
    df = spark.createDataFrame([("Éa­b",), ("",), (None,)], "t string")
    r = df.select(tx.prepared("t").alias("p"), tx.byte_length("t").alias("b"), tx.code_points("t").alias("n"), tx.byte_offset("t", -1).alias("o"), tx.strip_diacritics("t").alias("d"), tx.case_folded("t").alias("c"), tx.category("t").alias("k"), tx.is_upper("t").alias("u")).collect()
    assert (r[0].p, r[0].b, r[0].n, r[0].o, r[0].k, r[0].u) == ("Éab", 7, 5, 6, "Lu", True)
    assert (r[0].d, r[0].c) == ("Ea­b", "éa­b") and r[1].p == "" and r[1].k is None and r[2].p is None
    assert tx.valid_utf8 and spark.createDataFrame([(b"a\xffb",)], "x binary").select(tx.valid_utf8("x")).first()[0] == "a�b"


def test_paragraphs_and_format(spark):
    df = spark.createDataFrame([("a\nb\n \n\nc\u2029d",)], "text string")
    assert df.select(tx.paragraphs("text")).first()[0] == ["a\nb\n", "c\n", "d\n"]
    out = df.select(formatting.format_tokens(sg.tokens(F.lit("1 000 é"), "en"), "%s|%t|%l%%\\t\\q\\\\").alias("x")).first().x
    assert out == "1 000|NUM|5%\t\\q\\é|LATIN|2%\t\\q\\"
    assert df.select(formatting.format_sentences(sg.sentences(F.lit("A be. C do."), "en", "fsm"), "%s ", "\\n")).first()[0] == "A be . \nC do . \n"


def test_training_by_hand(spark):
    rows = [("EOS", "a", "X"), ("EOS", "b", "Y"), ("!EOS", "a", "y")]
    cand = spark.createDataFrame([(i, lab, l, "LATIN", r, "LATIN") for i, (lab, l, r) in enumerate(rows)], "id int, label string, l string, l_type string, r string, r_type string")
    model = sbd.train(cand, ("l_word",))
    lp = {r.value: (r.lp_eos, r.lp_not) for r in model.prob.collect()}
    assert lp["a"] == pytest.approx((math.log2(1.5 / 3), math.log2(1.5 / 2))) and lp["b"] == pytest.approx((math.log2(1.5 / 3), math.log2(0.5 / 2)))
    assert {r.label: r.lp for r in model.prior.collect()} == pytest.approx({"EOS": math.log2(2.5 / 4), "!EOS": math.log2(1.5 / 4)})
    assert model.unknown.first().lp_eos == pytest.approx(math.log2(0.5 / 3))
    told = {r.id: r for r in sbd.score(cand, ["id"], ("l_word",), model).collect()}
    assert told[0].lp_eos == pytest.approx(math.log2(2.5 / 4) + math.log2(1.5 / 3)) and told[1].is_eos


def test_sets_and_sequence_agree(spark, tmp_path):
    text = "He came at 5. Then e.g. two left. No. 7 was here. It rained. all day. Yes."
    cand = sbd.contexts(sg.token_table(spark.createDataFrame([(1, text)], "doc_id long, text string")), ["doc_id"])
    cand = cand.withColumn("label", F.when(F.regexp_like("r", F.lit("^[A-Z]")), "EOS").otherwise("!EOS"))
    features = ("l_case", "l_suffix2", "r_prefix4+r_unimask", "r_shape+l_mask", "r_len")
    tables = sbd.train(cand, features)
    model = sbd.Model.of(tables, "toy", features)
    data = sbd.dump_model(model)
    (tmp_path / "toy.mdl").write_bytes(data)
    again = sbd.load_model(spark, f"file://{tmp_path}/toy.mdl")
    assert again == model and sbd.dump_model(again) == data
    scored = {r.seq: r.is_eos for r in sbd.score(cand, ["seq"], features, again.tables(spark)).collect()}
    for r in cand.collect():
        assert again.at_end((r.l, 0, 0, r.l_type), (r.r, 0, 0, r.r_type)) == scored[r.seq]
    for broken in (b"", data[:-3], data + b"x", data.replace(b"EOS", b"EOX", 1), b"other 1\n" + data):
        with pytest.raises(sbd.ModelError):
            sbd.parse_model(broken)


def test_models_of_a_folder(spark, tmp_path):
    for name in ("de_a", "fr_b"):
        m = sbd.Model(name, ("r_case",), (-1.0, -1.0), [(-2.0, -2.0)], {(0, "LCAP"): (-0.5, -2.0)})
        (tmp_path / f"{name}.mdl").write_bytes(sbd.dump_model(m))
    found = sbd.load_models(spark, f"file://{tmp_path}")
    assert {g: m.name for g, m in found.items()} == {"de": "de_a", "fr": "fr_b"}
    (tmp_path / "it_c.mdl").write_bytes((tmp_path / "de_a.mdl").read_bytes())
    for wrong in (lambda: sbd.load_model(spark, f"file://{tmp_path}/it_c.mdl"), lambda: sbd.parse_model((tmp_path / "de_a.mdl").read_bytes(), name="de_b"), lambda: sbd.parse_model((tmp_path / "de_a.mdl").read_bytes(), version="0")):
        with pytest.raises(sbd.ModelError):
            wrong()


def test_contexts_of_an_array_are_those_of_the_table(spark):
    docs = spark.createDataFrame([(1, "One. Two e.g. three. . Four."), (2, "."), (3, ""), (4, None), (5, "no period")], "doc_id long, text string")
    table = sbd.contexts(sg.token_table(docs), ["doc_id"])
    array = docs.select("doc_id", sg.tokens("text").alias("t")).select("doc_id", F.explode(sbd.contexts_in(F.col("t"))).alias("c")).select("doc_id", "c.*")
    assert array.columns == table.columns and sorted(map(tuple, array.collect())) == sorted(map(tuple, table.collect()))


def test_corpus_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("He came at 5. (She left.) \"No!\"",)], "text string")
    rows = sg.sentence_table(docs, "en", sbd="fsm")
    src.write_corpus(rows, str(tmp_path / "c"))
    tokens = src.parse_corpus(src.read_lines(spark, str(tmp_path / "c")))
    assert [r.str for r in tokens.orderBy("sent_no", "tok_no").collect()][:5] == ["He", "came", "at", "5", "."]
    cand = src.corpus_candidates(tokens).orderBy("sent_no", "tok_no").collect()
    assert [(r.l, r.r, r.label) for r in cand] == [("5", "(", "EOS"), ("left", ")", "EOS")]
    src.write_features(src.corpus_candidates(tokens), str(tmp_path / "f"))
    assert len(spark.read.text(str(tmp_path / "f")).first().value.split("\t")) == 25


def test_evaluation(spark):
    df = spark.createDataFrame([("EOS", True), ("EOS", False), ("!EOS", True), ("EOS", True)], "label string, is_eos boolean")
    by = {r.method: r for r in sbd.evaluate(df).collect()}
    assert by["bayes"].accuracy == 50 and by["bayes"].precision == pytest.approx(200 / 3) and by["always"].recall == 100 and by["always"].accuracy == 75


def test_command_line(spark, tmp_path, capsys):
    from lexiloom import cli

    (tmp_path / "in.txt").write_text("Hello you.\nBye.\n\nAgain 1\n")
    cli.main(["-m", "token", "-f", "%s/%t ", f"file://{tmp_path}/in.txt"])
    assert capsys.readouterr().out.strip() == "Hello/LATIN you/LATIN ./SYM Bye/LATIN ./SYM Again/LATIN 1/NUM"
    cli.main(["-l", "en fsm", "-f", "%s ", "-e", "|", f"file://{tmp_path}/in.txt"])
    assert capsys.readouterr().out.strip() == "Hello you . |Bye . |Again 1 |"
    cli.main(["-m", "token", f"file://{tmp_path}/in.txt", f"file://{tmp_path}/out"])
    assert "".join(sorted(r[0] for r in spark.read.text(f"file://{tmp_path}/out").collect())) == "".join(sorted(["Hello", "you", ".", "Bye", ".", "Again", "1"]))
    cli.main(["-L"])
    assert capsys.readouterr().out.split() == ["de", "en", "fr", "it"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
