"""The rules on small texts through their columns."""

import cases
from lexiloom.functions import text as tx
from lexiloom.operators import sbd
from lexiloom.operators import segment as sg
from lexiloom.plans.queries import CAPITALS
from lexiloom.sources import text as src
from pyspark.sql import functions as F


def frame(spark, rows, columns):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"case_no int, {columns}")


def column(df, *names):
    return [tuple(r) if len(names) > 1 else r[0] for r in df.orderBy("case_no").select(*names).collect()]


def test_tokens(spark):
    rows = frame(spark, [c[:2] for c in cases.TOKENS], "lang string, text string")
    shown = F.array_join(F.transform(sg.tokens("text", F.col("lang")), lambda t: F.concat_ws("/", t["str"], t["type"])), " | ")
    assert column(rows, shown) == [c[2] for c in cases.TOKENS]


def test_sentences(spark):
    for rows, how in ((cases.SENTENCES, {"sbd": "fsm"}), (cases.BY_CLASSIFIER, {"sbd": "bayes", "model": sbd.parse_model(sbd.dump_model(CAPITALS))})):
        texts = frame(spark, [c[:2] for c in rows], "lang string, text string")
        shown = F.array_join(F.transform(sg.sentences("text", F.col("lang"), **how), lambda s: F.array_join(F.transform(s, lambda t: t["str"]), " ")), " | ")
        assert column(texts, shown) == [c[2] for c in rows]


def test_graphemes(spark):
    rows = frame(spark, [c[:1] for c in cases.GRAPHEMES], "text string")
    assert column(rows, F.array_join(F.transform(sg.graphemes("text"), lambda t: t["str"]), " | ")) == [c[1] for c in cases.GRAPHEMES]


def test_character_classes(spark):
    rows = [(c, s, s in inside) for c, inside, outside in cases.CLASSES for s in (*inside, *outside)]
    found = frame(spark, rows, "class string, sign string, want boolean")
    assert found.where(tx.in_class("sign", F.col("class")) != F.col("want")).collect() == []


def test_features(spark):
    rows = frame(spark, [c[:4] for c in cases.FEATURES], "l string, l_type string, r string, r_type string")
    own = [F.array_join(F.array(*[F.replace(sbd.feature(n), F.lit(sbd.SEPARATOR), F.lit("/")) for n in sbd.FEATURES[g]]), "|") for g in ("de", "en", "fr", "it")]
    assert column(rows, *own) == [c[4:] for c in cases.FEATURES]


def test_corpus(spark):
    lines = spark.createDataFrame([("corpus", i, t) for i, t in enumerate(cases.CORPUS)], "path string, line int, text string")
    found = src.parse_corpus(lines).orderBy("sent_no", "tok_no").select("sent_no", "tok_no", "str", "type").collect()
    assert [tuple(r) for r in found] == cases.CORPUS_TOKENS


def test_texts(spark):
    rows = frame(spark, [c[:1] for c in cases.TEXTS], "text string")
    forms = (tx.strip_ignorable("text"), tx.strip_unknown("text"), tx.normalized("text", "NFKC"), tx.case_folded("text"), tx.prepared("text"))
    assert column(rows, *forms) == [c[1:] for c in cases.TEXTS]


def test_type_names(spark):
    assert [r[0] for r in spark.range(12).orderBy("id").select(sg.type_name(F.col("id").cast("int"))).collect()] == "UNK LATIN PREFIX SUFFIX SYM NUM ABBR EMAIL URI PATH UNK UNK".split()
    assert [r.lang for r in sg.languages(spark).collect()] == ["de", "en", "fr", "it"]


def test_properties_of_code_points(spark):
    from lexiloom.operators import properties

    rows = spark.createDataFrame([(s,) for s in ["a", "É", "́", "\U0001f1ee", "ᄀ", "한", "☃", "", None, "‍", "\r"]], "sign string")
    found: dict = {}
    for r in properties.with_properties(rows, "sign").collect():
        found.setdefault(r.sign, set()).add(r.property)
    assert found == {
        "a": {"latin_letter", "latin_lowercase"}, "É": {"latin_letter", "latin_uppercase"}, "́": {"combining_diacritic", "Extend"}, "\U0001f1ee": {"Regional_Indicator"},
        "ᄀ": {"L"}, "한": {"LVT"}, "‍": {"ZWJ"}, "\r": {"CR"},
    }
    sets = properties.property_sets()
    assert len(sets["Extend"]) == 1828 and len(sets["SpacingMark"]) == 341 and len(sets["latin_letter"]) == 1349 and len(sets["latin_uppercase"]) == 477
    breaks = [v for k, v in sets.items() if k[0].isupper()]
    assert sum(map(len, breaks)) == len(set().union(*breaks))  # disjoint
