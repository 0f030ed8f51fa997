import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiloom.operators.tokens import TYPES, scanner, tokenize
from cases import TOKENS

# What the rules make of texts of our own.
MORE = [
    ("en", "", ""),
    ("en", "they'd've mind's eye", "they'd/LATIN 've/SUFFIX mind/LATIN 's/SUFFIX eye/LATIN"),
    ("it", "quell'isola senz'acqua, Dov'era?", "quell'/PREFIX isola/LATIN senz'/PREFIX acqua/LATIN ,/SYM Dov'/PREFIX era/LATIN ?/SYM"),
    ("it", "C'è un ne' qui", "C'/PREFIX è/LATIN un/LATIN ne'/LATIN qui/LATIN"),
    ("fr", "L’œuf jusqu’au soir", "L’/PREFIX œuf/LATIN jusqu’/PREFIX au/LATIN soir/LATIN"),
    ("fr", "Rendez-vous là-bas, viendras-tu", "Rendez-vous/LATIN là-bas/LATIN ,/SYM viendras/LATIN -tu/SUFFIX"),
    ("fr", "n'y a-t-on d’ACCORD", "n'/PREFIX y/LATIN a/LATIN -t-on/SUFFIX d’ACCORD/LATIN"),
    ("de", "Hans' Katze (ein)gehen 3²", "Hans/LATIN '/SYM Katze/LATIN (ein)gehen/LATIN 3²/LATIN"),
    ("de", "Seite 12–14 und 7:30", "Seite/LATIN 12–14/NUM und/LATIN 7:30/NUM"),
    ("en", "ping 10.0.0.7, v2.0-beta", "ping/LATIN 10.0.0.7/NUM ,/SYM v2.0-beta/LATIN"),
    ("en", "(un)do pro(s) <b>x</b>", "(un)do/LATIN pro(s)/LATIN </SYM b/LATIN >/SYM x/LATIN </SYM //SYM b/LATIN >/SYM"),
    ("en", "€9.99/kg ~5°C", "€/SYM 9.99/NUM //SYM kg/LATIN ~/SYM 5°/LATIN C/LATIN"),
    ("es", "¿Qué? ¡Ya! l'eau", "¿/UNK Qué/LATIN ?/SYM ¡/UNK Ya/LATIN !/SYM l'eau/LATIN"),
    ("en", "../lib/a.so /etcetera ~/x .", "../lib/a.so/PATH /etc/PATH etera/LATIN ~/SYM //SYM x/LATIN ./SYM"),
    ("en", "Ph.D. a.m., U.S.-led", "Ph.D/ABBR ./SYM a.m/ABBR ./SYM ,/SYM U.S.-led/LATIN"),
    ("en", "who@where.example? ftp.host.net/x HTTP://A/b!", "who@where.example/EMAIL ?/SYM ftp.host.net/x/URI HTTP://A/b/URI !/SYM"),
    ("en", "'twere so; 'TIS", "'t/LATIN were/LATIN so/LATIN ;/SYM 'T/LATIN IS/LATIN"),
]


@pytest.mark.parametrize(("lang", "text", "expected"), [(g, t, e.split(" | ")) for g, t, e in TOKENS] + [(g, t, e.split()) for g, t, e in MORE])
def test_cases(lang, text, expected):
    assert [f"{s}/{t}" for s, _, _, t in tokenize(text, lang)] == expected


@pytest.mark.parametrize("text", ["@.", "1", "a1", "a", "1 ", "a@b.c ", "./", "x.", "a@", "(1)", "1/", "+1 (", "www.☃", "ftp.a.", "a://☃", "/tmp/☃", "((", "``"])
def test_long_texts_take_time_in_proportion(text):
    """A megabyte of signs that many patterns could begin with."""
    start = time.time()
    assert sum(1 for _ in scanner("en").scan(text * ((1 << 20) // len(text)))) > 0
    assert time.time() - start < 60


@pytest.mark.parametrize(
    ("text", "numbers"),
    [("(1)2", ["(1)2"]), ("5-5", ["5-5"]), ("1 2 (3)", ["1 2", "3"]), ("/12-3", ["/12", "-3"]), ("+1(20)3x", ["+1(20)3"]), ("+12 (3)4", ["+12 (3)4"]), ("(1)(2)", ["1", "2"]), ("12(3)(4)5", ["12(3)(4)5"])],
)
def test_chains_of_digit_groups(text, numbers):
    assert [s for s, _, _, t in tokenize(text, "en") if t == "NUM"] == numbers


def test_byte_order_mark_counts():
    assert tokenize("\ufeffstart", "en") == [("start", 5, 3, "LATIN")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé'’-.,:;!?()\"«»`@/0195%&+=<>~_\n\t°²हó☃\u200b﹒‐"), max_size=40), st.sampled_from(["en", "fr", "it", "de", None]))
def test_tokens_cover_all_but_blanks(text, lang):
    data, at = text.encode(), 0
    for s, n, offset, kind in tokenize(text, lang):
        assert offset >= at and data[at:offset].decode().strip(" \n\t\u200b") == ""
        assert data[offset : offset + n].decode() == s and kind in TYPES
        at = offset + n
    assert data[at:].decode().strip(" \n\t\u200b") == ""
