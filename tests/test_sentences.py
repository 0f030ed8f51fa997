import time
import unicodedata
from unittest import mock

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiloom.operators import sentences
from lexiloom.operators.graphemes import graphemes
from lexiloom.operators.sentences import MAX_TOKENS, bayes_sentences, rule_sentences
from lexiloom.operators.tokens import tokenize
from cases import SENTENCES

# What the rules make of texts of our own.
MORE = [
    ("en", "", ""),
    ("en", "Rain fell? Yes! it did... Then sun.", "Rain fell ? | Yes ! it did ... | Then sun ."),
    ("en", "At 5 p.m. she left. He stayed.", "At 5 p.m. she left . | He stayed ."),
    ("en", "See vol. 3, pp. 4. End", "See vol. 3 , pp. 4 . | End"),
    ("fr", "Bravo!» cria-t-il. Fin.", "Bravo ! » cria -t-il . | Fin ."),
    ("en", "Version 2.0. Next one.", "Version 2.0. Next one ."),
    ("de", "Siehe z.B. Kap. drei. Ende﹒", "Siehe z.B. Kap. drei . | Ende ﹒"),
    ("en", "A?) b. C.", "A ? ) b . | C ."),
    ("en", "One \u2029 two. Three", "One | two . | Three"),
    ("en", "a\n \nb. c\n\n\nD", "a | b. c | D"),
    ("en", "[Aside.] (Again!) Done", "[ Aside . ] | ( Again ! ) | Done"),
    ("it", "L'età. È tardi…no. Sì", "L' età . | È tardi … no . | Sì"),
    ("en", "He said etc. Etc.", "He said etc. Etc ."),
    ("en", "K. Q. Zed. R", "K. Q . | Zed . | R"),
]


@pytest.mark.parametrize(("lang", "text", "expected"), [*SENTENCES, *MORE])
def test_rules(lang, text, expected):
    assert " | ".join(" ".join(t[0] for t in s) for s in rule_sentences(text, lang)) == expected


def test_limit():
    text = "so " * (MAX_TOKENS + 1)
    assert [len(s) for s in rule_sentences(text, "en")] == [MAX_TOKENS, 1]
    assert [len(s) for s in bayes_sentences(text, "en", lambda a, b: True)] == [MAX_TOKENS, 1]


HARD = {
    "apostrophes": "He left." + "'" * (1 << 20) + " Xavier came.", "quotes": "He left." + '"' * (1 << 20) + " X", "brackets": "(1)" * 350_000,
    "hosts": "www.☃" * 200_000, "list": "word, " * 175_000, "blanks": "a" + " " * (1 << 20) + "b", "dates": "1/" * 60_000, "marks": "!''" * 40_000,
    "lines": "a\r\n" * 40_000, "initials": "A. " * 40_000, "angles": "?<<" * 40_000,
}


@pytest.mark.parametrize("name", HARD)
def test_hard_texts_take_time_in_proportion(name):
    """A megabyte each (the last ones less) of what many patterns could begin with, or in which no sentence ends."""
    start = time.time()
    assert rule_sentences(HARD[name], "en") and bayes_sentences(HARD[name], "en", lambda a, b: len(b[0]) % 2 == 0)
    assert time.time() - start < 120


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "B", ".", ". ", "!", "''", "'", "(", ")", ",", "1", "\n", "\n\n", " ", "Dr. ", "a.b", "x@y.z"]), max_size=30), st.integers(2, 6))
def test_a_cut_sentence_goes_on_as_a_text_of_its_own(parts, most):
    """The scan that is remembered over cuts gives what a new scan from the cut gives."""
    text = "".join(parts)
    with mock.patch.object(sentences, "MAX_TOKENS", most):
        found = rule_sentences(text, "en")
        for s in found[:1]:
            if len(s) == most and len(found) > 1 and all(t[3] != "SUFFIX" for t in s):
                cut = s[-1][2] + s[-1][1]
                rest = rule_sentences(text.encode()[cut:].decode(), "en")
                assert [[(t, n, o + cut, k) for t, n, o, k in x] for x in rest] == found[1:]


def test_classifier_decides_and_periods_go_back():
    show = lambda f: [" ".join(t[0] for t in s) for s in bayes_sentences("Am 5. Mai. Sie ging. Ja!", "de", f)]
    assert show(lambda a, b: a[0] != "5") == ["Am 5. Mai .", "Sie ging .", "Ja !"]
    assert show(lambda a, b: False) == ["Am 5. Mai. Sie ging. Ja !"]


def test_sentences_hold_all_tokens():
    text = "One e.g. two. Three?! \"Four.\" five\n\nSix www.x.org/a.b. Seven 3.5 p. 8."
    whole = "".join(t[0] for t in tokenize(text, "en"))
    for found in (rule_sentences(text, "en"), bayes_sentences(text, "en", lambda a, b: b[0][:1].isupper())):
        assert "".join(t[0] for s in found for t in s) == whole


@pytest.mark.parametrize(
    ("text", "n"),
    [("", 0), ("हृदय", 3), ("éa", 2), ("\r\n\n", 2), ("\U0001f1eb\U0001f1f7\U0001f1e9\U0001f1ea\U0001f1e9", 3), ("각각가", 3), ("\U0001f466\U0001f3fb", 1), ("؀a", 1), ("\U0001f468\u200d\U0001f469", 2)],
)
def test_graphemes(text, n):
    found = graphemes(text)
    assert len(found) == n and "".join(g[0] for g in found) == text


def test_marks_stay_with_their_letter():
    text = unicodedata.normalize("NFD", "ÀÉÎõü")
    assert len(graphemes(text)) == 5
