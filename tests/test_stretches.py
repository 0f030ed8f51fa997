"""Plain words in a row are taken at once where only the tokens around periods are asked for."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiloom.operators.segment import _contexts_of
from lexiloom.operators.tokens import scanner, tokenize, typed

PIECES = [*"ab Zé'-.,:;!?()\"@/01%&$*#|`\n\t°²ó☃\u0301", " foo", " bar", ". ", " .", "!!", " ### ", "www.", "://", "...", " x, y; z: ", "&c", "e.g", " of the house, all ***"]


def by_tokens(text, lang):
    none = ("", "UNK")
    tokens = [none, none, *[(s, t) for s, _, _, t in tokenize(text, lang)], none, none]
    return [(i - 2, *tokens[i - 2], *tokens[i - 1], *tokens[i + 1], *tokens[i + 2]) for i in range(2, len(tokens) - 2) if tokens[i][0] == "."]


def test_a_stretch_of_plain_words_is_one_step():
    text = "a house of many words, with signs*** and ### so on " * 100 + "ends."
    assert len(list(scanner("en").scan(text, stretches=True))) == 3
    assert _contexts_of(text, "en") == by_tokens(text, "en") != []


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.sampled_from(["en", "fr", "it", "de", None]))
def test_contexts_are_those_of_the_tokens(text, lang):
    assert _contexts_of(text, lang) == by_tokens(text, lang)


@pytest.mark.parametrize(("text", "expected"), [("a ### b", "LATIN UNK LATIN"), ("a#|! b.***", "LATIN UNK SYM LATIN SYM SYM"), ("x,### |", "LATIN SYM UNK UNK"), ("a#b ##c", "LATIN UNK LATIN UNK LATIN")])
def test_common_signs_behind_words(text, expected):
    assert [t for _, t in typed(text, "en")] == expected.split()


@pytest.mark.parametrize("text", ["a", "a ", "%", "a%", "a,", "| ", "a. ", "a.b ", "#%"])
def test_long_texts_take_time_in_proportion(text):
    start = time.time()
    _contexts_of(text * ((1 << 20) // len(text)), "en")
    assert time.time() - start < 30
