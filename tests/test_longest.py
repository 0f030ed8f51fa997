"""Where the engine's longest match and the SQL twins' leftmost-first one part ways."""

import time

from lexiloom.operators.sentences import MAX_TOKENS, bayes_sentences, rule_sentences
from lexiloom.operators.tokens import tokenize


def test_a_number_takes_blanks_and_periods_in_any_order():
    assert [s for s, *_ in tokenize("a 4495589438270767 42.73.240.87 b", "en")] == ["a", "4495589438270767 42.73.240.87", "b"]


def test_a_sentence_is_cut_before_the_period_of_its_last_token():
    first, second = rule_sentences("ñrrja. " * (MAX_TOKENS + 3), "es")[:2]
    assert len(first) == MAX_TOKENS and first[-2][0] == "ñrrja." and first[-1][0] == "ñrrja" and second[0][0] == "."


def test_a_long_run_of_single_signs_takes_time_in_proportion():
    start = time.time()
    assert len(tokenize("%" * 300_000 + "x", "en")) == 300_001
    assert time.time() - start < 30


def test_a_break_behind_the_period_at_which_a_sentence_is_cut_ends_nothing_more():
    found = bayes_sentences("A " * (MAX_TOKENS + 2) + "a.\n\nB b.", "en", lambda _, right: right[0] == "")
    assert [len(s) for s in found] == [MAX_TOKENS, 7]
