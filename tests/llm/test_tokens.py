"""Encoding by remembered pre-tokens equals whole-text encoding by the library."""

import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.odd import TEXTS

from tidelog.llm import tokens
from tidelog.llm.tokens import Encoder, public_path

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ENCODERS = {n: Encoder(public_path(n), memo=500) for n in NAMES}


def whole(encoder, texts):
    return [b"" if not t else w for t, w in zip(texts, encoder._whole([t or "" for t in texts]))]


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts(name):
    for _ in range(2):
        assert ENCODERS[name].encode(TEXTS) == whole(ENCODERS[name], TEXTS)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzAEIt 's'_-.,!?019\n\t\r  éßÖñœ<|>dlmrv"), max_size=60), max_size=6))
def test_any_text(name, texts):
    assert ENCODERS[name].encode(texts) == whole(ENCODERS[name], texts)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_any_unicode(name, texts):
    assert ENCODERS[name].encode(texts) == whole(ENCODERS[name], texts)


def test_memory_stays_bounded():
    e = Encoder(public_path(NAMES[0]), memo=50)
    for i in range(20):
        texts = [f"word{chr(97 + i)} other{chr(97 + i)} the and of in to {i}"]
        assert e.encode(texts) == whole(e, texts)
        assert len(e._known) <= 50


def test_words_with_a_space_of_any_kind_are_learned_together():
    e = Encoder(public_path("byte_bpe_50k.json"))
    calls, library = [], e._whole
    e._whole = lambda texts: calls.append(len(texts)) or library(texts)
    texts = [f"x {i} --{'=' * (i % 7)} end" for i in range(500)]
    assert e.encode(texts) == library(texts)
    assert sum(calls) < 50  # not one call for each number


@pytest.mark.parametrize("name", NAMES)
def test_known_pretokens_are_looked_up_without_an_object_for_each(name):
    e = Encoder(public_path(name))
    text = "the cat's 12 -- of a house\n" * 200_000
    e.encode([text])
    tracemalloc.start()
    got = e.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(text) + len(got[0])
    assert got == whole(e, [text])


def test_pretokens_of_any_length_and_forgotten_words():
    for name in NAMES:
        e = Encoder(public_path(name), memo=40)
        for n in range(1, 40):
            texts = [f"{'x' * n} {'=' * n}{' ' * n}'{'s' * n} {'é' * n}\n{'ab ' * n}", "'" * n, " " * n, "\n" * n + "a"]
            assert e.encode(texts) == whole(e, texts)
            assert len(e._known) <= 40


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab1'sre_-.\n\t\r  é"), max_size=200))
def test_long_texts_are_cut_between_pretokens(name, text):
    e, group = ENCODERS[name], tokens.GROUP
    tokens.GROUP = 9
    try:
        got = e.encode([text, "1 2 'd 3", text])
    finally:
        tokens.GROUP = group
    assert got == whole(e, [text, "1 2 'd 3", text])
