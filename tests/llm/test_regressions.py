"""Inputs on which an operator once hung, or answered by its neighbours."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meterlark.llm import _coder
from meterlark.llm.language import WIDTH, grams, packed, unpacked
from meterlark.llm.pii import holds


def test_wide_gaps_take_no_time():
    start = time.monotonic()
    gap = " " * 30_000
    for text in (f"bob.k (at){gap}example{gap}dot{gap}org?x", f"bob.k{gap}at{gap}x!", "a@" + "dot" * 10_000 + "!", "at" * 10_000 + "@x!", "a@" + "b.c" * 10_000 + "!"):
        assert not holds("email", text)
    assert time.monotonic() - start < 2
    assert not holds("email", f"bob.k at{gap}example dot org")
    assert all(holds("email", x) for x in ("bob.k (at) example [dot] org", "a@b.c", "bob at example dot co dot uk", "bob (at)example(dot)org", "bob @ example.org"))


def counted(*texts):
    raw = [t.encode() for t in texts]
    return grams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_grams_of_a_text_are_its_own():
    texts = [" hello", "", "abc def\n", "  \t hello  there ", "\n", "x", "abc def"]
    for before in texts:
        for text in texts:
            assert (counted(before, text, before)[1] == counted(text)[0]).all(), (before, text)
    assert counted("abc def\n", " hello")[1].sum() == 4


def test_sampled_vectors_take_room_by_their_trigrams_and_sort_as_whole_rows():
    rows = np.log1p(counted("", "x", "abc def", "abc", "abc abc abc abd", "the end of the line\n" * 50, "Anblewh sttible athawh", "\u00e8onai aiai"))
    sent = [packed(x) for x in rows]
    assert max(map(len, sent)) < 4 * 64 < 2 * WIDTH
    assert (unpacked(sent) == rows.astype(np.float16).astype(np.float32)).all()
    whole = [x.astype(np.float16).tobytes() for x in rows]
    assert sorted(range(len(rows)), key=sent.__getitem__) == sorted(range(len(rows)), key=whole.__getitem__)


PARTS = ["the", " of", "'s", "'ll", "0", "42", ".", "--", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\xaa", "\xb2", "\xbd", "\xdf", "\xe9", "\u01c5", "\u024f", "Zq", "_", "\x00"]


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


def ids_of(vocabulary, text):
    return np.array(Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_plain_text_is_merged_whole_without_chunks(vocabulary, monkeypatch):
    text = "Anblewh sttible athawh, thonre was. \u00c8onai aiaiai\n\nretion en  ou\u00e9aieux " * 40
    expected = ids_of(vocabulary, text)
    monkeypatch.setattr(_coder.Coder, "chunk", lambda self, chunk: pytest.fail("looked up by chunk"))
    assert _coder.coder(vocabulary).merged_whole(text) == expected


@pytest.mark.parametrize("piece", [_coder.PIECE, 40])
def test_texts_merged_whole_equal_the_library(vocabulary, monkeypatch, piece):
    monkeypatch.setattr(_coder, "PIECE", piece)
    draw, library, coder = random.Random(7), Tokenizer.from_file(vocabulary), _coder.coder(vocabulary)
    texts = ["".join(draw.choices(PARTS, k=draw.randrange(1, 60))) for _ in range(4000)]
    texts += ["", "a<|endoftext|>b", "a \u4e2d b", "a \u0250 b", "x" * 5000 + " y", " " * 5000, "\n" * 5000, "a" + " \n" * 3000 + "b", "a" + "\t" * 1500 + " b", "\n" * 499 + " a", "ab " * 400]
    for text in texts:
        assert coder.merged_whole(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_endless_words_and_gaps_are_not_merged_as_one(vocabulary):
    coder, start = _coder.coder(vocabulary), time.monotonic()
    for text in ("ab" * 100_000, "\n " * 100_000, " " * 200_000, "\n" * 200_000, "\t " * 100_000):
        coder.merged_whole(text)
    assert time.monotonic() - start < 10
