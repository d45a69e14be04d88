"""Operator 7: quality rules, line by line first and then by what is left of the document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.llm._shared import slices, text_bytes
from meterlark.llm._words import Words, mixed

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Phrases of page furniture, in lower case.
BOILERPLATE = ("cookie", "javascript", "terms of use", "terms of service", "privacy policy", "all rights reserved", "copyright", "licensed under", "released under the", "lorem ipsum", "sign in", "sign up", "subscribe", "powered by")
TERMINAL = tuple(".!?…:;\"'”’»)]")
MARKS = "#*$%&|<>{}\\^~="
BARS = "|›»•"


def line_fails(line: str, words: int, marked: bool, phrased: bool) -> str | None:
    """The first rule that a line with words fails, or None: navigation, symbols, shouting, boilerplate, punctuation.

    marked and phrased: whether the text has any of MARKS or BARS, and any of BOILERPLATE.
    """
    if marked:
        bars = sum(map(line.count, BARS))
        if bars >= 3 and 4 * bars >= words:
            return "navigation"
        if 12 * sum(map(line.count, MARKS)) > len(line):
            return "symbols"
    if words >= 5 and line.isupper():
        return "shouting"
    if phrased and any(map(line.lower().__contains__, BOILERPLATE)):
        return "boilerplate"
    if words < 4 and not line.rstrip().endswith(TERMINAL):
        return "punctuation"
    return None


def clean_lines(text: str, least_share: float, least_words: int) -> tuple[str, bool, int, int]:
    """(text without repeated and failing lines, whether the document stays, lines removed, lines equal to an earlier one)."""
    marked, phrased = any(map(text.__contains__, MARKS + BARS)), any(map(text.lower().__contains__, BOILERPLATE))
    kept, seen, all_words, left, removed, repeated = [], set(), 0, 0, 0, 0
    for line in text.split("\n"):
        n = len(line.split())
        if not n:
            if line.strip(" \t\x0b\x0c\r"):  # white space to Python, yet a word here
                repeated += line in seen
                seen.add(line)
            kept.append(line)
            continue
        all_words += n
        if line in seen:
            repeated += 1
            removed += 1
        elif line_fails(line, n, marked, phrased):
            removed += 1
            seen.add(line)
        else:
            kept.append(line)
            left += n
            seen.add(line)
    return "\n".join(kept), left >= least_words and left >= least_share * all_words, removed, repeated


def repeats(words: Words, k: int = 5) -> np.ndarray:
    """For each text, the words in windows of k words that the text holds twice or more, first ones included."""
    n = len(words.start)
    if not n:
        return np.zeros(len(words.count), np.int64)
    at = np.flatnonzero(words.fits(k))
    key = mixed(words.windows(words.hashes(), k)[at] + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + k] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[words.first[1:]] - covered[words.first[:-1]]


def judge_quality(docs: DataFrame, *, least_share: float = 0.5, least_words: int = 10, cleaned: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_lines.

    base_failed: fewer than 10 words, or over 20 % of them in repeated 5-word windows.  kept: not base_failed, and
    after the line rules at least least_words words and least_share of all words are left.
    cleaned adds `clean_text` (null where text is null).  Null text: no words, not kept.  Null ids stay null;
    repeated rows repeat; an empty table gives an empty one; other columns are ignored.  Map-only.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches):
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            words = Words(data, offsets)
            total = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[offsets[1:]] - c[offsets[:-1]]
            chars = total(words.inside & ((data & 0xC0) != 0x80))
            symbols, repeated = total(SYMBOLS[data]), repeats(words)
            failed = (words.count < 10) | (100 * repeated > 20 * words.count)
            dup, kept, removed, texts = [], [], [], []
            for text, bad in zip(part.column("text").to_pylist(), failed.tolist(), strict=True):
                clean, stays, gone, again = clean_lines(text or "", least_share, least_words)
                dup.append(again)
                kept.append(stays and not bad)
                removed.append(gone)
                texts.append(None if text is None else clean)
            columns = {"doc_id": part.column("doc_id"), "n_words": pa.array(words.count), "word_chars": pa.array(chars, pa.int64()), "n_symbols": pa.array(symbols, pa.int64()), "n_dup_lines": pa.array(dup, pa.int64()), "n_repeat_words": pa.array(repeated, pa.int64()), "base_failed": pa.array(failed), "kept": pa.array(kept, pa.bool_()), "n_removed_lines": pa.array(removed, pa.int64())}
            if cleaned:
                columns["clean_text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_removed_lines long"
    return rows.mapInArrow(work, schema + ", clean_text string" * cleaned)
