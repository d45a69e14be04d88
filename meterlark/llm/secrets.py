"""Operator 10: secrets in texts, by sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlark.llm._shared import slices
from meterlark.llm._spans import Span, listed, uncovered

ORDER = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A cheap necessary sign of an assignment.
NAMED = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Known harmless shapes: digits alone, dates and UUIDs, letters of one case, words (capitals within, too) joined by marks, paths, one repeated unit.
ALLOWED = [
    re.compile(r"[0-9_=+/-]+"),
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[a-z+/_=-]+|[A-Z+/_=-]+"),
    re.compile(r"(?:[+/_=-]++|[A-Z]*+[a-z]{2,}+|[A-Z][a-z](?=[+/_=-]|$|(?:[A-Z][a-z])?[A-Z][a-z]{3})|[A-Z]{2,}+|(?<![A-Za-z])[A-Za-z](?![A-Za-z]))++"),  # linear: nothing is tried anew
    re.compile(r"(.{1,8}?)\1+.{0,7}"),
]
#: (class, characters, least entropy in bits of a full window): per character class.
CLASSES = [("hex", frozenset("0123456789abcdefABCDEF"), 2.6), ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.5)]
WINDOW = 20
_LOG = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 2)]  # the next character comes before the oldest goes


def high_entropy(text: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Runs covered by windows of at least that entropy; counts are kept up as the window moves on."""
    counts: dict[str, int] = {}
    total, runs = 0.0, []  # total: sum of n log n over the characters in the window
    log = _LOG if window == WINDOW else [0.0] + [n * math.log2(n) for n in range(1, window + 2)]
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += log[n + 1] - log[n]
        if i >= window:
            old = text[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += log[n - 1] - log[n]
        if i >= window - 1 and math.log2(window) - total / window >= least:
            start = i - window + 1
            if runs and start <= runs[-1][1]:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((start, i + 1))
    return runs


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping per kind; a failing match is dropped and not tried anew."""
    out: list[Span] = []
    lower = text.lower()
    if any(x in lower for x in NAMED):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def entropy_spans(text: str) -> list[Span]:
    """Candidate strings of the narrowest fitting class with a window of high entropy, less the allow-listed."""
    out: list[Span] = []
    for m in CANDIDATE.finditer(text):
        found = m[0]
        if any(x.fullmatch(found) for x in ALLOWED):
            continue
        characters = set(found)
        least = next(bits for _, allowed, bits in CLASSES if characters <= allowed)
        if high_entropy(found, least):
            out.append(("entropy", m.start(), m.end()))
    return out


KINDS = ("assign", "access", "hex")


def secrets_of(text: Column, redact: bool = False) -> Column:
    """n_assign, n_access, n_hex, base, spans, n_spans (and redacted) of a text column as a struct; other columns of the row stay in the JVM."""
    fields = [(f"n_{k}", T.LongType(), pa.int64()) for k in KINDS] + [(c, T.StringType(), pa.string()) for c in ("base", "spans")] + [("n_spans", T.LongType(), pa.int64())] + [("redacted", T.StringType(), pa.string())] * redact

    @F.arrow_udf(T.StructType([T.StructField(name, kind) for name, kind, _ in fields]))
    def work(column: pa.Array) -> pa.Array:
        out = []
        for part in slices([pa.RecordBatch.from_arrays([column], names=["text"])], "text"):
            counts: tuple[list[int], ...] = ([], [], [])
            base, every, total, masked = [], [], [], []
            for x in part.column("text").to_pylist():
                known = base_spans(x or "")
                spans = known + [part for _, parts in uncovered(entropy_spans(x or ""), known) for part in parts]
                for n, kind in zip(counts, KINDS, strict=True):
                    n.append(sum(s[0] == kind for s in known))
                base.append(listed(known, ORDER))
                every.append(listed(spans, ORDER))
                total.append(len(spans))
                masked.append(redacted(x, spans) if redact else None)
            columns = [*counts, base, every, total, *[masked] * redact]
            out.append(pa.StructArray.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(columns, fields, strict=True)], names=[name for name, _, _ in fields]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([(name, t) for name, _, t in fields]))

    return work(text)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base (spans as text), spans (base and entropy spans), n_spans.

    Spans count code points, end exclusive; entropy spans are cut where base spans lie.  redact adds `redacted`: the text
    with each span (overlaps merged) replaced by `[SECRET]`, null where the text is null.
    Null text: empty, no spans.  Null ids stay null; repeated rows repeat; an empty table gives an empty one; other
    columns are ignored.  Whole texts are scanned, in time linear in their length.  Map-only.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), secrets_of(F.col(text_col).cast("string"), redact).alias("_s"))
    return rows.select("doc_id", "_s.*")


def redacted(text: str | None, spans: list[Span]) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]
