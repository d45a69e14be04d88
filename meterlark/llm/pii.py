"""Operator 6: personal data, by fixed patterns and a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.llm._shared import slices
from meterlark.llm._spans import Span, free_of, listed

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its start alone: later starts in it meet the same characters after it.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9]){11,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Found from each @: the longest local part that touches no earlier match, then the domain."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping per kind; failing matches are dropped, not tried anew."""
    out = emails(text) if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return out


# --- the field -------------------------------------------------------------------------------------------------

#: The labelled table: words with their kind after a bar; words without one are ordinary.  Fixed values.
LABELLED = """
write to anna.lee|email @|email example.org|email before noon
contact: joe|email (at)|email mail.example|email please
mail kim.o|email at|email post|email dot|email example|email dot|email org|email now
or lena|email [at]|email shop|email [dot]|email example|email or call
email: p.roy|email (at)|email corp|email (dot)|email example|email thanks
send it to tom_b|email @|email lists.example.com|email and wait
mail me at max|email [at]|email post.example.net|email today
reach sue.ng|email AT|email corp.example|email or call
meet at noon and dot the page with ink
we were at home at 7 and at 9 again
contact ed_k|email at|email board|email dot|email example|email dot|email net|email by post
reach us: info|email @|email club.example.org|email all week
write to uwe.m|email @|email firm.example|email for more
she put a dot at each end of line 3
look at the dot on page 4 at once
call 0049|phone 30|phone 901820|phone tomorrow
phone (555)|phone 013-4477|phone is mine
tel. 020|phone 7946|phone 0018|phone in London
ring 555-0142|phone at night
phone: 030-5550199|phone for help
fax 0044-20-7946-0991|phone or post
my mobile 07700|phone 900461|phone works
call me on 555|phone 018|phone 2231|phone please
dial 0161|phone 496|phone 0203|phone after six
her number is 030|phone 23125|phone 004|phone or so
text (0131)|phone 496|phone 0774|phone any time
office 555-0188|phone or home 555-0143|phone today
host 10|ip .|ip 4|ip .|ip 0|ip .|ip 17|ip failed
address 192[.]168[.]3[.]44|ip was seen
server 172(.)16(.)9(.)1|ip is down
ping 10[.]0[.]7[.]250|ip now
from 192|ip .|ip 0|ip .|ip 2|ip .|ip 235|ip at 14:02
node 198[dot]51[dot]100[dot]7|ip rebooted
seen at 203(.)0(.)113(.)9|ip twice
card 4539_1488_0343_6467|card expired
visa 5500/0000/0000/0004|card declined
card no. 4012.8888.8888.1881|card was used
pay with 3714_4963_5398_431|card here
order 48213 has 3 items of 12 kg
in 1999 and 2004 there were 1,200 people
chapter 12 section 4.2 page 301
version 3.11.4 of 2023-10-05 is out
the year 1984 and room 101 are far
on 12.05.2021 at 14:30 we met
total 12,345.67 was paid in 2019
isbn 978-3-16-148410-0 is a book
item 100200300 costs 49.99 now
figure 7.1.2 shows 88% of 450 cases
serial 8841-2231-9910 on the label
id 20230415 with 17 parts and 3 more
9807915762804491 was counted twice
the ratio 3:2 or 16/9 and 0.75 apply
lines 120-140 and 7 to 12 of 2001
about 3 000 000 people in 2011 lived there
score 21 19 21 17 after 4 games
the set of 4 . 5 and 6 . 7 was open
from 10 to 20 . 30 more came in 1950
number 12 of 300 at 45 degrees
call number 4 of page 17 was wrong
text 3 and text 12 of volume 2
from 1914-1918 and 1939-1945 at war
"""
CUES = {"phone": frozenset("call phone tel tel. telephone mobile fax ring cell dial number office".split()), "card": frozenset("card visa mastercard amex credit".split()), "ip": frozenset("ip host server ping address".split()), "email": frozenset("mail email e-mail contact write reach".split())}
KNOWN = frozenset("at (at) [at] @ dot (dot) [dot] . no.".split())
LABELS = ("",) + KINDS


def features(words: list[str]) -> list[list[str]]:
    """Word shapes, digit counts and cues of each word and its neighbours."""
    own = []
    for w in words:
        bare = w.strip(",;:!?\"'")
        digits = sum("0" <= c <= "9" for c in bare)
        shape = re.sub(r"9+", "9", re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]", "9", bare))))[:12] if digits or "@" in bare else ("a" if bare.isalpha() else shape_of(bare))
        size = "d" + ("0" if not digits else "1-3" if digits < 4 else "4-6" if digits < 7 else "7-11" if digits < 12 else "12+")
        kinds = [f"cue={k}" for k, v in CUES.items() if bare.lower().rstrip(":") in v]
        known = [f"word={bare.lower()}"] if bare.lower() in KNOWN else []
        quads = ["quad"] if re.fullmatch(r"[0-9]{1,3}([\[(](\.|dot)[\])][0-9]{1,3}){3}", bare) else []
        cards = ["cardlike"] if 12 <= digits <= 19 and re.fullmatch(r"[0-9_/.]+", bare) and not bare.isdigit() and luhn(re.sub("[^0-9]", "", bare)) else []
        domain = ["domain"] if re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", bare) and not digits == len(bare.replace(".", "")) else []
        zero = ["zero"] if bare.startswith("0") and digits > 1 else []
        own.append([f"s={shape}", size, *kinds, *known, *quads, *cards, *domain, *zero])
    out = []
    for i, f in enumerate(own):
        near = [f"-1:{x}" for x in own[i - 1]] if i else ["-1:start"]
        near += [f"+1:{x}" for x in own[i + 1]] if i + 1 < len(own) else ["+1:end"]
        out.append(["bias", *f, *near])
    return out


def shape_of(word: str) -> str:
    return "m" if not any(c.isalnum() for c in word) else "x"


class Field:
    """A linear-chain conditional random field over features(): trained by likelihood, decoded by Viterbi."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LABELS)))
        for i, f in enumerate(features(words)):
            ids = [self.names[x] for x in f if x in self.names]
            out[i] = self.emit[ids].sum(0)
        return out

    def decode(self, lines: list[list[str]]) -> list[list[int]]:
        """The best labels of each line.

        A line of more than SPAN words is decoded in windows of so many with MARGIN more on both sides.  Windows of
        like length are worked off together, at most CELLS words at a time, however long the lines are.
        """
        out = [[0] * len(x) for x in lines]
        windows = [(max(0, at - MARGIN), at, min(len(x), at + SPAN), min(len(x), at + SPAN + MARGIN), i) for i, x in enumerate(lines) for at in range(0, len(x), SPAN)]
        windows.sort(key=lambda w: w[3] - w[0])
        while windows:
            longest = windows[-1][3] - windows[-1][0]
            group = windows[-max(1, CELLS // longest) :]
            del windows[-len(group) :]
            for (first, start, end, _, i), labels in zip(group, self._best([lines[w[4]][w[0] : w[3]] for w in group]), strict=True):
                out[i][start:end] = labels[start - first : end - first]
        return out

    def _best(self, lines: list[list[str]]) -> list[list[int]]:
        """Viterbi for lines of like length, padded to one block."""
        longest, k = max(map(len, lines)), len(LABELS)
        emit = np.zeros((len(lines), longest, k))
        for i, words in enumerate(lines):
            emit[i, : len(words)] = self.scores(words)
        size = np.array([len(x) for x in lines])
        best = emit[:, 0]
        back = np.zeros((longest, len(lines), k), np.int8)
        for t in range(1, longest):
            through = best[:, :, None] + self.move[None]
            back[t] = through.argmax(1)
            best = np.where((t < size)[:, None], through.max(1) + emit[:, t], best)
        out = []
        for i, n in enumerate(size):
            y = [int(best[i].argmax())]
            for t in range(n - 1, 0, -1):
                y.append(int(back[t, i, y[-1]]))
            out.append(y[::-1])
        return out


#: A labelled line: its words, and the kind of each (empty: ordinary).
Line = tuple[tuple[str, str], ...]


def default_lines() -> tuple[Line, ...]:
    """LABELLED as lines."""
    pairs = lambda line: tuple((w.rpartition("|")[0], w.rpartition("|")[2]) if w.rpartition("|")[2] in KINDS else (w, "") for w in line.split())
    return tuple(map(pairs, LABELLED.strip().splitlines()))


def lines_of(labelled: DataFrame, most: int = 2000) -> tuple[Line, ...]:
    """The lines of a labelled table (line, place, word, kind; a null or unknown kind: ordinary), the first `most` by line.

    That bound is what reaches the driver; the table is meant to be small.  Rows with a null line or word are left out.
    """
    words = labelled.where("line is not null and word is not null").groupBy("line").agg(F.sort_array(F.collect_list(F.struct("place", "word", "kind"))).alias("words"))
    found = words.orderBy("line").limit(most).collect()
    return tuple(tuple((w["word"], w["kind"] if w["kind"] in KINDS else "") for w in r["words"]) for r in found)


@lru_cache(maxsize=4)
def train(labelled: tuple[Line, ...] | None = None, rounds: int = 200, rate: float = 0.3, weight: float = 0.02) -> Field:
    """The field of the most likely labels of the labelled lines (by default LABELLED), with L2 weight, by gradient steps (Adagrad)."""
    lines = [([w for w, _ in line], [LABELS.index(k) for _, k in line]) for line in (default_lines() if labelled is None else labelled) if line]
    feats = [features(w) for w, _ in lines]
    names = {f: i for i, f in enumerate(sorted({f for line in feats for word in line for f in word}))}
    ids = [[np.array([names[f] for f in word]) for word in line] for line in feats]
    k = len(LABELS)
    emit, move = np.zeros((len(names), k)), np.zeros((k, k))
    seen_e, seen_m = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    for _ in range(rounds):
        ge, gm = -weight * emit, -weight * move
        for line, (_, labels) in zip(ids, lines, strict=True):
            s = np.array([emit[w].sum(0) for w in line])
            n = len(s)
            forward, backward = np.zeros((n, k)), np.zeros((n, k))
            forward[0] = s[0]
            for t in range(1, n):
                forward[t] = np.logaddexp.reduce(forward[t - 1][:, None] + move, axis=0) + s[t]
            for t in range(n - 2, -1, -1):
                backward[t] = np.logaddexp.reduce(move + (s[t + 1] + backward[t + 1])[None], axis=1)
            z = np.logaddexp.reduce(forward[-1])
            p = np.exp(forward + backward - z)
            for t, w in enumerate(line):
                ge[w] -= p[t]
                ge[w, labels[t]] += 1
                if t:
                    gm -= np.exp(forward[t - 1][:, None] + move + (s[t] + backward[t])[None] - z)
                    gm[labels[t - 1], labels[t]] += 1
        seen_e += ge**2
        seen_m += gm**2
        emit += rate * ge / np.sqrt(seen_e)
        move += rate * gm / np.sqrt(seen_m)
    return Field(names, emit, move)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Every label needs a digit, an at sign or such a word nearby; a segment is the words up to REACH around such a sign.
SIGN = re.compile(r"[0-9@]|[(\[][aA][tT][)\]]| AT |[ (\[][dD][oO][tT][ )\]]")
REACH = 6
#: Words of a window and those around it, words decoded together, characters of a piece of a line and those around it.
SPAN, MARGIN, CELLS, PIECE, AROUND = 64, 8, 1 << 14, 1 << 15, 256


def pieces(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, start of its own, end of its own) of each line with a sign; longer lines in pieces that overlap."""
    at = 0
    for line in text.split("\n"):
        if SIGN.search(f" {line} "):
            for own in range(0, len(line), PIECE):
                start, end = max(0, own - AROUND), min(len(line), own + PIECE + AROUND)
                yield at + start, at + end, at + own, at + min(len(line), own + PIECE)
        at += len(line) + 1


def segments(text: str, start: int, end: int) -> list[list[tuple[str, int, int]]]:
    """Words around signs between two places of a text; neighbouring segments are one."""
    words = [(m[0], m.start(), m.end()) for m in WORD.finditer(text, start, end)]
    out: list[list[tuple[str, int, int]]] = []
    upto = 0  # words before this one are in a segment
    for i, w in enumerate(words):
        if SIGN.search(f" {w[0]} "):
            lo, hi = max(0, i - REACH), min(len(words), i + REACH + 1)
            if out and lo < upto:
                out[-1] += words[upto:hi]
            else:
                out.append(words[lo:hi])
            upto = hi
    return out


#: White space at most on either side of an address's `at`, `dot` or bracket; wider gaps (padding of tables, say) end an address.
GAP = 16
_GAP = rf"\s{{0,{GAP}}}+"
# possessive throughout, so that each character is looked at a bounded number of times
EMAIL = re.compile(rf"[A-Za-z0-9._%+-]++{_GAP}(@|[(\[]?{_GAP}at{_GAP}[)\]]?){_GAP}[A-Za-z0-9-]++((\.|{_GAP}[(\[]?{_GAP}dot{_GAP}[)\]]?{_GAP})[A-Za-z0-9-]++)++", re.IGNORECASE | re.ASCII)


def holds(kind: str, found: str) -> bool:
    """The rules that the fixed patterns hold a kind to, for spans of other shapes: parts, Luhn's sum, numbers of digits."""
    digits = sum("0" <= c <= "9" for c in found)
    if kind == "email":
        return bool(EMAIL.fullmatch(found))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= digits <= 19 and luhn(re.sub("[^0-9]", "", found))
    return 7 <= digits <= 15 and not any(c.isalpha() for c in found)


def _spans_in(field: Field, text: str, parts: list[tuple[list[tuple[str, int, int]], int, int]]) -> Iterator[Span]:
    """Runs of one label in the best labelling, trimmed of marks around them; those that begin in a piece's own range."""
    for (words, own, end), labels in zip(parts, field.decode([[w[0] for w in x] for x, _, _ in parts]), strict=True):
        i = 0
        while i < len(labels):
            j = i
            while j < len(labels) and labels[j] == labels[i]:
                j += 1
            if labels[i] and own <= words[i][1] < end:
                a, b = words[i][1], words[j - 1][2]
                while a < b and text[a] in ",;:!?\"'":
                    a += 1
                while b > a and text[b - 1] in ",;:!?\"'.":
                    b -= 1
                if holds(LABELS[labels[i]], text[a:b]):
                    yield LABELS[labels[i]], a, b
            i = j


def field_spans(field: Field, text: str) -> list[Span]:
    """What the field finds in a text, worked off about CELLS words at a time."""
    out: list[Span] = []
    parts: list[tuple[list[tuple[str, int, int]], int, int]] = []
    size = 0
    for start, end, own, own_end in pieces(text):
        for words in segments(text, start, end):
            parts.append((words, own, own_end))
            size += len(words)
        if size >= CELLS:
            out += _spans_in(field, text, parts)
            parts, size = [], 0
    out += _spans_in(field, text, parts)
    return out


def find_pii(docs: DataFrame, *, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (fixed patterns), base, spans (as text), n_spans.

    spans has the base spans and those the field adds where no base span is; code points, end exclusive; n_spans is their number.
    Null text: empty, no spans.  Null ids stay null; repeated rows repeat; an empty table gives an empty one; other
    columns are ignored.  Texts of any length are read whole, with memory for a piece of a line and a bounded number of words.
    Of two labels of equal score the first of LABELS stands.  The field is trained on the driver from a small labelled
    table (see lines_of; by default the one above), which takes a few seconds, and sent with the task.  Map-only.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    field = train(None if labelled is None else lines_of(labelled))

    def work(batches):
        for part in slices(batches, "text"):
            counts: tuple[list[int], ...] = ([], [], [], [])
            base, every, total = [], [], []
            for text in part.column("text").to_pylist():
                known = base_spans(text or "")
                added = free_of(field_spans(field, text), known) if text and SIGN.search(f" {text} ") else []
                for column, kind in zip(counts, KINDS, strict=True):
                    column.append(sum(s[0] == kind for s in known))
                base.append(listed(known, ORDER))
                every.append(listed(known + added, ORDER))
                total.append(len(known) + len(added))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in counts), pa.array(base, pa.string()), pa.array(every, pa.string()), pa.array(total, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_spans"],
            )

    return rows.mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_spans long")
