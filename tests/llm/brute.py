"""The contracts of the text operators, spelled out plainly in Python."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def token_counts(docs, path, limit=1024):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    out = []
    for i, text in docs:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        out.append((i, len((text or "").encode()), n, n > limit))
    return out


def substrings(docs, k=13):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    least: dict[tuple, int] = {}
    for i, w in words:
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if least[tuple(w[a : a + k])] < i:
                gone[a : a + k] = [True] * k
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}


def near(docs, part=85, whole=100):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and whole * len(s & t) >= part * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in sets]


def contamination(docs, items, k=13):
    split = lambda t: PLAIN_WORD.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        for a in range(max(1, len(w) - k + 1)) if w else ():
            windows[tuple(w[a : a + k])].add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for i, text in docs:
        w = split(text)
        hit, met = [False] * len(w), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit[a : a + n] = [True] * n
                    met |= found
        out.append((i, len(w), sum(hit), len(met), sha(",".join(sorted(met))), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def listed(spans, order):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order.index(s[0]))))


def personal(docs):
    kinds = ["email", "ip", "card", "phone"]
    out = []
    for i, text in docs:
        text = text or ""
        spans = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        spans += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                spans.append(("card", m.start(), m.end()))
        spans += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        n = Counter(s[0] for s in spans)
        out.append((i, *(n[k] for k in kinds), sha(listed(spans, kinds))))
    return out


def quality_base(docs):
    out = []
    for i, text in docs:
        text = text or ""
        w = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
        twice = [False] * len(w)
        for a in range(len(w) - 4):
            if grams[tuple(w[a : a + 5])] > 1:
                twice[a : a + 5] = [True] * 5
        r = sum(twice)
        out.append((i, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, r, len(w) < 10 or 100 * r > 20 * len(w)))
    return out


def secrets(docs):
    kinds = ["assign", "access", "hex"]
    out = []
    for i, text in docs:
        text = text or ""
        assign = r"""((?ia:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        spans = [("assign", m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        n = Counter(s[0] for s in spans)
        out.append((i, *(n[k] for k in kinds), sha(listed(spans, kinds))))
    return out


def ids_of(path, end=1):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return lambda text: library.encode(text or "", add_special_tokens=False).ids + [end]


def packed_rightly(docs, pieces, path, size=2048):
    """pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).  Distinct doc ids are assumed."""
    encode, of = ids_of(path), defaultdict(list)
    for p in pieces:
        of[p[0]].append(p)
    assert set(of) == {i for i, _ in docs}
    for i, text in docs:
        ids, at = encode(text), 0
        for _, start, length, crc, total, _, _ in sorted(of[i], key=lambda p: p[1]):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
            at += length
        assert at == len(ids)
    rows = defaultdict(list)
    for p in pieces:
        rows[p[5]].append((p[6], p[2]))
    for placed in rows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    return len(rows), sum(p[2] for p in pieces)
