"""Exact token ids of whole texts from a byte-level vocabulary file, by whole-token shortcut.

Offline, on the driver, `proven` finds the vocabulary strings that encode alone as one token.  A text is cut where a
space or other white space follows a non-space character: the pre-tokeniser never joins across such a place, so each chunk
(white space and the characters after it) is encoded on its own.  A chunk that is such a string is looked up; another is split into its
pre-tokens, those that are such strings are looked up, and only what remains is merged.  Chunks are remembered within a bound of
bytes as long as the coder lives, which is one task.

Where words seldom come again the memory costs more than it saves: `merged_whole` gives a plain Latin text to the merger as it is.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cached_property, lru_cache
from struct import pack

#: The white space of the pre-tokeniser (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Where a text may be cut: before white space that follows another character.
CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
#: White space beside a space: such texts are cut by CHUNK and not at each space.
BESIDE = sorted({pair for x in SPACE for pair in (f"{x} ", f" {x}")})
RARE = re.compile(f"[{SPACE[:1]}{SPACE[2:5]}{SPACE[6:]}]")
#: Fixed value: the pre-tokeniser's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this code point all Unicode versions agree on letters, numbers and spaces.
LATIN = "\u0250"
BEYOND = re.compile(f"[{LATIN}-\U0010ffff]")
#: Characters of a text worked off at once, and those of the longest chunk that is split here and remembered.
PIECE, LONGEST = 1 << 20, 500
#: White space that is too long to be merged here.
LONG_SPACE = re.compile(f"[{SPACE}]{{{LONGEST}}}")
#: Bytes that remembered chunks may take in a generation, and what one takes besides its characters and ids.
REMEMBERED, ENTRY = 36 << 20, 180


@dataclass
class Proven:
    """A vocabulary file and what the driver has proven of it; sent to the tasks."""

    path: str
    whole: dict[str, bytes]  # the strings that, as a text alone, encode as one token, with its id
    special: list[str]
    ranks: dict[bytes, int] | None  # for a faster merger of plain Latin text, where merge order and id order agree
    unmerged: frozenset[str]  # strings of the vocabulary that merges don't reach


@lru_cache(maxsize=4)
def proven(path: str) -> Proven:
    """The vocabulary strings that, as a text alone, encode as one token.

    Strings that are part of a character, fall into several pre-tokens, or that merges don't reach, stay out.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    kind = said.get("pre_tokenizer") or {}
    if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or said.get("normalizer"):
        raise ValueError(f"{path}: the shortcut needs a plain byte-level pre-tokeniser")
    special = [x["content"] for x in said.get("added_tokens", [])]
    known = {library.decode([i], skip_special_tokens=False): i for i in library.get_vocab(with_added_tokens=False).values()}
    whole = {s: i.to_bytes(4, "little") for s, i in known.items() if s not in special and library.encode(s, add_special_tokens=False).ids == [i]}
    return Proven(path, whole, special, _ranks(said["model"], special), frozenset(known) - frozenset(whole))


def _ranks(model: dict, special: list[str]) -> dict[bytes, int] | None:
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if made != sorted(made) or len(vocab) - len(merges) - len([x for x in special if x in vocab]) != 256:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level files write as themselves
    hidden = [x for x in range(256) if x not in set(shown)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}
    return {bytes(byte_of[c] for c in s): i for s, i in vocab.items() if s not in special}


class _Memo(dict):
    """Chunk to ids in two generations: when the newer has taken its bytes it becomes the older, whose chunks move on when met again."""

    def __init__(self, work):
        super().__init__()
        self.work, self.older, self.room = work, {}, REMEMBERED

    def __missing__(self, chunk):
        found = self.older.get(chunk)
        if found is None:
            found = self.work(chunk)
        self.room -= ENTRY + len(chunk) + len(found)
        if self.room < 0:
            self.older = dict(self)
            self.clear()
            self.room = REMEMBERED
        if len(chunk) <= LONGEST:
            self[chunk] = found
        return found


def _short(text: str) -> bool:
    """Whether the text's pre-tokens are short: it has a space in any LONGEST characters, and no such run of white space with spaces."""
    at = 0
    while len(text) - at >= LONGEST:
        at = text.rfind(" ", at, at + LONGEST) + 1
        if not at:
            return False
    return not ("  " in text or " \n" in text or RARE.search(text)) or LONG_SPACE.search(text) is None


class Coder:
    """Token ids of texts; made anew for each task, so that it takes no memory of later ones."""

    def __init__(self, table: Proven):
        self.table, self.whole = table, table.whole
        self.plain = _Memo(self.chunk)
        self.spaced = _Memo(lambda word: self.chunk(f" {word}"))

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.table.path)

    @cached_property
    def merger(self):
        import tiktoken

        return tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=self.table.ranks, special_tokens={})

    @cached_property
    def pattern(self):
        import regex

        return regex.compile(PATTERN)

    def chunk(self, chunk: str) -> bytes:
        """A chunk's ids: looked up if it is a whole token, else pre-token by pre-token."""
        if (one := self.whole.get(chunk)) is not None:
            return one
        if len(chunk) > LONGEST or max(chunk) >= LATIN or self.table.ranks is None:
            return self.alone(chunk)
        if chunk.lstrip(" ").isalpha() and chunk[1:2] != " ":
            return self.merged(chunk)
        whole = self.whole.get
        return b"".join([whole(token) or self.merged(token) for token in self.pattern.findall(chunk)])

    def merged(self, token: str) -> bytes:
        """A pre-token's ids by merging."""
        if token in self.table.unmerged:
            return self.alone(token)
        ids = self.merger.encode_ordinary(token)
        return pack(f"<{len(ids)}I", *ids)

    def alone(self, chunk: str) -> bytes:
        """A chunk's ids by the library."""
        ids = self.library.encode(chunk, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def _pieces(self, text: str):
        at = 0
        while len(text) - at > PIECE and (m := CUT.search(text, at + PIECE)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        if any(x in text for x in self.table.special):
            return self.alone(text)
        return b"".join(map(self._piece, self._pieces(text))) if len(text) > PIECE else self._piece(text)

    def merged_whole(self, text: str) -> bytes:
        """As ids(), but plain Latin text goes to the merger as a whole; any other text to ids()."""
        if not self.mergeable or any(x in text for x in self.table.special) or not (text.isascii() or BEYOND.search(text) is None):
            return self.ids(text)
        return b"".join([self._merged_piece(x) if _short(x) else self._piece(x) for x in self._pieces(text)])

    @cached_property
    def mergeable(self) -> bool:
        """Whether the merger is right for all plain Latin text: no such string of the vocabulary is one that merges don't reach."""
        return self.table.ranks is not None and not any(BEYOND.search(x) is None for x in self.table.unmerged)

    def _merged_piece(self, text: str) -> bytes:
        return self.merger.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4

    def _piece(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or " \n" in text or "\n " in text or (RARE.search(text) and any(pair in text for pair in BESIDE)):
            return b"".join(map(self.plain.__getitem__, CHUNK.findall(text)))
        first, *rest = text.split(" ")
        return (self.plain[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))


def coder(path: str) -> Coder:
    return Coder(proven(path))
