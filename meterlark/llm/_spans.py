"""Found spans as text, the same for every scanner."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

Span = tuple[str, int, int]


def listed(spans: Iterable[Span], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind as ordered, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def runs(spans: Iterable[Span]) -> list[tuple[int, int]]:
    """What spans cover, as (start, end) in order; spans that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def uncovered(spans: list[Span], known: list[Span]) -> Iterator[tuple[Span, list[Span]]]:
    """Each of some spans, by start, and the parts of it that no known span covers; one pass over both."""
    taken, i = runs(known), 0
    for kind, at, end in sorted(spans, key=lambda s: s[1:]):
        while i < len(taken) and taken[i][1] <= at:
            i += 1
        parts, start, j = [], at, i
        while j < len(taken) and taken[j][0] < end:
            if taken[j][0] > start:
                parts.append((kind, start, taken[j][0]))
            start, j = taken[j][1], j + 1
        yield (kind, at, end), parts + ([(kind, start, end)] if start < end else [])


def free_of(spans: list[Span], known: list[Span]) -> list[Span]:
    """The spans that overlap no known one."""
    return [s for s, parts in uncovered(spans, known) if parts == [s]]
