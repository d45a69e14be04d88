"""Rate cards: strict reading of a JSON table, overrides, aliases, and the interval dimension that rows are joined with."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from meterlark.functions.models import ALIASES, PREFIXES
from meterlark.sources.local import local_table

FOREVER = 2**53
RATES = ("input", "output", "cache_read", "cache_write")
LONG = ("long_context_threshold", "long_context_input_multiplier", "long_context_output_multiplier", "long_context_counts_cache_writes")
DIMENSION = (
    "model_key string, tier int, from_ms long, to_ms long, status string, input double, output double, cache_read double, cache_write double, "
    "lc_threshold long, lc_in_mult double, lc_out_mult double, lc_counts_cw boolean, lc_unpriced boolean, estimated boolean"
)


class BadCard(ValueError):
    """A rate table that doesn't follow its format."""


def normalized(model: str) -> str:
    """The driver's twin of functions.models.normalize_model, for the few ids of a rate table."""
    import re

    m = re.sub(r"\[\s*1m\s*\]", "", model.strip().lower()).strip()
    for prefix in PREFIXES:
        m = m.removeprefix(prefix)
    return re.sub(r"-\d{6,8}$", "", re.sub(r"-\d{4}-\d{2}-\d{2}$", "", m)).strip()


def instant(text: str | None) -> int:
    """Epoch ms of a UTC instant; null is the beginning of time."""
    if text is None:
        return 0
    try:
        at = datetime.fromisoformat(text)
    except (TypeError, ValueError) as e:
        raise BadCard(f"not an instant: {text!r}") from e
    if at.tzinfo is None or at.utcoffset().total_seconds():
        raise BadCard(f"not UTC: {text!r}")
    return round(at.timestamp() * 1000)


def _number(x: Any, where: str, lenient: bool) -> float:
    if lenient and isinstance(x, str):
        try:
            x = float(x)
        except ValueError as e:
            raise BadCard(f"{where}: not a number: {x!r}") from e
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x < 0:
        raise BadCard(f"{where}: not a rate: {x!r}")
    return float(x)


def card_of(raw: Any, where: str, *, lenient: bool = False, fast: bool = True) -> dict[str, Any]:
    """A checked card: known fields only, input and output stated, numbers finite and not negative."""
    if not isinstance(raw, dict):
        raise BadCard(f"{where}: not an object")
    known = set(RATES + LONG) | ({"fast"} if fast else set())
    if extra := set(raw) - known:
        raise BadCard(f"{where}: unknown fields {sorted(extra)}")
    if missing := {"input", "output"} - set(raw):
        raise BadCard(f"{where}: no {sorted(missing)}")
    out: dict[str, Any] = {k: _number(raw[k], f"{where}.{k}", lenient) for k in RATES + LONG[:3] if k in raw}
    if LONG[3] in raw:
        if not isinstance(raw[LONG[3]], bool):
            raise BadCard(f"{where}.{LONG[3]}: not true or false")
        out[LONG[3]] = raw[LONG[3]]
    if not fast and LONG[0] in raw:
        raise BadCard(f"{where}: a fast card takes its threshold from the card it belongs to")
    if "fast" in raw and fast:
        out["fast"] = card_of(raw["fast"], f"{where}.fast", lenient=lenient, fast=False)
    return out


def periods_of(raw: Any, where: str, *, lenient: bool = False) -> list[tuple[int, dict[str, Any]]]:
    """(start, card) of an entry, ascending: a card alone holds for all time."""
    if isinstance(raw, dict) and "periods" in raw:
        if set(raw) != {"periods"} or not isinstance(raw["periods"], list) or not raw["periods"]:
            raise BadCard(f"{where}: periods must be a list that isn't empty")
        out = []
        for i, p in enumerate(raw["periods"]):
            if not isinstance(p, dict) or "from" not in p:
                raise BadCard(f"{where}[{i}]: no from")
            rest = p["card"] if set(p) == {"from", "card"} else {k: v for k, v in p.items() if k != "from"}
            out.append((instant(p["from"]), card_of(rest, f"{where}[{i}]", lenient=lenient)))
        if any(a >= b for (a, _), (b, _) in zip(out, out[1:], strict=False)):
            raise BadCard(f"{where}: periods must ascend")
        return out
    return [(0, card_of(raw, where, lenient=lenient))]


@dataclass
class RateTable:
    """Checked entries: model key to its periods, and estimated aliases to theirs."""

    models: dict[str, list[tuple[int, dict[str, Any]]]]
    aliases: dict[str, list[tuple[int, str]]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def overridden(self, text: str) -> RateTable:
        """With a user's entries in place of whole entries; bad ones are skipped with a warning, a byte order mark is let pass."""
        try:
            raw = json.loads(text.removeprefix("﻿"))
            entries = raw["models"]
            assert isinstance(entries, dict)
        except (ValueError, KeyError, TypeError, AssertionError):
            return RateTable(self.models, self.aliases, [*self.warnings, "overrides: not an object with models"])
        models, warnings, exact = dict(self.models), list(self.warnings), {normalized(k) for k in entries if normalized(k) == k}
        for name, entry in entries.items():
            key = normalized(name)
            if key != name and key in exact:  # the normalised spelling wins
                continue
            try:
                models[key] = periods_of(entry, name, lenient=True)
            except BadCard as e:
                warnings.append(str(e))
        return RateTable(models, self.aliases, warnings)

    def differing(self, other: RateTable) -> dict[str, list[tuple[int, dict[str, Any]]]]:
        """Entries of other that this table lacks or has otherwise."""
        return {k: v for k, v in other.models.items() if self.models.get(k) != v}

    def entry(self, key: str) -> list[tuple[int, dict[str, Any], bool]]:
        """(start, card, estimated): own entry first, then an official alias, then the estimated alias' targets in turn."""
        if key in self.models:
            return [(t, c, False) for t, c in self.models[key]]
        if ALIASES.get(key) in self.models:
            return [(t, c, False) for t, c in self.models[ALIASES[key]]]
        out: list[tuple[int, dict[str, Any], bool]] = []
        spans = self.aliases.get(key, [])
        for (start, target), end in zip(spans, [*(s for s, _ in spans[1:]), FOREVER], strict=True):
            own = self.entry(target) if target != key else []
            for (t, card, _), until in zip(own, [*(x[0] for x in own[1:]), FOREVER], strict=True):
                if t < end and until > start:
                    out.append((max(t, start), card, True))
        return out

    def rows(self) -> list[tuple]:
        """The dimension: one interval per model, tier and period."""
        out = []
        for key in sorted({*self.models, *self.aliases, *(a for a, b in ALIASES.items() if b in self.models)}):
            own = self.entry(key)
            for (start, card, estimated), end in zip(own, [*(x[0] for x in own[1:]), FOREVER], strict=True):
                for tier, c in ((0, card), (1, fast_card(card))):
                    if c is None:
                        out.append((key, tier, start, end, "unpriced-tier", *[None] * 7, False, False, estimated))
                    else:
                        threshold = c.get("long_context_threshold")
                        out.append((key, tier, start, end, "priced", c["input"], c["output"], c.get("cache_read"), c.get("cache_write"), None if threshold is None else int(threshold), c.get("long_context_input_multiplier"), c.get("long_context_output_multiplier"), bool(c.get("long_context_counts_cache_writes")), bool(c.get("lc_unpriced")), estimated))
        return out

    def dimension(self, spark: SparkSession) -> DataFrame:
        return local_table(spark, self.rows(), DIMENSION)

    def boundaries(self) -> list[int]:
        """Every instant at which some price changes, ascending."""
        return sorted({t for k in (*self.models, *self.aliases) for t, _, _ in self.entry(k) if t})

    def long_context(self, key: str) -> tuple[int | None, bool]:
        """(lowest threshold over the entry's periods, whether any of those counts cache writes)."""
        cards = [c for _, c, _ in self.entry(key) if "long_context_threshold" in c]
        return (min((int(c["long_context_threshold"]) for c in cards), default=None), any(c.get(LONG[3], False) for c in cards))

    def least_threshold(self) -> int | None:
        return min((t for k in (*self.models, *self.aliases) if (t := self.long_context(k)[0]) is not None), default=None)


def fast_card(card: dict[str, Any]) -> dict[str, Any] | None:
    """The fast tier's own card: unstated cache reads keep their ratio to input, the threshold is the card's,
    and long context without multipliers of its own has no price."""
    fast = card.get("fast")
    if fast is None:
        return None
    out = dict(fast)
    if "cache_read" not in out and "cache_read" in card and card["input"]:
        out["cache_read"] = out["input"] * (card["cache_read"] / card["input"])
    if "long_context_threshold" in card:
        out["long_context_threshold"] = card["long_context_threshold"]
        out[LONG[3]] = card.get(LONG[3], False)
        out["lc_unpriced"] = LONG[1] not in fast or LONG[2] not in fast
    return out


def read_rates(text: str) -> RateTable:
    """A strict rate table of version 2: sources, models, aliases."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise BadCard(f"not JSON: {e}") from e
    if not isinstance(raw, dict) or raw.get("version") != 2 or not isinstance(raw.get("models"), dict):
        raise BadCard("not a rate table of version 2")
    models = {}
    for name, entry in raw["models"].items():
        if normalized(name) != name:
            raise BadCard(f"{name}: not a normalised id")
        models[name] = periods_of(entry, name)
    aliases = {}
    for name, entry in raw.get("aliases", {}).items():
        if entry.get("estimated") is not True or not entry.get("periods"):
            raise BadCard(f"{name}: an alias is estimated and has periods")
        aliases[name] = [(instant(p["from"]), p["model"]) for p in entry["periods"]]
        if bad := [m for _, m in aliases[name] if m not in models]:
            raise BadCard(f"{name}: no such model {bad}")
    return RateTable(models, aliases)


def now_ms() -> int:
    return round(datetime.now(UTC).timestamp() * 1000)
