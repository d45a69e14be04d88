"""The usage documents and the arguments that ask for them."""

from __future__ import annotations

import argparse
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.plans.periods import CALENDAR, ROLLING, Range, Zone, parse_bound, resolve_period
from meterlark.plans.usage import UsageQueries

SCHEMA = 1
QUERIES = ("usage", "models", "accounts")
GROUPS = ("model", "account", "day", "week", "month")
PROVIDERS = ("claude", "codex")
PERIODS = (*CALENDAR, "all", *ROLLING, "custom")
DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


class BadArgument(ValueError):
    """Arguments that ask for nothing that can be answered."""


@dataclass(frozen=True)
class Request:
    query: str
    period: str
    since: str | None
    until: str | None
    group_by: str | None
    accounts: tuple[str, ...]
    providers: tuple[str, ...]
    tz: str | None


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise BadArgument(message)


def parse(args: Sequence[str]) -> Request:
    """Arguments as a request; what contradicts itself is refused before anything is read."""
    p = _Parser(add_help=False, allow_abbrev=False)
    p.add_argument("query", nargs="?")
    for name in ("--period", "--since", "--until", "--group-by", "--tz"):
        p.add_argument(name)
    p.add_argument("--account", action="append", default=[])
    p.add_argument("--provider", action="append", default=[])
    a = p.parse_args(list(args))
    custom = a.since is not None or a.until is not None
    period = a.period or ("custom" if custom else "all")
    refusals = (
        (a.query is None, f"name a query: {', '.join(QUERIES)}"), (a.query not in QUERIES, f"unknown query {a.query!r} ({', '.join(QUERIES)})"),
        (period not in PERIODS, f"unknown period {period!r} ({', '.join(PERIODS)})"), (period == "custom" and a.since is None, "a custom period needs --since"),
        (period != "custom" and custom, "--since and --until need --period custom (or no --period)"), (a.group_by is not None and a.query != "usage", "--group-by applies to the usage query only"),
        (a.group_by is not None and a.group_by not in GROUPS, f"unknown group {a.group_by!r} ({', '.join(GROUPS)})"),
        (a.query == "accounts" and bool(a.account or a.provider), "the accounts query lists every account; drop --account and --provider"),
        (any(x not in PROVIDERS for x in a.provider), f"unknown provider ({', '.join(PROVIDERS)})"),
    )
    for refused, why in refusals:
        if refused:
            raise BadArgument(why)
    if a.tz is not None:
        _zone(a.tz)
    return Request(a.query, period, a.since, a.until, a.group_by, tuple(a.account), tuple(a.provider), a.tz)


def _zone(name: str) -> Zone:
    try:
        return Zone(name)
    except ValueError as e:
        raise BadArgument(str(e)) from e


def _bound(text: str, zone: Zone, until: bool) -> int:
    try:
        if "T" not in text and not DATE.fullmatch(text):
            raise ValueError(f"{text!r}: neither a date nor an instant")
        return parse_bound(text, zone, until=until)
    except ValueError as e:
        raise BadArgument(str(e)) from e


def span_of(q: UsageQueries, request: Request, now: int) -> Range:
    if request.period != "custom":
        return resolve_period(request.period, now, q.zone, extent=q.extent() if request.period == "all" else None)
    start = _bound(request.since, q.zone, False)
    end = _bound(request.until, q.zone, True) if request.until else now + 1
    if end < start:
        raise BadArgument("the period ends before it starts")
    return Range(start, end)


def _filtered(q: UsageQueries, request: Request) -> UsageQueries:
    if request.accounts:
        try:
            q = replace(q, account_ids=tuple(i for name in request.accounts for i in q.named(name).account_ids))
        except ValueError as e:
            raise BadArgument(str(e)) from e
    return replace(q, provider=request.providers[0]) if len(set(request.providers)) == 1 else q


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """An answer's few rows: groups of a document are bounded by the calendar (500) or by models and accounts."""
    return [json.loads(r["j"]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]


def _usage(r: dict[str, Any]) -> dict[str, Any]:
    return {
        "tokens": {k: r[k] for k in ("input", "output", "cache_read", "cache_write")} | {"total": r["tokens"]}, "records": r["records"], "cost": r["cost"],
        "priced_pct": int(r["priced_share"] * 10_000 + 0.5) / 100, "unpriced_tokens": r["unpriced_tokens"], "unpriced_tier_tokens": r["unpriced_tier_tokens"], "estimated": {"cost": r["est_cost"], "tokens": r["est_tokens"]}, "status": r["status"],
    }


def document(q: UsageQueries, request: Request, now: int, warnings: Sequence[str] = ()) -> dict[str, Any]:
    """The document a request asks for."""
    q = _filtered(replace(q, zone=_zone(request.tz)) if request.tz else q, request)
    span = span_of(q, request, now)
    empty = request.period == "all" and span.end <= span.start
    shown = {"name": request.period, "from": None if empty else q.zone.iso(span.start), "to": None if empty else q.zone.iso(span.end), "tz": q.zone.name}
    out: dict[str, Any] = {"schema": SCHEMA, "generated_at": datetime.fromtimestamp(now / 1000, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"), "warnings": list(warnings), "query": request.query, "period": shown}
    accounts = {r["id"]: r for r in _rows(q.selected().select("id", "provider", "label"))}
    if request.query == "accounts":
        seen = {r["id"]: r for r in _rows(q.accounts_seen())}
        iso = lambda t: None if t is None else q.zone.iso(t)
        out["accounts"] = [{"account": accounts[r["id"]]} | _usage(r) | {"share": r["share"], "first_seen": iso(seen[r["id"]].get("first_seen")), "last_seen": iso(seen[r["id"]].get("last_seen"))} for r in _rows(q.by_account(span))]
        return out
    out["filter"] = {"accounts": list(accounts.values()) if request.accounts else None, "providers": list(request.providers) or None}
    totals = _usage(_rows(q.totals(span))[0])
    out["totals"] = totals | {"unpriced": _rows(q.unpriced(span))}
    model = lambda r: {"model": r["model_key"], "tier": "fast" if r["tier"] else "standard"} | _usage(r) | {"share": r["share"], "rates": None if r.get("rate_input") is None else {k: r[f"rate_{k}"] for k in ("input", "output", "cache_read", "cache_write")}}
    if request.query == "models":
        out["models"] = [model(r) for r in _rows(q.by_model(span, now=now))]
        return out
    out["group_by"] = request.group_by
    if request.group_by == "model":
        out["groups"] = [model(r) for r in _rows(q.by_model(span, now=now))]
    elif request.group_by == "account":
        out["groups"] = [{"account": accounts[r["id"]]} | _usage(r) | {"share": r["share"]} for r in _rows(q.by_account(span))]
    elif request.group_by:
        key = (lambda d: d[:7]) if request.group_by == "month" else (lambda d: d)
        out["groups"] = [{"key": key(r["day"]), "from": q.zone.iso(r["lo"]), "to": q.zone.iso(r["hi"])} | _usage(r) | {"top_model": r.get("top_model")} for r in _rows(q.by_calendar(span, request.group_by))]
    else:
        out["groups"] = []
    return out


def write(documents: DataFrame, path: str) -> None:
    """Documents as rows (to_json of any answer), one JSON object per line."""
    documents.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
