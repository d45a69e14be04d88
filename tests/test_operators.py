"""Operators on small tables: merging, limits, alerts, groups, documents, calendars, comparisons."""

from __future__ import annotations

import json
import random
from datetime import date

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from meterlark import catalog, catalog_limits
from meterlark.functions import limits as L
from meterlark.operators import account_groups, alerts, limit_events, merge, windows
from meterlark.plans import checks, documents, forecasts, views
from meterlark.plans.periods import Range, Zone, calendar_slices, equal_buckets, parse_bound, resolve_period
from meterlark.schema import CAPTURE, USAGE
from meterlark.sources import limits_cache, rates, roots

T0 = 1_705_752_000_000


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# --- merging -------------------------------------------------------------------------------------------------------


def rows_for(rng, n=60):
    return [(rng.randrange(8), rng.randrange(3), rng.randrange(5), rng.choice(["m", "n", "codex-unattributed"]), *(rng.randrange(9) for _ in range(4)), rng.choice([None, rng.randrange(5)]), rng.choice([None, rng.randrange(5)]), rng.randrange(2)) for _ in range(n)]


def test_merge_is_idempotent_and_any_batching_gives_the_counters(spark):
    rng = random.Random(1)
    rows = rows_for(rng)
    df = lambda r: spark.createDataFrame(r, USAGE)
    whole = merge.merged(df(rows))
    twice = merge.upserted(whole, df(rows))
    assert sorted(map(str, whole.collect())) == sorted(map(str, twice.collect()))
    assert merge.changed_keys(whole, df(rows)).count() == 0
    parts = merge.upserted(merge.upserted(merge.merged(df(rows[:20])), df(rows[20:40])), df(rows[40:]))
    counters = ["key", *merge.COUNTERS]
    assert sorted(map(str, parts.select(*counters).collect())) == sorted(map(str, whole.select(*counters).collect()))
    for r in whole.collect():
        own = [x for x in rows if x[0] == r["key"]]
        assert r["outp"] == max(x[5] for x in own)
        assert r["e5"] == max((x[8] for x in own if x[8] is not None), default=None)
        assert (r["acct"], r["ts"]) == min((x[1], x[2]) for x in own)


def test_write_order(spark):
    df = lambda *r: spark.createDataFrame(list(r), USAGE)
    row = lambda k, n, model="m": (k, 0, 1, model, n, n, n, n, None, None, 0)
    keys = lambda *k: spark.createDataFrame([(x, "r", 1) for x in k], "key long, reason string, at long")
    usage, marks = merge.written(df(row(1, 5), row(2, 5)), keys(3, 4), restore=keys(3), drop=keys(1, 6), replace=df(row(2, 1, "codex-unattributed")), upsert=df(row(3, 2), row(4, 2), row(6, 2)))
    assert sorted((r["key"], r["inp"], r["model"]) for r in usage.collect()) == [(2, 1, "m"), (3, 2, "m"), (6, 2, "m")]
    assert sorted(r["key"] for r in marks.collect()) == [1, 4]


def test_accounts_interned(spark):
    stored = spark.createDataFrame([(1, "claude", "a", "old"), (2, "claude", "b", "kept")], "id int, provider string, identity string, label string")
    seen = spark.createDataFrame([("claude", "a", "new", True, 1), ("claude", "b", "derived", False, 2), ("codex", "c", "third", False, 3)], "provider string, identity string, label string, explicit boolean, seq int")
    assert sorted(map(tuple, merge.accounts_interned(stored, seen).select("id", "identity", "label").collect())) == [(1, "a", "new"), (2, "b", "kept"), (3, "c", "third")]


# --- limits --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("kind", "label", "minutes", "told", "length"), [
    ("five_hour", None, None, "5-HOUR", 300), ("codex_primary", None, 10080.0, "WEEKLY", 10080), ("x_y", None, 20160.0, "2-WEEK", 20160), ("x", None, 45.0, "45-MIN", 45), ("some_kind", None, None, "SOME KIND", None),
    ("weekly_scoped", "FABLE WEEKLY", None, "FABLE WEEKLY", 10080), ("odd", "THING 2-DAY", None, "THING 2-DAY", 2880),
])
def test_labels(spark, kind, label, minutes, told, length):
    k, lab, m = F.lit(kind), F.lit(label).cast("string"), F.lit(minutes).cast("double")
    assert one(spark, L.window_label(k, lab, m)) == told
    assert one(spark, L.window_minutes(k, lab, m)) == length


@pytest.mark.parametrize(("provider", "kind", "label", "scope"), [
    ("claude", "weekly_scoped_2", "FABLE WEEKLY", "FABLE"), ("claude", "seven_day_opus", "SEVEN DAY OPUS", "opus"), ("claude", "weekly_all", "WEEKLY", None), ("codex", "codex_primary", "5-HOUR", None),
    ("codex", "sol_primary", "GPT SOL 5-HOUR", "GPT SOL"), ("codex", "codex_x_secondary", "WEEKLY", "x"),
])
def test_scopes(spark, provider, kind, label, scope):
    assert one(spark, L.window_scope(F.lit(provider), F.lit(kind), F.lit(label))) == scope


def test_telling(spark):
    assert [one(spark, L.duration(F.lit(x))) for x in (45_000, 75_000, 120_000, 2_280_000, 7_800_000, 273_600_000)] == ["45s", "1m 15s", "2m", "38m", "2h 10m", "3d 4h"]
    assert [one(spark, L.compact(F.lit(x))) for x in (59_000, 4_320_000, 187_200_000)] == ["59s", "1h12m", "2d4h"]
    assert [one(spark, L.countdown(F.lit(T0 + x), T0)) for x in (30_000, 60_000, 7_200_000, 7_260_000, 100_000_000)] == ["now", "<5m", "<2h", "<3h", "~2d"]
    assert [one(spark, L.roughly(F.lit(T0 + x * 3_600_000), T0, "UTC")) for x in (1, 7, 10.5, 15, 24, 60, 24 * 8)] == ["~this afternoon", "~this evening", "~tonight", "~tonight", "~tomorrow afternoon", "~Mon night", "~next Sun afternoon"]
    assert one(spark, L.clock(F.lit(T0), T0, "America/Toronto")) == "07:00"
    assert one(spark, L.scope_matches(F.lit("Opus 4.8"), F.lit("claude-opus-4-8")))
    assert not one(spark, L.scope_matches(F.lit("Opus 4.9"), F.lit("claude-opus-4-8")))


def test_responses(spark):
    a = {"limits": [{"kind": "session", "percent": 12, "resets_at": "2024-01-20T15:00:00Z"}, {"kind": "weekly_scoped", "percent": 30.5, "resets_at": 1705800000, "scope": {"model": {"display_name": "Fable"}}}, {"kind": "session", "percent": 1, "resets_at": 5}, {"percent": "x", "resets_at": 5}, 7]}
    old = {"five_hour": {"utilization": 50, "resets_at": "2024-01-20T15:00:00Z"}, "junk": 3, "none": {"utilization": None, "resets_at": 1}}
    b = {"rateLimitsByLimitId": {"codex": {"primary": {"usedPercent": 5, "resetsAt": 100, "windowDurationMins": 300}}, "sol": {"limitName": "gpt sol", "secondary": {"usedPercent": 6, "resetsAt": 200, "windowDurationMins": 10080}}}}
    single = {"rateLimits": {"primary": {"usedPercent": 1, "resetsAt": 9}}}
    frame = lambda *x: spark.createDataFrame([(f"i{n}", 1.0, json.dumps(v) if not isinstance(v, str) else v) for n, v in enumerate(x)], "identity string, captured_at double, body string")
    got = {r["identity"]: {k: (v["label"], v["used_percentage"], v["resets_at"]) for k, v in r["rate_limits"].items()} for r in windows.from_responses_a(frame(a, old, "{bad")).collect()}
    assert got == {"i0": {"session": ("5-HOUR", 12.0, 1705762800.0), "weekly_scoped": ("FABLE WEEKLY", 30.5, 1705800000.0), "session_2": ("5-HOUR", 1.0, 5.0)}, "i1": {"five_hour": (None, 50.0, 1705762800.0)}}
    got = {r["identity"]: {k: (v["label"], v["used_percentage"], v["window_minutes"]) for k, v in r["rate_limits"].items()} for r in windows.from_responses_b(frame(b, single)).collect()}
    assert got == {"i0": {"codex_primary": ("5-HOUR", 5.0, 300.0), "sol_secondary": ("GPT SOL WEEKLY", 6.0, 10080.0)}, "i1": {"codex_primary": ("PRIMARY", 1.0, None)}}


def test_cache_file(spark, tmp_path):
    ok = {"captured_at": 5, "source": "claude", "rate_limits": {"session": {"used_percentage": 1, "resets_at": 2}, "bad": {"used_percentage": None, "resets_at": 2}}}
    (tmp_path / "c.json").write_text(json.dumps({"providers": {"a": ok, "b": {"source": "claude"}, "c": ok | {"source": "other"}}}))
    rows = limits_cache.read_cache(spark, str(tmp_path / "c.json"))
    assert [(r["identity"], list(r["rate_limits"])) for r in rows.collect()] == [("a", ["session"])]
    older = rows.withColumn("captured_at", F.lit(4.0))
    assert limits_cache.merged(rows, older).first()["captured_at"] == 5.0
    (tmp_path / "c.json").write_text("{")
    assert limits_cache.read_cache(spark, str(tmp_path / "c.json")).count() == 0


def sequential_events(rows):
    """The event rules capture by capture, as a stream of one account's window would see them."""
    kept, out = [], []
    for at, resets, used, minutes in sorted(rows):
        if at >= resets:
            continue
        seen = lambda event: any(e[0] == event and abs(e[1] - resets) < 900_000 for e in kept)  # noqa: B023, E731
        for event, hit in (("reached", used >= 1), ("passed_80", used >= 0.8 and minutes == 10_080)):
            if hit and not seen(event):
                kept.append([event, resets, at, None])
        if used < 1:
            closing = [e for e in kept if e[0] == "reached" and e[3] is None and e[1] <= at]
            for e in closing:
                e[3] = at
            if closing and not seen("resumed"):
                kept.append(["resumed", resets, at, None])
    out += [tuple(e) for e in kept]
    return sorted(out, key=str)


def test_events_equal_a_sequential_reading(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        at = T0 + i * 1_700_000
        rows.append((at, (at // 18_000_000 + 1) * 18_000_000 + rng.randrange(700), rng.choice([0.2, 0.85, 1.0, 1.2]), 300.0))
    frame = spark.createDataFrame([("a", "claude", at, "w", "L", used, resets, minutes) for at, resets, used, minutes in rows], "identity string, provider string, at long, kind string, label string, utilization double, resets_at long, minutes double")
    got = sorted(((r["event"], r["resets_at"], r["at"], r["resumed_at"]) for r in limit_events.detect(frame).collect()), key=str)
    assert got == sequential_events(rows)


def test_recorded_events_do_not_repeat(spark):
    found = catalog_limits.events(spark, SMALL)
    columns = ["identity", "event", "window", "label", "resets_at", "at", "resumed_at"]
    again = limit_events.recorded(found, found).select(*columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, found.select(*columns).collect()))


def folded(comparisons, state=None):
    """The rules of a pair's state told one comparison at a time."""
    s = dict(state) if state else None
    for at_a, at_b, shared, agree, use, close, u, r in comparisons:
        if not shared or (agree and not close) or (s and (at_a <= s["at_a"] or at_b <= s["at_b"])):
            continue
        s = s or {"agree": 0, "disagree": 0, "inconclusive": 0, "linked": False, "detected_at": None, "agreed_at": None, "window": None}
        s |= {"at_a": at_a, "at_b": at_b}
        if agree and not use and not s["inconclusive"]:
            s["inconclusive"] = 1
            continue
        s["inconclusive"] = 0
        if agree and use:
            goes_on = s["agreed_at"] is not None and at_a - s["agreed_at"] <= 660_000
            s["agree"] = s["agree"] + 1 if goes_on else 1
            if s["agree"] >= 2 and goes_on and abs(s["window"][1] - r) < 900_000 and s["window"][0] != u > 0 and not s["linked"]:
                s |= {"linked": True, "detected_at": max(at_a, at_b)}
            s |= {"disagree": 0, "agreed_at": at_a, "window": (u, r)}
        else:
            s |= {"agree": 0, "disagree": s["disagree"] + 1, "agreed_at": None, "window": None}
            if s["disagree"] >= 2:
                s |= {"linked": False, "detected_at": None}
    return s


def pair_rows(spark, of_pairs):
    rows = [(p, p.split("|")[0], p.split("|")[1], at_a, at_b, shared, agree, use, close, [("w", u, r)]) for p, own in of_pairs.items() for at_a, at_b, shared, agree, use, close, u, r in own]
    return spark.createDataFrame(rows, account_groups.COMPARISON)


SHOWN = ("agree", "disagree", "inconclusive", "linked", "detected_at", "at_a", "at_b", "agreed_at")


def test_pair_states_equal_a_fold(spark):
    import random

    rng, first, later = random.Random(4), {}, {}
    for p in range(300):
        at, rows = 0, []
        for _ in range(rng.randint(1, 14)):
            at += rng.choice([0, 300_000, 300_000, 600_000, 900_000])
            rows.append((at, at + rng.randint(-20_000, 20_000) + 50_000, rng.choice([0, 1, 1, 1, 1, 1]), rng.random() < 0.85, rng.random() < 0.75, rng.random() < 0.9, rng.choice([0.0, 0.5, 0.5, 0.6]), rng.choice([10**12, 10**12, 10**12 + 10**6])))
        cut = rng.randint(0, len(rows))
        rows = sorted(dict((r[0], r) for r in rows).values())
        rows = [r for i, r in enumerate(rows) if all(r[1] > q[1] for q in rows[:i])]
        first[f"a{p}|b"], later[f"a{p}|b"] = rows[:cut], rows[cut:]
    shown = lambda s: None if s is None else tuple(s[c] for c in SHOWN)
    of = lambda df: {r["pair"]: shown(r) for r in df.collect()}
    whole = {p: first[p] + later[p] for p in first}
    want = {p: shown(folded(own)) for p, own in whole.items() if folded(own)}
    assert of(account_groups.pair_states(pair_rows(spark, whole))) == want
    assert sum(w[3] for w in want.values()) > 10
    stored = account_groups.pair_states(pair_rows(spark, first))
    assert of(account_groups.pair_states(pair_rows(spark, later), stored)) == want


def test_links_need_movement_and_break_on_two_disagreements(spark):
    c = lambda at, u, agree=True, use=True: (at, at + 1000, 1, agree, use, True, u, 10**12)
    steps = [c(0, 0.5), c(300_000, 0.5), c(600_000, 0.6), c(900_000, 0.7, agree=False), c(1_200_000, 0.8, agree=False)]
    found = {r["pair"]: r for r in account_groups.pair_states(pair_rows(spark, {f"a|b{n}": steps[:n] for n in range(2, 6)})).collect()}
    assert [found[f"a|b{n}"]["linked"] for n in range(2, 6)] == [False, True, True, False]
    assert found["a|b4"]["disagree"] == 1


def test_groups():
    own = [("claude", x) for x in "abcd"] + [("codex", "e")]
    found = account_groups.resolve_groups(own, [["a", "b", "e"]], [("b", "c")], ["b|c", "c|d"])
    assert {k: (v["members"], v["source"]) for k, v in found.items()} == {"a": (["a", "b"], "manual"), "b": (["a", "b"], "manual"), "c": (["c", "d"], "auto"), "d": (["c", "d"], "auto")}


def test_advice_texts(spark):
    rows = catalog_limits.forecast(spark, SMALL)
    said = {r["identity"]: r for r in forecasts.should_wait(rows, T0, "UTC", cost=5.0).collect()}
    assert len(said) == rows.select("identity").distinct().count()
    assert all(("; it " in r["reason"]) if r["wait"] else r["reason"].startswith("headroom ok") for r in said.values())
    kinds = {r["verdict"] for r in forecasts.verdicts(rows, T0).collect()}
    assert kinds <= {"full", "hits", "week", "idle", "safe", "unknown"}


def test_alert_lifecycle(spark):
    now = catalog_limits.current(spark, SMALL).withColumn("window_s", F.col("minutes") * 60)
    rules = catalog_limits.alert_rows(spark).withColumn("session", F.lit("s1")).withColumn("created_at", F.lit(T0).cast("long"))
    none = spark.createDataFrame([], "alert_id int, kind string, resets_at long, at long, on_set boolean")
    fired = alerts.firing(rules, now, none, T0)
    assert fired.count() and all(r["message"].startswith("[alert] ") and "Call should_wait" in r["message"] for r in fired.collect())
    done = fired.withColumn("on_set", F.lit(False)).drop("message")
    assert alerts.firing(rules, now, done, T0).count() == 0
    assert {r["status"] for r in alerts.statuses(rules, now, done, T0).collect()} <= {"armed", "fired"}
    active = alerts.session_activity(spark.createDataFrame([("s1", T0)], "session string, at long"))
    assert alerts.pruned(rules, done, active, T0 + 1000)[0].count() == rules.count()
    assert alerts.pruned(rules, done, active, T0 + 86_400_001)[0].count() == 0


# --- calendars, rates, documents -------------------------------------------------------------------------------------


def test_calendars():
    assert Zone("America/Sao_Paulo").start_of(date(2018, 11, 4)) == 1541300400000
    assert Zone("America/Havana").start_of(date(2025, 11, 2)) == 1762056000000
    assert Zone("America/Toronto").start_of(date(1919, 3, 31)) == -1601753400000
    zone = Zone("america/toronto")
    span = Range(888_710_400_000, 899_251_200_000)
    for unit in ("day", "week", "month"):
        slots = [s for _, s in calendar_slices(span, unit, zone)]
        assert slots[0].start == span.start and slots[-1].end == span.end and all(a.end == b.start for a, b in zip(slots, slots[1:], strict=False))
    assert {s.end - s.start for _, s in calendar_slices(span, "day", zone)[1:-1]} == {86_400_000, 82_800_000}
    assert equal_buckets(Range(0, 10), 4) == [Range(0, 3), Range(3, 5), Range(5, 8), Range(8, 10)]
    assert resolve_period("5h", 100_000_000, zone) == Range(82_000_000, 100_000_001)
    assert parse_bound("2024-01-20", Zone("UTC"), until=True) == 1_705_795_200_000


def test_rate_table():
    card = {"input": 1, "output": 2}
    text = json.dumps({"version": 2, "models": {"m-1": card, "m-2": {"periods": [{"from": None, "card": card}, {"from": "2024-01-01T00:00:00Z", "card": card | {"fast": {"input": 6, "output": 9}}}]}}, "aliases": {"z": {"estimated": True, "periods": [{"from": None, "model": "m-1"}]}}})
    table = rates.read_rates(text)
    assert [r[:5] for r in table.rows()][:2] == [("m-1", 0, 0, rates.FOREVER, "priced"), ("m-1", 1, 0, rates.FOREVER, "unpriced-tier")]
    assert [r[-1] for r in table.rows() if r[0] == "z"] == [True, True]
    for bad in ('{"version": 1}', text.replace('"input": 1', '"input": -1'), text.replace('"output": 2', '"what": 2')):
        with pytest.raises(rates.BadCard):
            rates.read_rates(bad)
    over = table.overridden(json.dumps({"models": {"M-1": {"input": "3", "output": 4}, "bad": {"input": 1}}}))
    assert over.models["m-1"][0][1]["input"] == 3.0 and len(over.warnings) == 1


def test_documents(spark):
    q = catalog.q(spark, SMALL)
    for args in (["usage", "--group-by", g] for g in ("model", "account", "month")):
        args += ["--since", "1998-03-01", "--until", "1998-06-30"]
        d = documents.document(q, documents.parse(args), T0)
        assert d["schema"] == 1 and d["groups"] and json.dumps(d)
        assert sum(g["tokens"]["total"] for g in d["groups"]) == d["totals"]["tokens"]["total"]
    d = documents.document(q, documents.parse(["accounts", "--tz", "Europe/Paris"]), T0)
    assert len(d["accounts"]) == 9 and d["period"]["tz"] == "Europe/Paris"
    assert documents.document(q, documents.parse(["models", "--provider", "codex"]), T0)["models"]
    for bad in ([], ["what"], ["usage", "--period", "ever"], ["models", "--group-by", "day"], ["accounts", "--account", "x"], ["usage", "--period", "custom"], ["usage", "--tz", "Mars/Base"], ["usage", "--since", "1998-03-01", "--period", "all"], ["usage", "--bad"]):
        with pytest.raises(documents.BadArgument):
            documents.parse(bad)


def test_views(spark):
    q = catalog.q(spark, SMALL)
    span = catalog.SPAN
    cells = views.history(q, span, "week").collect()
    total = next(r["tokens"] for r in cells if r["grouping"] == 7)
    assert sum(r["tokens"] for r in cells if r["grouping"] == 3) == total == sum(r["tokens"] for r in cells if r["grouping"] == 6)
    assert views.spend_columns(q, catalog.NOW).count() == 1
    assert views.activity_series(q, catalog.NOW, "7d").count() == 168
    assert views.by_name(views.rate_board(q, span, catalog.NOW)).count() == q.by_model(span).count()
    assert views.account_rows(q, span, catalog.NOW).count() == 9
    assert views.column_edges(3, 10) == [0, 3, 6, 10]


def test_comparison_of_stores(spark):
    q = catalog.q(spark, SMALL)
    a = checks.cells(q.within(None), q.zone)
    assert checks.differing(a, a).count() == 0
    other = checks.cells(q.within(None).where("key % 7 != 0"), q.zone)
    found = checks.differing(a, other)
    assert {r["category"] for r in checks.categories(found).collect()} <= {"only_before", "fewer_rows"}
    gone = q.usage.where("key % 7 = 0").count()
    assert -found.agg(F.sum("rows")).first()[0] == gone
    from meterlark.operators import rollup

    assert {r["drifted"] for r in checks.health(q.usage, q.accounts, rollup.built(q.usage)).collect()} == {0}


def test_roots(tmp_path):
    for name in (".claude", ".claude-work", ".codex"):
        (tmp_path / name).mkdir()
    config = {"claude_roots": [{"path": "~/.claude-work", "label": "job"}], "disabled_roots": ["~/.codex"]}
    found = roots.discover_all(config, str(tmp_path), {"CODEX_HOME": str(tmp_path / ".codex")})
    assert [(r.provider, r.label, r.source, r.enabled) for r in found] == [("claude", "default", "auto", True), ("claude", "job", "config", True), ("codex", "codex", "auto", False)]
    assert roots.free_label("a", {"a", "a-2"}) == "a-3" and roots.derived_label(".x", ".claude-") == "x"


def test_captures_schema(spark):
    assert windows.windows(spark.createDataFrame([], CAPTURE)).count() == 0
