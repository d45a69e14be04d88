"""What is kept from batch to batch: causes add up to a cell's difference, re-keying accounts for every row, events close across batches."""

from __future__ import annotations

import random

import pytest
from test_store import table

from meterlark.operators import limit_events, merge
from meterlark.plans import checks
from meterlark.plans.periods import Zone
from meterlark.schema import EVENT_LOG, USAGE

PRICED = "key long, acct int, ts long, model_key string, tier int, inp long, outp long, cr long, cc long, nanos long"
WINDOWS = "identity string, provider string, at long, kind string, label string, utilization double, resets_at long, minutes double, scope string, rank int"


def test_causes_add_up_to_each_cells_difference(spark):
    rng = random.Random(6)
    one = lambda k: [k, k % 2, k % 3 * 86_400_000, f"m-{k % 2}", 0, *(rng.randrange(9) for _ in range(4)), None if k % 9 == 0 else rng.randrange(1, 99)]
    before = [one(k) for k in range(60)]
    after = [list(r) for r in before if r[0] % 5 != 0] + [one(k) for k in range(100, 106)]
    for r in after:
        if r[0] % 7 == 1:
            r[5] += 3
        if r[0] % 7 == 2:
            r[1] += 1
        if r[0] % 7 == 3:
            r[9] = 7
    keys = lambda some: spark.createDataFrame([(k,) for k in some], "key long")
    a, b = spark.createDataFrame([tuple(r) for r in before], PRICED), spark.createDataFrame([tuple(r) for r in after], PRICED)
    found = checks.causes(a, b, Zone("UTC"), files_gone=keys([0, 10, 20]), replayed=keys([0, 5])).collect()
    assert {r["cause"] for r in found} == set(checks.CAUSES)

    def cells(rows, sign, out):
        for r in rows:
            cell = (r[2], r[1], r[3], r[4])
            t, n, c = out.get(cell, (0, 0, 0))
            out[cell] = (t + sign * sum(r[5:9]), n + sign * (r[9] or 0), c + sign)
        return out

    wanted, got = cells(after, 1, cells(before, -1, {})), {}
    for r in found:
        cell = (int(r["day"].strftime("%s")) // 86_400 * 86_400_000, r["acct"], r["model_key"], r["tier"])
        got[cell] = tuple(x + y for x, y in zip(got.get(cell, (0, 0, 0)), (r["tokens"], int(r["nanos"]), r["rows"]), strict=True))
    zero = (0, 0, 0)
    assert {k: v for k, v in got.items() if v != zero} == {k: v for k, v in wanted.items() if v != zero}
    assert checks.causes(a, a, Zone("UTC"), files_gone=keys([]), replayed=keys([])).isEmpty()


def test_rekeying_accounts_for_every_row(spark):
    row = lambda k, n: (k, 1, 5, "m", n, 0, 0, 0, None, None, 0)
    stored = spark.createDataFrame([row(k, 10 * k) for k in range(1, 9)], USAGE)
    now = spark.createDataFrame([row(1, 10), row(12, 20), row(34, 40), row(51, 20), row(52, 30), row(7, 1), row(99, 9)], USAGE)
    links = spark.createDataFrame([(1, 1), (2, 12), (3, 34), (4, 34), (5, 51), (5, 52), (6, 66), (None, 99), (77, 99)], "old_key long, new_key long")
    rows, report = merge.rekeyed(stored, now, links)
    assert sorted(r["key"] for r in rows.collect()) == [1, 6, 7, 8, 12, 34, 51, 52, 99]
    told = {r["category"]: tuple(r)[1:] for r in report.collect()}
    assert told == {"kept": (1, 1, 10, 10), "moved": (1, 1, 20, 20), "merged": (2, 1, 70, 40), "split": (1, 2, 50, 50), "unread": (2, 0, 140, 0), "taken": (1, 0, 70, 0), "fresh": (0, 2, 0, 10)}
    none, empty = merge.rekeyed(stored.limit(0), now.limit(0), links.limit(0))
    assert none.isEmpty() and empty.isEmpty()


@pytest.mark.parametrize("seed", (1, 2, 3))
def test_events_by_batches_equal_the_history(spark, seed):
    rng, hour, rows = random.Random(seed), 3_600_000, []
    for who in ("a", "b"):
        for i in range(120):
            at = i * hour // 2 + 7
            rows.append((who, "claude", at, "five_hour", "5-HOUR", rng.choice([0.2, 0.7, 1.0, 1.1]), (at // (5 * hour) + 1) * 5 * hour, 300.0, None, 0))
            rows.append((who, "claude", at, "weekly_all", "WEEKLY", rng.choice([0.1, 0.5, 0.85, 1.0]), (at // (20 * hour) + 1) * 20 * hour, 10_080.0, None, 1))
    whole = spark.createDataFrame(rows, WINDOWS).coalesce(1)
    stored = spark.createDataFrame([], EVENT_LOG)
    cuts = sorted(rng.sample(range(60 * hour), 2))
    for lo, hi in zip([0, *cuts], [*cuts, 61 * hour], strict=True):
        part = limit_events.advanced(stored, whole.where(f"at >= {lo} and at < {hi}"))
        stored = spark.createDataFrame([tuple(r) for r in part.collect()], EVENT_LOG)
    names = [f.split(" ")[0] for f in EVENT_LOG.split(", ")]
    wanted = table(limit_events.detect(whole).select(*names))
    assert table(stored.select(*names)) == wanted and len(wanted) > 20
    again = limit_events.advanced(stored, whole.where(f"at >= {cuts[1]}"))
    assert table(again.select(*names)) == wanted
