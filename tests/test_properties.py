"""Properties over random data: the rollup under writes, prices row by row, coverage, and slots that add up."""

from __future__ import annotations

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from meterlark import catalog
from meterlark.operators import merge, pricing, rollup
from meterlark.plans.periods import Range
from meterlark.schema import USAGE
from meterlark.sources import rates

HOUR = 3_600_000


def some_rows(rng, n=80):
    models = ["model-11", "MODEL-13-20250101", "anthropic/model-21[1m]", "nowhere", "codex-unattributed", "model-51", "model-41", "model-23"]
    return [
        (rng.randrange(25), rng.randrange(3), rng.randrange(6) * HOUR + rng.randrange(HOUR), rng.choice(models), rng.choice([rng.randrange(2000), rng.randrange(2_000_000)]), rng.randrange(900), rng.randrange(900_000), rng.randrange(500), rng.choice([None, rng.randrange(99)]), rng.choice([None, rng.randrange(99)]), rng.randrange(2))
        for _ in range(n)
    ]


def as_set(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_rollup_kept_up_equals_a_rebuild(spark, seed):
    rng = random.Random(seed)
    frame = lambda rows: spark.createDataFrame(rows, USAGE)
    store = merge.merged(frame(some_rows(rng)))
    kept = rollup.built(store)
    steps = [lambda s, r: merge.upserted(s, frame(r)), lambda s, r: merge.replaced(s, frame(r)), lambda s, r: merge.without(s, frame(r[:5]))]
    for step in rng.sample(steps, len(steps)):
        rows = some_rows(rng, 20)
        after = spark.createDataFrame(step(store, rows).select(*merge.COLUMNS).collect(), USAGE)
        touched = frame(rows).select("key").distinct()
        kept = rollup.maintained(kept, store.join(touched, "key", "left_semi"), after.join(touched, "key", "left_semi"))
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        store = after
        columns = (*rollup.KEYS, *rollup.SUMS)
        assert as_set(kept, *columns) == as_set(rollup.built(store), *columns)
        assert rollup.drift(kept, store).count() == 0 and rollup.counts_agree(kept, store).first()["agree"]


def price_of(row, table):
    """A row's dollars in plain Python, or the reason it has none."""
    key, _, ts, model, inp, outp, cr, cc, e5, e1, tier = row
    own = [r for r in table.rows() if r[0] == rates.normalized(model) and r[1] == tier and r[2] <= ts < r[3]]
    if not own:
        return "unpriced"
    _, _, _, _, status, i, o, read, write, limit, im, om, counts, unpriced, _ = own[0]
    if status != "priced":
        return status
    long = limit is not None and inp + cr + (cc if counts else 0) > limit
    if long and unpriced:
        return "unpriced-tier"
    a, b = ((im or 1), (om or 1)) if long else (1, 1)
    out = inp * (i * a / 1e6) + outp * (o * b / 1e6) + cr * (read * a if read is not None else i * a * 0.1) / 1e6
    if write is not None:
        return out + cc * write * a / 1e6
    if e5 is None and e1 is None:
        return out + cc * (i * a / 1e6) * 1.25
    return out + (e5 or 0) * (i * a / 1e6) * 1.25 + (e1 or 0) * (i * a / 1e6) * 2


def test_prices_row_by_row(spark):
    from meterlark.sources import tables as T

    rows = some_rows(random.Random(9), 300)
    rows = [(i, *r[1:2], r[2] + 890_000_000_000, *r[3:]) for i, r in enumerate(rows)]
    table = T.rate_table()
    got = {r["key"]: r for r in pricing.priced(spark.createDataFrame(rows, USAGE), table.dimension(spark)).collect()}
    kinds = set()
    for r in rows:
        want = price_of(r, table)
        kinds.add(want if isinstance(want, str) else "priced")
        assert got[r[0]]["price_status"] == (want if isinstance(want, str) else "priced")
        if not isinstance(want, str):
            assert abs(float(got[r[0]]["nanos"]) / 1e9 - want) < 1e-8
    assert kinds == {"priced", "unpriced", "unpriced-tier"}


def test_empty_store(spark):
    from meterlark.plans.periods import Zone
    from meterlark.plans.usage import UsageQueries
    from meterlark.sources import tables as T

    q = UsageQueries(spark.createDataFrame([], USAGE), T.accounts(spark), T.rates(spark), Zone("UTC"))
    zero = q.totals().first()
    assert (zero["tokens"], zero["records"], zero["cost"], zero["priced_share"], zero["status"]) == (0, 0, 0.0, 1.0, "priced")
    assert q.by_account().count() == T.N_ACCOUNTS and q.by_model().count() == 0
    assert q.by_calendar(Range(0, 3 * 24 * HOUR), "day").count() == 3 and q.extent() is None


def test_coverage_and_slots_add_up(spark):
    q = catalog.q(spark, SMALL)
    for df in (q.by_model(catalog.ODD), q.by_calendar(catalog.ODD, "day"), q.by_account(catalog.ODD)):
        assert df.where(F.col("priced_tokens") + F.col("unpriced_tokens") + F.col("unpriced_tier_tokens") != F.col("tokens")).count() == 0
    total = q.totals(catalog.ODD).first()
    for df in (q.by_calendar(catalog.ODD, "day"), q.by_calendar(catalog.ODD, "week"), q.activity(catalog.ODD, 72), q.by_model(catalog.ODD)):
        tokens, cost = df.agg(F.sum("tokens"), F.sum("cost")).first()
        assert tokens == total["tokens"] and abs(cost - total["cost"]) < 0.005
