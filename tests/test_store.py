"""The stored usage table: any batches, run once or twice, split and compacted, are the rows merged at once; a batch reads its buckets alone."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from meterlark.operators import merge, rollup
from meterlark.operators.store import UsageStore, into
from meterlark.schema import DAY_MS, HOUR_MS, ROLLUP, USAGE


def rows_of(rng, keys, n):
    """Usage rows of a time that belongs to their key, as a line that is told again keeps its time."""
    out = []
    for _ in range(n):
        key = rng.choice(keys)
        e5, e1 = (None, None) if rng.random() < 0.3 else (rng.randrange(9), rng.randrange(9))
        out.append((key, key % 3, key % 5 * DAY_MS + key % 24 * HOUR_MS, rng.choice(["m-1", "codex-unattributed"]), *(rng.randrange(100) for _ in range(4)), e5, e1, rng.randrange(2)))
    return out


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def filters(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(line for line in plan.splitlines() if "PartitionFilters" in line)


@pytest.mark.parametrize("seed", (1, 2))
def test_any_batches_equal_one_merge(spark, tmp_path, seed):
    rng = random.Random(seed)
    store, stored = UsageStore(spark, f"file://{tmp_path}/s", buckets=2, days=2), None
    for number in range(4):
        batch = spark.createDataFrame(rows_of(rng, range(40), 25) if number != 2 else [], USAGE)
        stored = merge.merged(batch) if stored is None else merge.upserted(stored, batch)
        store.write(batch, number)
        if number == 1:
            store.split()
            store.compact()
    assert store.of == 4 and store.upto() == 1
    assert table(store.usage().select(*merge.COLUMNS)) == table(stored) == table(store.between().select(*merge.COLUMNS))
    assert table(store.rollup()) == table(rollup.built(stored).select(*rollup.KEYS, *rollup.SUMS))
    lo, hi = DAY_MS + 5 * HOUR_MS, 3 * DAY_MS + 7 * HOUR_MS
    assert table(store.between(lo, hi)) == table(stored.where(f"ts >= {lo} and ts < {hi}"))
    assert table(store.rollup(lo // HOUR_MS, hi // HOUR_MS)) == table(rollup.built(stored.where(f"ts >= {lo} and ts < {hi}")).select(*rollup.KEYS, *rollup.SUMS))


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    rng = random.Random(3)
    store = UsageStore(spark, f"file://{tmp_path}/s", buckets=2, days=2)
    work = into(store, lambda batch: batch, compact_every=3)
    batches = [spark.createDataFrame(rows_of(rng, range(20), 12), USAGE) for _ in range(3)]
    work(batches[0], 0)
    before = table(store.rollup())
    # cut off after its changes were written and one bucket was put in place: the rest follows from the changes
    (tmp_path / "s/deltas/batch=0/_SUCCESS").unlink()
    work(batches[0], 0)
    assert table(store.rollup()) == before
    for number in (1, 2):
        work(batches[number], number)
        work(batches[number], number)
    assert store.upto() == 2
    work(batches[2], 2)
    whole = merge.upserted(merge.upserted(merge.merged(batches[0]), batches[1]), batches[2])
    assert table(store.usage().select(*merge.COLUMNS)) == table(whole)
    assert table(store.rollup()) == table(rollup.built(whole).select(*rollup.KEYS, *rollup.SUMS))
    # what a batch adds for the second time gives no changes
    work(batches[1], 3)
    assert table(store.usage().select(*merge.COLUMNS)) == table(whole)
    assert not list((tmp_path / "s/changes/batch=3").glob("period=*"))


def test_an_empty_store_is_an_empty_table(spark, tmp_path):
    store = UsageStore(spark, f"file://{tmp_path}/s")
    assert table(store.usage()) == table(store.between(0, DAY_MS)) == table(store.rollup()) == []
    store.write(spark.createDataFrame([], USAGE), 0)
    store.compact()
    assert table(store.usage()) == table(store.between()) == table(store.rollup(0, 5)) == []


def test_a_batch_reads_the_buckets_of_its_keys_alone(spark, tmp_path):
    """The same batch reads about as many bytes of a store eight times as large with eight times as many buckets."""
    rng, read = random.Random(4), []
    for n, buckets in ((4_000, 4), (32_000, 32)):
        store = UsageStore(spark, f"file://{tmp_path}/{n}", buckets=buckets, days=5)
        store.write(spark.createDataFrame(rows_of(rng, range(n), n), USAGE), 0)
        touched = store._touched(spark.createDataFrame(rows_of(rng, [7, 77], 5), USAGE))
        assert "bucket" in filters(store.usage(touched)) and len(touched) <= 2
        read.append(sum(f.stat().st_size for b in touched for f in Path(tmp_path, f"{n}/usage/of={buckets}/bucket={b}").glob("*.parquet")) / len(touched))
    assert read[1] < 1.3 * read[0]


def test_ranges_read_their_partitions(spark, tmp_path):
    from dataclasses import replace

    from conftest import SMALL

    from meterlark import catalog
    from meterlark.plans.periods import Range

    rows = spark.createDataFrame(rows_of(random.Random(5), range(60), 60), USAGE)
    store = UsageStore(spark, f"file://{tmp_path}/s", buckets=1)
    store.write(rows, 0)
    span = Range(DAY_MS + 1, 3 * DAY_MS - 1)
    assert "period" in filters(store.between(span.start, span.end)) and "period" in filters(store.rollup(24, 48))
    merge.merged(rows).selectExpr("*", f"floor(ts / {DAY_MS}) as utc_day").write.partitionBy("utc_day").parquet(f"file://{tmp_path}/days")
    rollup.built(merge.merged(rows)).selectExpr("*", "floor(hour / 24) as day").write.partitionBy("day").parquet(f"file://{tmp_path}/hours")
    by_day = spark.read.schema(f"{USAGE}, utc_day long").parquet(f"file://{tmp_path}/days")
    asked = replace(catalog.q(spark, SMALL), usage=by_day)
    assert "utc_day" in filters(asked.totals(span))
    assert table(asked.totals(span)) == table(replace(asked, usage=merge.merged(rows)).totals(span))
    hours = spark.read.schema(f"{ROLLUP}, day long").parquet(f"file://{tmp_path}/hours")
    pruned = rollup.repriced(by_day, hours, asked.rates, span.start, span.end)
    assert "day" in filters(pruned) and table(pruned) == table(rollup.repriced(merge.merged(rows), rollup.built(merge.merged(rows)), asked.rates, span.start, span.end))
