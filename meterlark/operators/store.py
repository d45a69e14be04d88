"""A stored usage table whose work follows the batch: rows in buckets of their key, and what each batch changed.

    path/usage/of=K/bucket=B            merged rows by a hash of the key, K buckets
    path/changes/batch=N/period=P       rows that batch N took back (sign -1) and put in their place (sign 1)
    path/deltas/batch=N/period=P        the same as signed sums of the hourly rollup
    path/days/upto=N, path/hours/upto=N what the batches up to N come to, after a compaction

A batch reads and overwrites the buckets of its own keys alone; `split` doubles their number as the store grows, so that a
bucket keeps its size and a batch of k keys reads k buckets at most.  The first writer's time stays with a key, so all versions
of a row are of one period: a range of time is read from its periods' changes, without the others and without the buckets.

A batch run twice leaves the same tables.  Its changes are worked out once, before any bucket is written, and are taken as they
are when it runs again; the rest follows from them.  A folder counts once it is whole, so a batch or a compaction that was
cut off is not seen.  Batches come in the order of their numbers, one at a time, as a stream's do.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.functions.models import PLACEHOLDER
from meterlark.operators import merge, rollup
from meterlark.schema import DAY_MS, HOUR_MS, ROLLUP, USAGE
from meterlark.sources.shared import parts, read, removed, whole

CHANGES = f"{USAGE}, sign int, batch int, period long"
DELTAS = f"{ROLLUP}, batch int, period long"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def differences(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """What merging incoming rows (one per key) into stored ones changes: signed rows; a merge that changes nothing gives none.

    One join on the key: the stored row's account, time and real model stay, counters go up to the larger.
    """
    old = stored.select(*(F.col(c).alias(f"_{c}") for c in merge.COLUMNS))
    both = incoming.select(*merge.COLUMNS).join(old, F.col("key") == F.col("_key"), "left")
    known = F.col("_key").isNotNull()
    model = F.when(known & (F.col("_model") != PLACEHOLDER), F.col("_model")).otherwise(F.col("model"))
    first = {c: F.coalesce(f"_{c}", c) for c in ("acct", "ts")}
    after = F.struct("key", *(x.alias(c) for c, x in first.items()), model.alias("model"), *(F.greatest(c, f"_{c}").alias(c) for c in merge.COUNTERS), F.lit(1).alias("sign"))
    before = F.struct(*(F.col(f"_{c}").alias(c) for c in merge.COLUMNS), F.lit(-1).alias("sign"))
    told = both.select(known.alias("known"), before.alias("before"), after.alias("after"))
    same = reduce(lambda x, c: x & F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), merge.COLUMNS, F.lit(True))
    rows = F.when(~F.col("known"), F.array("after")).when(~same, F.array("before", "after")).otherwise(F.array().cast(f"array<struct<{USAGE.replace(' ', ':').replace(',:', ',')},sign:int>>"))
    return told.select(F.explode(rows).alias("x")).select("x.*")


@dataclass(frozen=True)
class UsageStore:
    """The stored usage table below a folder that all executors see.

    buckets: of a new store.  days: UTC days of one period, the partition of what is kept by time; one where a day has
    rows for whole files, more where batches reach over years of few rows.  A store keeps the days it was begun with.
    """

    spark: SparkSession
    path: str
    buckets: int = 16
    days: int = 1

    def period(self, ms: int) -> int:
        return ms // (self.days * DAY_MS)

    def period_of(self, ms: Column) -> Column:
        return F.floor(ms / (self.days * DAY_MS)).cast("long")

    # --- reading -------------------------------------------------------------------------------------------------

    @property
    def of(self) -> int:
        """The present number of buckets: the largest that is whole."""
        return max(parts(self.spark, f"{self.path}/usage", "of"), default=self.buckets)

    def usage(self, touched: list[int] | None = None) -> DataFrame:
        """The merged rows with their bucket; those of some buckets alone, as a partition filter."""
        path, schema = f"{self.path}/usage/of={self.of}", f"{USAGE}, bucket int"
        rows = read(self.spark, path, schema) if whole(self.spark, path) else self.spark.createDataFrame([], schema)
        return rows if touched is None else rows.where(F.col("bucket").isin(touched))

    def upto(self) -> int:
        """The batch up to which all is compacted; -1 if none."""
        done = set(parts(self.spark, f"{self.path}/hours", "upto")) & set(parts(self.spark, f"{self.path}/days", "upto"))
        return max(done, default=-1)

    def _since(self, name: str, schema: str, upto: int) -> DataFrame:
        fresh = [n for n in parts(self.spark, f"{self.path}/{name}", "batch") if n > upto]
        return read(self.spark, f"{self.path}/{name}", schema).where(F.col("batch").isin(fresh))

    def between(self, lo_ms: int | None = None, hi_ms: int | None = None) -> DataFrame:
        """The merged rows of [lo, hi): only its periods' partitions are read, and of each key the newest version stays."""
        upto = self.upto()
        base = read(self.spark, f"{self.path}/days/upto={upto}", f"{USAGE}, period long").withColumns({"sign": F.lit(1), "batch": F.lit(upto)})
        rows = base.unionByName(self._since("changes", CHANGES, upto))
        if lo_ms is not None:
            rows = rows.where((F.col("period") >= self.period(lo_ms)) & (F.col("ts") >= lo_ms))
        if hi_ms is not None:
            rows = rows.where((F.col("period") <= self.period(hi_ms - 1)) & (F.col("ts") < hi_ms))
        newest = rows.where("sign = 1").groupBy("period", "key").agg(F.max_by(F.struct(*merge.COLUMNS[1:]), "batch").alias("x"))
        return newest.select("key", "x.*")

    def rollup(self, lo_hour: int | None = None, hi_hour: int | None = None) -> DataFrame:
        """The hourly rollup of hours [lo, hi): the compacted sums and the signed ones since, added; empty buckets are gone."""
        upto = self.upto()
        rows = read(self.spark, f"{self.path}/hours/upto={upto}", f"{ROLLUP}, period long").unionByName(self._since("deltas", DELTAS, upto).drop("batch"))
        if lo_hour is not None:
            rows = rows.where((F.col("period") >= self.period(lo_hour * HOUR_MS)) & (F.col("hour") >= lo_hour))
        if hi_hour is not None:
            rows = rows.where((F.col("period") <= self.period((hi_hour - 1) * HOUR_MS)) & (F.col("hour") < hi_hour))
        return rows.groupBy("period", *rollup.KEYS).agg(*(F.sum(c).alias(c) for c in rollup.SUMS)).where("n > 0").select(*rollup.KEYS, *rollup.SUMS)

    # --- writing -------------------------------------------------------------------------------------------------

    def write(self, rows: DataFrame, number: int) -> None:
        """Merge one batch of usage rows in."""
        if number <= self.upto():
            return
        changes = f"{self.path}/changes/batch={number}"
        if not whole(self.spark, changes):
            new = merge.merged(merge.storable(rows)).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                touched = self._touched(new)
                made = differences(self.usage(touched), new)
                self._by_period(made, F.col("ts"), changes)
            finally:
                new.unpersist()
        made = read(self.spark, changes, f"{USAGE}, sign int, period long")
        self._by_period(rollup.signed(made), F.col("hour") * HOUR_MS, f"{self.path}/deltas/batch={number}")
        after = made.where("sign = 1").select(*merge.COLUMNS)
        buckets = self.of
        touched = self._touched(after)
        if touched or not whole(self.spark, f"{self.path}/usage/of={buckets}"):
            left = self.usage(touched).join(after.select("key"), "key", "left_anti").select(*merge.COLUMNS)
            self._put(left.unionByName(after), buckets)

    def _by_period(self, rows: DataFrame, ms: Column, path: str) -> None:
        """A period's rows together, in as many files as their bytes ask for."""
        rows.withColumn("period", self.period_of(ms)).hint("rebalance", "period").write.mode("overwrite").partitionBy("period").parquet(path)

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows: as many numbers at most as there are buckets."""
        return sorted(r["bucket"] for r in rows.select(bucket_of("key", self.of).alias("bucket")).distinct().collect())

    def _put(self, rows: DataFrame, buckets: int) -> None:
        """Rows in place of their buckets'; a table that isn't whole yet is written as one, as only such a write marks it whole."""
        path = f"{self.path}/usage/of={buckets}"
        mode = "dynamic" if whole(self.spark, path) else "static"
        out = rows.withColumn("bucket", bucket_of("key", buckets)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", mode)
        out.partitionBy("bucket").parquet(path)

    def split(self) -> None:
        """Twice as many buckets: for a store that has doubled.  The old ones go once the new ones are whole."""
        old = self.of
        if not whole(self.spark, f"{self.path}/usage/of={old}"):
            return
        self._put(self.usage().drop("bucket"), 2 * old)
        removed(self.spark, f"{self.path}/usage/of={old}")

    def compact(self) -> None:
        """Fold the batches' changes and deltas into one table each; then they and the tables before go."""
        numbers, before = parts(self.spark, f"{self.path}/deltas", "batch"), self.upto()
        last = max(numbers, default=before)
        if last > before:
            self._by_period(self.between(), F.col("ts"), f"{self.path}/days/upto={last}")
            self._by_period(self.rollup(), F.col("hour") * HOUR_MS, f"{self.path}/hours/upto={last}")
        for n in parts(self.spark, f"{self.path}/changes", "batch"):
            if n <= last:
                removed(self.spark, f"{self.path}/changes/batch={n}")
                removed(self.spark, f"{self.path}/deltas/batch={n}")
        for name in ("days", "hours"):
            for n in parts(self.spark, f"{self.path}/{name}", "upto"):
                if n < last:
                    removed(self.spark, f"{self.path}/{name}/upto={n}")


def into(store: UsageStore, usage_rows, compact_every: int = 64):
    """For foreachBatch: each batch's usage rows (usage_rows(batch)) merged into the store, its changes folded now and then."""

    def work(batch: DataFrame, number: int) -> None:
        store.write(usage_rows(batch), number)
        if number % compact_every == compact_every - 1:
            store.compact()

    return work
