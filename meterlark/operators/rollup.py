"""The hourly rollup: built, kept up by deltas, checked, and used to answer queries without the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.schema import DAY_MS, HOUR_MS
from meterlark.sources.local import is_small

KEYS = ("hour", "acct", "model", "tier")
SUMS = ("inp", "outp", "cr", "cc", "e5", "e1", "ccx", "n")


def _as_sums(usage: DataFrame, *more: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    return usage.select(
        F.floor(F.col("ts") / HOUR_MS).cast("long").alias("hour"), "acct", "model", "tier", "inp", "outp", "cr", "cc",
        F.coalesce("e5", zero).alias("e5"), F.coalesce("e1", zero).alias("e1"),
        F.when(F.col("e5").isNull() & F.col("e1").isNull(), F.col("cc")).otherwise(zero).alias("ccx"), F.lit(1).cast("long").alias("n"), *more,
    )


def built(usage: DataFrame) -> DataFrame:
    """Sums per hour, account, model and tier; ccx has cache writes of rows without buckets, which are priced otherwise."""
    return _as_sums(usage).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))


def maintained(rollup: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The rollup after rows changed from before to after (rows of changed keys only): signed sums, empty buckets gone."""
    minus = _as_sums(before).select(*KEYS, *((-F.col(c)).alias(c) for c in SUMS))
    return rollup.select(*KEYS, *SUMS).unionByName(minus).unionByName(_as_sums(after)).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("n > 0")


def signed(changes: DataFrame) -> DataFrame:
    """Signed sums of changed rows (sign -1 taken back, 1 put in): what is to be added to the rollup; buckets that stay the same are left out."""
    sums = _as_sums(changes, "sign").groupBy(*KEYS).agg(*(F.sum(F.col(c) * F.col("sign")).alias(c) for c in SUMS))
    return sums.where(reduce(lambda x, c: x | (F.col(c) != 0), SUMS, F.lit(False)))


def drift(rollup: DataFrame, usage: DataFrame) -> DataFrame:
    """Buckets that differ from a rebuild, either way: none in a healthy store."""
    fresh = built(usage).select(*KEYS, *SUMS)
    own = rollup.select(*KEYS, *SUMS)
    return own.exceptAll(fresh).withColumn("side", F.lit("stored")).unionByName(fresh.exceptAll(own).withColumn("side", F.lit("rebuilt")))


def counts_agree(rollup: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: rows stored, rows the rollup counts, whether they agree."""
    a = usage.agg(F.count(F.lit(1)).alias("rows"))
    b = rollup.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("counted"))
    return a.join(b, F.lit(True)).select("rows", "counted", (F.col("rows") == F.col("counted")).alias("agree"))


def repriced(usage: DataFrame, rollup: DataFrame, rates: DataFrame, lo_ms: int, hi_ms: int) -> DataFrame:
    """Measures by model key and tier in [lo, hi): whole hours from the rollup, edges and what sums can't price from rows.

    A bucket is priced as one row unless a card changes inside its hour or the bucket could hold a long-context row; those
    hours' rows are read.  Sums of prompt tokens bound every row's, so a bucket below the threshold holds no long row.
    Tables stored by day (usage with utc_day, a rollup with day) are read only for the range's days.
    """
    from meterlark.functions.models import normalize_model
    from meterlark.operators.pricing import measures, priced

    first, last = -(-lo_ms // HOUR_MS), hi_ms // HOUR_MS
    buckets = rollup.where((F.col("hour") >= first) & (F.col("hour") < last))
    if "day" in rollup.columns:
        buckets = buckets.where((F.col("day") >= lo_ms // DAY_MS) & (F.col("day") <= (hi_ms - 1) // DAY_MS)).drop("day")
    if "utc_day" in usage.columns:
        usage = usage.where((F.col("utc_day") >= lo_ms // DAY_MS) & (F.col("utc_day") <= (hi_ms - 1) // DAY_MS))
    limits = rates.groupBy("model_key").agg(F.min("lc_threshold").alias("_limit"), F.collect_set("from_ms").alias("_starts"))
    keyed = buckets.withColumn("_key", normalize_model(F.col("model"))).join(F.broadcast(limits) if is_small(rates) else limits, F.col("_key") == F.col("model_key"), "left").drop("model_key")
    begin = F.col("hour") * HOUR_MS
    cut = F.exists(F.coalesce("_starts", F.array().cast("array<bigint>")), lambda t: (t > begin) & (t < begin + HOUR_MS))
    by_rows = F.coalesce(F.col("inp") + F.col("cr") + F.col("cc") > F.col("_limit"), F.lit(False)) | cut
    keyed = keyed.withColumn("_by_rows", by_rows)
    # a bucket stands for two rows: with buckets, and the cache writes without
    told = keyed.where("not _by_rows")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    plain = F.struct("inp", "outp", "cr", (F.col("cc") - F.col("ccx")).alias("cc"), "e5", "e1", "n")
    extra = F.struct(zero.alias("inp"), zero.alias("outp"), zero.alias("cr"), F.col("ccx").alias("cc"), none.alias("e5"), none.alias("e1"), zero.alias("n"))
    both = told.select(F.col("hour").alias("key"), "acct", begin.alias("ts"), "model", "tier", F.explode(F.when(F.col("ccx") > 0, F.array(plain, extra)).otherwise(F.array(plain))).alias("x"))
    columns = ["key", "acct", "ts", "model", "inp", "outp", "cr", "cc", "e5", "e1", "tier", "n"]
    # one scan of the rows: those of the edges, and those of hours whose sums don't price
    hours = keyed.where("_by_rows").select("hour", "acct", "model", "tier", F.lit(True).alias("_read"))
    ranged = usage.where((F.col("ts") >= lo_ms) & (F.col("ts") < hi_ms)).withColumn("hour", F.floor(F.col("ts") / HOUR_MS).cast("long")).join(hours, ["hour", "acct", "model", "tier"], "left")
    rows = ranged.where((F.col("hour") < first) | (F.col("hour") >= last) | F.col("_read")).withColumn("n", F.lit(1).cast("long"))
    every = both.select("*", "x.*").select(*columns).unionByName(rows.select(*columns))
    return priced(every, rates).groupBy("model_key", "tier").agg(*measures(), F.sum("n").alias("_n")).drop("records").withColumnRenamed("_n", "records")
