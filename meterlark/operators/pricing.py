"""Pricing rows: the temporal join with the rate dimension and the measures every aggregate carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.functions.cost import is_long, nanos, row_cost, tokens, usd
from meterlark.functions.models import normalize_model
from meterlark.sources.local import is_small


def priced(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Each row with model_key, price status (`priced`, `unpriced`, `unpriced-tier`), cost in nanos and is_estimated.

    A stored table may have model_key already; else it is worked out for each row.  One equi-join on model and tier with the interval as residual; the dimension has a few rows per model and is broadcast
    where its size is known to be small.
    """
    rows = (usage if "model_key" in usage.columns else usage.withColumn("model_key", normalize_model(F.col("model")))).withColumn("tier", F.least(F.col("tier"), F.lit(1)))
    dim = rates.withColumnRenamed("model_key", "_key").withColumnRenamed("tier", "_tier")
    joined = rows.join(F.broadcast(dim) if is_small(rates) else dim, (F.col("model_key") == F.col("_key")) & (F.col("tier") == F.col("_tier")) & (F.col("ts") >= F.col("from_ms")) & (F.col("ts") < F.col("to_ms")), "left")
    joined = joined.withColumn("is_long", is_long())
    status = F.when(F.col("status").isNull(), "unpriced").when((F.col("status") == "priced") & F.col("is_long") & F.col("lc_unpriced"), "unpriced-tier").otherwise(F.col("status"))
    joined = joined.withColumn("price_status", status)
    return joined.select(*(c for c in usage.columns if c != "model_key"), "model_key", "price_status", "is_long", F.when(F.col("price_status") == "priced", nanos(row_cost())).alias("nanos"), F.coalesce("estimated", F.lit(False)).alias("is_estimated"))


def measures() -> list[Column]:
    """The ten additive measures over priced rows."""
    total = tokens()
    zero = F.lit(0).cast("long")
    when = lambda c, x=None: F.sum(F.when(c, total if x is None else x).otherwise(zero if x is None else F.lit(0).cast("decimal(20,0)")))
    status = F.col("price_status")
    return [
        *(F.coalesce(F.sum(c), zero).alias(c) for c in ("inp", "outp", "cr", "cc")),
        F.count("key").alias("records"),
        F.coalesce(F.sum("nanos"), F.lit(0)).cast("decimal(38,0)").alias("nanos"),
        F.coalesce(when(status == "unpriced"), zero).alias("unpriced_tokens"),
        F.coalesce(when(status == "unpriced-tier"), zero).alias("unpriced_tier_tokens"),
        F.coalesce(when(F.col("is_estimated") & (status == "priced"), F.col("nanos")), F.lit(0)).cast("decimal(38,0)").alias("est_nanos"),
        F.coalesce(when(F.col("is_estimated") & (status == "priced")), zero).alias("est_tokens"),
    ]


def summed() -> list[Column]:
    """Measures of groups of measures."""
    zero = F.lit(0).cast("long")
    return [F.coalesce(F.sum(c), zero).alias(c) for c in ("inp", "outp", "cr", "cc", "records")] + [F.coalesce(F.sum("nanos"), F.lit(0)).cast("decimal(38,0)").alias("nanos"), F.coalesce(F.sum("unpriced_tokens"), zero).alias("unpriced_tokens"), F.coalesce(F.sum("unpriced_tier_tokens"), zero).alias("unpriced_tier_tokens"), F.coalesce(F.sum("est_nanos"), F.lit(0)).cast("decimal(38,0)").alias("est_nanos"), F.coalesce(F.sum("est_tokens"), zero).alias("est_tokens")]


def shown() -> list[Column]:
    """A usage document's columns from measures: tokens, cost, coverage, priced share, status."""
    total = F.col("inp") + F.col("outp") + F.col("cr") + F.col("cc")
    missing = F.col("unpriced_tokens") + F.col("unpriced_tier_tokens")
    return [
        F.col("inp").alias("input"), F.col("outp").alias("output"), F.col("cr").alias("cache_read"), F.col("cc").alias("cache_write"), total.alias("tokens"), "records", usd(F.col("nanos")).alias("cost"),
        (total - missing).alias("priced_tokens"), "unpriced_tokens", "unpriced_tier_tokens", usd(F.col("est_nanos")).alias("est_cost"), "est_tokens",
        F.when(total == 0, F.lit(1.0)).otherwise((total - missing) / total).alias("priced_share"), price_status(total).alias("status"),
    ]


def price_status(total: Column) -> Column:
    return F.when(F.col("unpriced_tokens") > 0, "unpriced").when((F.col("unpriced_tier_tokens") > 0) & (F.col("unpriced_tier_tokens") >= total), "unpriced-tier").when(F.col("unpriced_tier_tokens") > 0, "partial").otherwise("priced")
