"""The price of a row as a column: rates per million tokens, cache writes, long context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiples of the input rate where a card states no rate of its own.
CACHE_READ, CACHE_WRITE, WRITE_5M, WRITE_1H = 0.1, 1.25, 1.25, 2.0
MILLION = 1_000_000.0


def d(x: float) -> Column:
    return F.lit(float(x))


def tokens() -> Column:
    return F.col("inp") + F.col("outp") + F.col("cr") + F.col("cc")


def is_long() -> Column:
    """Input and cache reads (and cache writes where the card counts them) above the card's threshold."""
    prompt = F.col("inp") + F.col("cr") + F.when(F.col("lc_counts_cw"), F.col("cc")).otherwise(0)
    return F.coalesce(prompt > F.col("lc_threshold"), F.lit(False))


def cache_read_rate(in_mult: Column) -> Column:
    return F.when(F.col("cache_read").isNotNull(), F.col("cache_read") * in_mult).otherwise(F.col("input") * in_mult * d(CACHE_READ))


def row_cost() -> Column:
    """USD of a row joined with its card (columns of a rate dimension); the order of operations is part of the result."""
    long = F.col("is_long")
    in_mult = F.when(long, F.coalesce("lc_in_mult", d(1))).otherwise(d(1))
    out_mult = F.when(long, F.coalesce("lc_out_mult", d(1))).otherwise(d(1))
    ir = F.col("input") * in_mult / d(MILLION)
    base = F.col("inp") * ir + F.col("outp") * (F.col("output") * out_mult / d(MILLION)) + F.col("cr") * cache_read_rate(in_mult) / d(MILLION)
    return (
        F.when(F.col("cache_write").isNotNull(), base + F.col("cc") * F.col("cache_write") * in_mult / d(MILLION))
        .when(F.col("e5").isNull() & F.col("e1").isNull(), base + F.col("cc") * ir * d(CACHE_WRITE))
        .otherwise(base + F.coalesce("e5", F.lit(0)) * ir * d(WRITE_5M) + F.coalesce("e1", F.lit(0)) * ir * d(WRITE_1H))
    )


def nanos(usd: Column) -> Column:
    """Billionths of a dollar as an exact number, so that sums don't depend on order."""
    return F.floor(usd * d(1e9) + d(0.5)).cast("decimal(20,0)")


def usd(total_nanos: Column) -> Column:
    """A sum of nanos in dollars, to a millionth."""
    return F.floor(total_nanos.cast("double") / d(1e9) * d(1e6) + d(0.5)).cast("double") / d(1e6)
