"""Comparing two stores, and counts that tell a store's health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.functions.cost import usd
from meterlark.functions.models import PLACEHOLDER
from meterlark.operators import rollup
from meterlark.plans.periods import Zone
from meterlark.plans.usage import local_day

COUNTS = ("inp", "outp", "cr", "cc")
CELL = ("day", "acct", "model_key", "tier")


def cells(priced: DataFrame, zone: Zone) -> DataFrame:
    """Priced rows summed by local day, account, model and tier."""
    return priced.withColumn("day", local_day(zone)).groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in COUNTS), usd(F.coalesce(F.sum("nanos"), F.lit(0))).alias("cost"), F.count(F.lit(1)).alias("rows"))


def differing(before: DataFrame, after: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Cells that differ in a count or by more than the tolerance, with both sides and what kind of difference it is."""
    a = before.select(*(F.col(c).alias(f"a_{c}") for c in (*CELL, *COUNTS, "cost", "rows")))
    b = after.select(*(F.col(c).alias(f"b_{c}") for c in (*CELL, *COUNTS, "cost", "rows")))
    same = F.lit(True)
    for c in CELL:
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    both = a.join(b, same, "full_outer")
    zero = lambda side, c: F.coalesce(f"{side}_{c}", F.lit(0))
    counted = F.lit(False)
    for c in COUNTS:
        counted = counted | (zero("a", c) != zero("b", c))
    dear = F.abs(zero("b", "cost") - zero("a", "cost")) > tolerance
    kind: Column = F.when(F.col("a_day").isNull(), "only_after").when(F.col("b_day").isNull(), "only_before").when(counted & (zero("b", "rows") > zero("a", "rows")), "more_rows").when(counted & (zero("b", "rows") < zero("a", "rows")), "fewer_rows").when(counted, "counts").otherwise("price")
    total = lambda side: sum((zero(side, c) for c in COUNTS), F.lit(0))
    return both.where(counted | dear).select(*(F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in CELL), kind.alias("category"), (total("b") - total("a")).alias("tokens"), (zero("b", "cost") - zero("a", "cost")).alias("cost"), (zero("b", "rows") - zero("a", "rows")).alias("rows")).orderBy(*CELL)


def categories(differences: DataFrame) -> DataFrame:
    return differences.groupBy("category").agg(F.count(F.lit(1)).alias("cells"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost")).orderBy("category")


def health(usage: DataFrame, accounts: DataFrame, stored_rollup: DataFrame) -> DataFrame:
    """One row per provider: accounts, rows, models, rows without a known model, rows whose account is unknown; and the rollup's drift."""
    rows = usage.join(accounts.select(F.col("id").alias("acct"), "provider"), "acct", "left")
    by = rows.groupBy(F.coalesce("provider", F.lit("unknown")).alias("provider")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("acct").alias("accounts"), F.countDistinct("model").alias("models"), F.count_if(F.col("model") == PLACEHOLDER).alias("unattributed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    off = rollup.drift(stored_rollup, usage).agg(F.count(F.lit(1)).alias("drifted"))
    return by.join(F.broadcast(off), F.lit(True)).orderBy("provider")


#: Why a cell differs, in the order in which a row's difference is put down to a cause; the first that holds has all of it.
CAUSES = ("file_gone", "replayed", "row_gone", "row_new", "moved", "counts", "price")


def causes(before: DataFrame, after: DataFrame, zone: Zone, *, files_gone: DataFrame, replayed: DataFrame) -> DataFrame:
    """The differences of two stores' priced rows, cell by cell and cause by cause: what adds up to each cell's difference.

    Rows are matched by key.  files_gone and replayed: keys of rows whose file can't be read any more, and of rows dropped as a retold
    head.  A row whose day, account, model or tier changed is taken from one cell and put into another (`moved`); one whose counts
    changed has its cost's change put down to them; one of the same counts was priced otherwise.  A side's keys are unique and not null.
    """
    total = sum((F.coalesce(c, F.lit(0)) for c in COUNTS), F.lit(0))

    def told(rows: DataFrame, side: str) -> DataFrame:
        cell = F.struct(local_day(zone).alias("day"), "acct", "model_key", "tier")
        return rows.select(F.col("key").alias(f"{side}_key"), cell.alias(f"{side}_cell"), F.struct(*COUNTS).alias(f"{side}_counts"), total.alias(f"{side}_tokens"), F.coalesce("nanos", F.lit(0)).cast("decimal(38,0)").alias(f"{side}_nanos"))

    mark = lambda keys, name: keys.select(F.col("key").alias(f"{name}_key")).distinct().withColumn(name, F.lit(True))
    both = told(before, "a").join(told(after, "b"), F.col("a_key") == F.col("b_key"), "full_outer")
    both = both.join(mark(files_gone, "_gone"), F.col("a_key") == F.col("_gone_key"), "left").join(mark(replayed, "_again"), F.col("a_key") == F.col("_again_key"), "left")
    gone, new = F.col("b_key").isNull(), F.col("a_key").isNull()
    moved = ~F.col("a_cell").eqNullSafe(F.col("b_cell"))
    cause = F.when(gone & F.col("_gone"), "file_gone").when(gone & F.col("_again"), "replayed").when(gone, "row_gone").when(new, "row_new").when(moved, "moved").when(~F.col("a_counts").eqNullSafe(F.col("b_counts")), "counts").when(F.col("a_nanos") != F.col("b_nanos"), "price")
    part = lambda side, sign: F.struct(F.col(f"{side}_cell").alias("cell"), (F.col(f"{side}_tokens") * sign).alias("tokens"), (F.col(f"{side}_nanos") * sign).cast("decimal(38,0)").alias("nanos"), F.lit(sign).cast("long").alias("rows"))
    parts = F.when(gone, F.array(part("a", -1))).when(new, F.array(part("b", 1))).otherwise(F.array(part("a", -1), part("b", 1)))
    rows = both.withColumn("cause", cause).where("cause is not null").select("cause", F.explode(parts).alias("p"))
    sums = rows.groupBy("p.cell.day", "p.cell.acct", "p.cell.model_key", "p.cell.tier", "cause").agg(F.sum("p.tokens").alias("tokens"), F.sum("p.nanos").cast("decimal(38,0)").alias("nanos"), F.sum("p.rows").alias("rows"))
    return sums.select(*CELL, "cause", "tokens", "nanos", "rows")
