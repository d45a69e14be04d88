"""What the views show: overview, history, rate board and accounts, each by few aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlark.functions.cost import tokens, usd
from meterlark.functions.models import pretty_model
from meterlark.operators.pricing import measures, shown
from meterlark.plans.periods import Range, activity_range, resolve_period
from meterlark.plans.usage import UsageQueries, slot_day
from meterlark.sources.local import local_table
from meterlark.sources.rates import RateTable


def spend_columns(q: UsageQueries, now: int) -> DataFrame:
    """Cost of six periods, in one pass."""
    return q.spend({name if name[0].isalpha() else f"last_{name}": None if name == "all" else resolve_period(name, now, q.zone) for name in ("1h", "5h", "today", "this_week", "this_month", "all")})


def activity_series(q: UsageQueries, now: int, kind: str = "24h") -> DataFrame:
    """An aligned rolling window in buckets; the last one holds now."""
    span, bucket = activity_range(kind, now)
    return q.activity(span, (span.end - span.start) // bucket)


def history(q: UsageQueries, span: Range, unit: str) -> DataFrame:
    """Slots by model and by account, and their totals, from one aggregation by grouping sets."""
    rows = q.within(span).withColumn("slot", slot_day(q.zone, unit))
    slot, model, acct = F.col("slot"), F.col("model_key"), F.col("acct")
    out = rows.groupingSets([[slot], [slot, model], [slot, acct], [model], [acct], []], slot, model, acct).agg(F.grouping_id("slot", "model_key", "acct").cast("int").alias("grouping"), F.coalesce(F.sum(tokens()), F.lit(0)).alias("tokens"), usd(F.coalesce(F.sum("nanos"), F.lit(0))).alias("cost"), F.count(F.lit(1)).alias("records"))
    return out.orderBy("grouping", F.desc("slot"), F.desc("cost"))


def rate_board(q: UsageQueries, span: Range, now: int) -> DataFrame:
    """Models with usage, users, first use and current rates; names to show; cost marks."""
    use = q.by_model(span, now=now)
    users = q.model_users(span)
    seen = q.models_first_seen()
    mark = F.when(F.col("status") == "unpriced", "unpriced").when(F.col("status") == "partial", "*").when(F.col("est_tokens") > 0, "≈").otherwise("")
    return use.join(users, ["model_key", "tier"], "left").join(seen, "model_key", "left").withColumn("name", pretty_model(F.col("model_key"))).withColumn("mark", mark).orderBy(F.desc("cost"), F.desc("tokens"), "model_key", "tier")


def by_name(board: DataFrame) -> DataFrame:
    """A board by name as people sort it."""
    return board.orderBy(F.collate(F.col("name"), "UNICODE"), "tier")


def account_rows(q: UsageQueries, span: Range, now: int, quiet_ms: int = 30 * 86_400_000) -> DataFrame:
    """Accounts, those in use first, then by cost, tokens and id."""
    rows = q.by_account(span).join(q.accounts_seen().select("id", "first_seen", "last_seen"), "id")
    return rows.withColumn("away", F.coalesce(F.lit(now) - F.col("last_seen") > quiet_ms, F.lit(True))).orderBy("away", F.desc("cost"), F.desc("tokens"), "id")


def merged_shares(groups: DataFrame, *by: str) -> DataFrame:
    """Groups of measures merged: costs and tokens summed, the priced share weighted by tokens."""
    out = groups.groupBy(*by).agg(F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"), F.sum("priced_tokens").alias("_p"))
    return out.select(*by, "cost", "tokens", F.when(F.col("tokens") > 0, F.col("_p") / F.col("tokens")).otherwise(1.0).alias("priced_share"))


def days_within(q: UsageQueries, span: Range, unit: str, first: str) -> DataFrame:
    """The days of one week or month of a history, newest first."""
    rows = q.within(span).withColumn("slot", slot_day(q.zone, unit)).where(F.col("slot") == F.lit(first).cast("date")).withColumn("day", slot_day(q.zone, "day"))
    return rows.groupBy("day").agg(*measures()).select("day", *shown()).orderBy(F.desc("day"))


def spark_level(value: Column, levels: int = 7) -> Column:
    """1 to `levels` by share of the most over all rows; 0 for none."""
    most = F.max(value).over(W.partitionBy())
    return F.when((value <= 0) | (most <= 0), 0).otherwise(F.least(F.lit(levels), F.ceil(value / most * levels))).cast("int")


def column_edges(n: int, width: int) -> list[int]:
    """Where each of n columns begins in a width, and the end."""
    return [i * width // n for i in range(n + 1)]


def account_list(accounts: DataFrame, groups: DataFrame, status: DataFrame, usage: DataFrame, current: str | None) -> DataFrame:
    """Every root: id, label, provider, group (null: none), known (whether it or one of its group has a sign-in state), last_seen, is_current.

    accounts: id, provider, identity, label.  groups: identity, group.  status: identity of each root with a state.
    """
    grouped = accounts.join(groups, "identity", "left")
    stated = status.select("identity").distinct()
    own = grouped.join(stated.withColumn("_own", F.lit(True)), "identity", "left")
    by_group = groups.join(stated, "identity", "left_semi").select("group").distinct().withColumn("_group", F.lit(True))
    seen = usage.groupBy("acct").agg(F.max("ts").alias("last_seen"))
    out = own.join(by_group, "group", "left").join(seen, F.col("id") == F.col("acct"), "left")
    return out.select(F.col("identity").alias("id"), "label", "provider", "group", F.coalesce("_own", "_group", F.lit(False)).alias("known"), "last_seen", F.coalesce(F.col("identity") == F.lit(current), F.lit(False)).alias("is_current"))


def rate_cards(table: RateTable, bundled: RateTable, spark: SparkSession, now: int) -> DataFrame:
    """Each model's card in force now: rates, fast pair, threshold, the model it is estimated as, and its source.

    source: `alias` where another model's card stands in, `override` where the bundled card or its fast pair differs, else `bundled`.
    """
    rates = ["input", "output", "cache_read", "cache_write", "lc_threshold"]
    current = lambda t: t.dimension(spark).where((F.col("from_ms") <= now) & (F.col("to_ms") > now))
    standard = lambda t: current(t).where("tier = 0").select("model_key", *rates, "estimated")
    fast = lambda t: current(t).where("tier = 1 and status = 'priced'").select("model_key", F.col("input").alias("fast_input"), F.col("output").alias("fast_output"))
    cards = lambda t: standard(t).join(fast(t), "model_key", "left")
    known = cards(bundled)
    shown = [*rates, "fast_input", "fast_output"]
    both = cards(table).join(known.select("model_key", *(F.col(c).alias(f"_{c}") for c in shown), F.lit(True).alias("_known")), "model_key", "left")
    targets = [(k, [m for t, m in spans if t <= now][-1]) for k, spans in table.aliases.items() if any(t <= now for t, _ in spans)]
    both = both.join(local_table(spark, targets, "model_key string, _target string"), "model_key", "left")
    same = F.col("_known").isNotNull()
    for c in shown:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    as_other = F.when(F.col("estimated"), F.col("_target"))
    source = F.when(as_other.isNotNull(), "alias").when(same, "bundled").otherwise("override")
    return both.select("model_key", "input", "output", F.coalesce("cache_read", F.col("input") * 0.1).alias("cache_read"), "cache_write", "fast_input", "fast_output", "lc_threshold", as_other.alias("estimated_as"), source.alias("source"))


def timings(runs: DataFrame) -> DataFrame:
    """Runs, median and 95th percentile (between neighbours) of `taken` by name."""
    return runs.groupBy("name").agg(F.count(F.lit(1)).alias("runs"), F.percentile("taken", 0.5).alias("median"), F.percentile("taken", 0.95).alias("p95"))
