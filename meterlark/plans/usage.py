"""The usage queries: one scan of priced rows per answer, aggregated by what is asked for."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlark.functions.cost import tokens, usd
from meterlark.functions.models import model_matches, normalize_model
from meterlark.operators.pricing import measures, priced, shown
from meterlark.plans.periods import HOUR, Range, Zone, calendar_slices, equal_buckets, spine
from meterlark.schema import DAY_MS

#: An answer with more calendar groups than this is refused before it is computed.
MOST_GROUPS = 500
MEASURES = ("inp", "outp", "cr", "cc", "records", "nanos", "unpriced_tokens", "unpriced_tier_tokens", "est_nanos", "est_tokens")


def local_day(zone: Zone) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(F.col("ts")), zone.name))


def slot_day(zone: Zone, unit: str) -> Column:
    day = local_day(zone)
    return day if unit == "day" else F.to_date(F.date_trunc(unit, day))


def bucket_of(span: Range, n: int) -> Column:
    """The index of the row's bucket among equal_buckets(span, n), by arithmetic: no join with the edges."""
    width = (span.end - span.start) / n
    edge = lambda i: F.lit(span.start) + F.floor(i.cast("double") * F.lit(width) + F.lit(0.5)).cast("long")
    guess = F.floor((F.col("ts") - span.start) / F.lit(width)).cast("int")
    exact = F.when(F.col("ts") < edge(guess), guess - 1).when((guess + 1 < n) & (F.col("ts") >= edge(guess + 1)), guess + 1).otherwise(guess)
    return F.greatest(F.least(exact, F.lit(n - 1)), F.lit(0))


@dataclass(frozen=True)
class UsageQueries:
    """Usage, accounts and a rate dimension, with a zone and optional filters; every method is one DataFrame."""

    usage: DataFrame
    accounts: DataFrame
    rates: DataFrame
    zone: Zone
    account_ids: tuple[int, ...] | None = None
    provider: str | None = None

    @property
    def spark(self) -> SparkSession:
        return self.usage.sparkSession

    def selected(self) -> DataFrame:
        """The accounts that the filters leave."""
        out = self.accounts
        if self.account_ids is not None:
            out = out.where(F.col("id").isin(list(self.account_ids)))
        return out if self.provider is None else out.where(F.col("provider") == self.provider)

    def named(self, name: str) -> UsageQueries:
        """With the accounts that a name means: an id, else every account with that label in any case; unknown names are refused."""
        found = [r["id"] for r in self.accounts.where((F.col("id").cast("string") == name)).collect()] or [r["id"] for r in self.accounts.where(F.lower("label") == name.lower()).collect()]
        if not found:
            raise ValueError(f"no such account: {name!r}")
        return replace(self, account_ids=tuple(found))

    @cached_property
    def filtered(self) -> DataFrame:
        if self.account_ids is None and self.provider is None:
            return self.usage
        if self.provider is None:
            return self.usage.where(F.col("acct").isin(list(self.account_ids)))
        return self.usage.join(self.selected().select(F.col("id").alias("acct")), "acct", "left_semi")

    def within(self, span: Range | None) -> DataFrame:
        """Priced rows of a range; a table stored by utc_day is read only for its days."""
        rows = self.filtered if span is None else self.filtered.where((F.col("ts") >= span.start) & (F.col("ts") < span.end))
        if span is not None and "utc_day" in rows.columns:
            rows = rows.where((F.col("utc_day") >= span.start // DAY_MS) & (F.col("utc_day") <= (span.end - 1) // DAY_MS))
        return priced(rows, self.rates)

    def extent(self) -> tuple[int, int] | None:
        lo, hi = self.usage.agg(F.min("ts"), F.max("ts")).first()
        return None if lo is None else (lo, hi)

    # --- totals ------------------------------------------------------------------------------------------------

    def totals(self, span: Range | None = None) -> DataFrame:
        return self.within(span).agg(*measures()).select(*shown())

    def unpriced(self, span: Range | None = None) -> DataFrame:
        """Tokens without a price by model, tier and reason: most first."""
        out = self.within(span).where("price_status != 'priced'").groupBy("model_key", "tier", F.col("price_status").alias("reason")).agg(F.sum(tokens()).alias("tokens")).where("tokens > 0")
        return out.orderBy(F.desc("tokens"), "model_key", "tier")

    # --- groups ------------------------------------------------------------------------------------------------

    def by_model(self, span: Range | None = None, *, now: int | None = None, match: str | None = None) -> DataFrame:
        """Per model and tier: usage, share of the cost, status, and the rates in effect now."""
        rows = self.within(span)
        if match:
            rows = rows.where(model_matches(F.col("model_key"), match))
        out = rows.groupBy("model_key", "tier").agg(*measures()).where("records > 0").withColumn("share", self.share())
        out = out.select("model_key", "tier", *shown(), "share")
        if now is not None:
            current = self.rates.where((F.col("from_ms") <= now) & (F.col("to_ms") > now)).select("model_key", "tier", F.col("input").alias("rate_input"), F.col("output").alias("rate_output"), F.coalesce("cache_read", F.col("input") * 0.1).alias("rate_cache_read"), F.coalesce("cache_write", F.col("input") * 1.25).alias("rate_cache_write"))
            out = out.join(current, ["model_key", "tier"], "left")
        return out.orderBy(F.desc("cost"), F.desc("tokens"), "model_key", "tier")

    @staticmethod
    def share() -> Column:
        total = F.sum("nanos").over(W.partitionBy())
        return F.when(total > 0, F.col("nanos").cast("double") / total.cast("double")).otherwise(F.lit(0.0))

    def by_account(self, span: Range | None = None) -> DataFrame:
        """Every selected account, idle ones with zeros; rows of unknown accounts are left out."""
        sums = self.within(span).groupBy("acct").agg(*measures())
        zero = [F.coalesce(c, F.lit(0)).cast(sums.schema[c].dataType).alias(c) for c in MEASURES]
        out = self.selected().join(sums, F.col("id") == F.col("acct"), "left").select("id", "provider", "label", *zero).withColumn("share", self.share())
        return out.select("id", "provider", "label", *shown(), "share").orderBy(F.desc("cost"), F.desc("tokens"), "label")

    def by_calendar(self, span: Range, unit: str) -> DataFrame:
        """Days, weeks or months of a range, empty ones too, each with its top model (cost, then tokens, then name)."""
        slices = calendar_slices(span, unit, self.zone)
        if len(slices) > MOST_GROUPS:
            raise ValueError(f"{len(slices)} groups; at most {MOST_GROUPS}")
        sums = self.within(span).withColumn("day", slot_day(self.zone, unit)).groupBy("day", "model_key").agg(*measures())
        ranked = sums.withColumn("_rank", F.row_number().over(W.partitionBy("day").orderBy(F.desc("nanos"), F.desc(F.col("inp") + F.col("outp") + F.col("cr") + F.col("cc")), "model_key")))
        by_day = ranked.groupBy("day").agg(*(F.sum(c).alias(c) for c in MEASURES), F.max(F.when(F.col("_rank") == 1, F.col("model_key"))).alias("top_model"))
        days = spine(self.spark, [s for _, s in slices], [d for d, _ in slices])
        zero = [F.coalesce(c, F.lit(0)).cast(by_day.schema[c].dataType).alias(c) for c in MEASURES]
        return days.join(by_day, "day", "left").select("day", "lo", "hi", *zero, "top_model").select("day", "lo", "hi", *shown(), "top_model").orderBy("day")

    def activity(self, span: Range, n: int) -> DataFrame:
        """n equal buckets, empty ones too."""
        sums = self.within(span).withColumn("slot", bucket_of(span, n)).groupBy("slot").agg(F.sum(tokens()).alias("tokens"), F.sum("nanos").alias("nanos"))
        return spine(self.spark, equal_buckets(span, n)).join(sums, "slot", "left").select("slot", "lo", "hi", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), usd(F.coalesce("nanos", F.lit(0))).alias("cost")).orderBy("slot")

    def pace(self, now: int, minutes: int = 30) -> DataFrame:
        """Per account, spend and tokens of the last minutes (now included) scaled to an hour."""
        span = Range(now - minutes * 60_000, now + 1)
        sums = self.within(span).groupBy("acct").agg(F.sum(tokens()).alias("tokens"), F.sum("nanos").alias("nanos"))
        per_hour = F.lit(60.0 / minutes)
        return self.selected().join(sums, F.col("id") == F.col("acct"), "left").select("id", (F.coalesce("tokens", F.lit(0)) * per_hour).alias("tokens_per_hour"), (usd(F.coalesce("nanos", F.lit(0))) * per_hour).alias("cost_per_hour")).orderBy("id")

    def accounts_seen(self) -> DataFrame:
        """Every selected account's first and last use, null for none."""
        seen = self.filtered.groupBy("acct").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        return self.selected().join(seen, F.col("id") == F.col("acct"), "left").select("id", "label", "first_seen", "last_seen").orderBy("id")

    def models_first_seen(self) -> DataFrame:
        return self.filtered.groupBy(normalize_model(F.col("model")).alias("model_key")).agg(F.min("ts").alias("first_seen")).orderBy("model_key")

    # --- several ranges or groupings at once -----------------------------------------------------------------------

    def spend(self, spans: dict[str, Range | None]) -> DataFrame:
        """One row, a cost per named range, by conditional sums over one scan."""
        known = [s for s in spans.values() if s is not None]
        whole = None if len(known) < len(spans) or not known else Range(min(s.start for s in known), max(s.end for s in known))
        inside = lambda s: F.lit(True) if s is None else (F.col("ts") >= s.start) & (F.col("ts") < s.end)
        return self.within(whole).agg(*(usd(F.coalesce(F.sum(F.when(inside(s), F.col("nanos"))), F.lit(0))).alias(k) for k, s in spans.items()))

    def top_models(self, span: Range | None = None, n: int = 5) -> DataFrame:
        """The n models first by cost and the n first by tokens, with both shares."""
        sums = self.within(span).groupBy("model_key").agg(F.sum("nanos").alias("nanos"), F.sum(tokens()).alias("tokens"))
        whole = W.partitionBy()
        out = sums.select(
            "model_key", usd(F.coalesce("nanos", F.lit(0))).alias("cost"), "tokens",
            F.when(F.sum("nanos").over(whole) > 0, F.coalesce("nanos", F.lit(0)).cast("double") / F.sum("nanos").over(whole).cast("double")).otherwise(0.0).alias("cost_share"),
            (F.col("tokens") / F.sum("tokens").over(whole)).alias("token_share"),
            F.row_number().over(W.orderBy(F.desc_nulls_last("nanos"), F.desc("tokens"), "model_key")).alias("cost_rank"),
            F.row_number().over(W.orderBy(F.desc("tokens"), "model_key")).alias("token_rank"),
        )
        return out.where((F.col("cost_rank") <= n) | (F.col("token_rank") <= n)).orderBy("cost_rank")

    def model_users(self, span: Range | None = None) -> DataFrame:
        """Per model and tier its accounts with cost and tokens, largest first, from one aggregation."""
        sums = self.within(span).groupBy("model_key", "tier", "acct").agg(F.coalesce(F.sum("nanos"), F.lit(0)).alias("nanos"), F.sum(tokens()).alias("tokens"))
        user = F.struct((-F.col("nanos")).alias("o"), (-F.col("tokens")).alias("p"), F.col("acct").alias("acct"))
        listed = F.transform(F.array_sort(F.collect_list(user)), lambda u: F.concat(u["acct"].cast("string"), F.lit(":"), (-u["p"]).cast("string")))
        return sums.groupBy("model_key", "tier").agg(F.array_join(listed, ",").alias("users")).orderBy("model_key", "tier")

    def sparklines(self, span: Range) -> DataFrame:
        """Per account its costs and tokens day by day, as arrays over the whole calendar of the range."""
        slices = calendar_slices(span, "day", self.zone)
        sums = self.within(span).withColumn("day", local_day(self.zone)).groupBy("acct", "day").agg(F.sum("nanos").alias("nanos"), F.sum(tokens()).alias("tokens"))
        days = spine(self.spark, [s for _, s in slices], [d for d, _ in slices]).select("slot", "day")
        seen = sums.join(F.broadcast(days), "day")
        filled = lambda c: F.transform(F.sequence(F.lit(0), F.lit(len(slices) - 1)), lambda i: F.coalesce(F.element_at(F.col(c), i), F.lit(0).cast("decimal(38,0)")))
        maps = seen.groupBy("acct").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.coalesce("nanos", F.lit(0)).cast("decimal(38,0)")))).alias("_n"), F.map_from_entries(F.collect_list(F.struct("slot", F.col("tokens").cast("decimal(38,0)")))).alias("_t"))
        out = self.selected().join(maps, F.col("id") == F.col("acct"), "left").withColumns({c: F.coalesce(c, F.create_map().cast("map<int,decimal(38,0)>")) for c in ("_n", "_t")})
        return out.select("id", F.array_join(F.transform(filled("_n"), lambda x: F.floor(x.cast("double") / 1e7 + 0.5).cast("string")), ",").alias("cents"), F.array_join(F.transform(filled("_t"), lambda x: x.cast("long").cast("string")), ",").alias("tokens")).orderBy("id")

    def baseline(self, now: int, span: Range, days: int = 30) -> DataFrame:
        """The daily average before today (at most `days`, fewer since first use) and the range's cost as a multiple of it."""
        today = self.zone.start_of(self.zone.date_at(now))
        seen = self.extent()
        start = max(self.zone.start_of(self.zone.date_at(today - days * 24 * HOUR)), self.zone.start_of(self.zone.date_at(seen[0])) if seen else today)
        n = max(0, round((today - start) / (24 * HOUR)))
        length = max(1, len(calendar_slices(span, "day", self.zone)))
        costs = self.spend({"before": Range(start, today), "cost": span})
        daily = F.col("before") / F.lit(float(n)) if n else F.lit(0.0)
        return costs.select("cost", F.lit(n).alias("days"), daily.alias("daily"), F.when(daily > 0, F.col("cost") / (daily * length)).alias("ratio"))

    def heat(self, span: Range) -> DataFrame:
        """Days with a level: 0 for none, else 1 to 4 by quarter of the most."""
        days = self.by_calendar(span, "day").select("day", "tokens")
        most = F.max("tokens").over(W.partitionBy())
        return days.select("day", "tokens", F.when(F.col("tokens") <= 0, 0).otherwise(F.least(F.lit(3), F.floor(F.col("tokens") / most * 4)) + 1).cast("int").alias("level")).orderBy("day")

    def rebucketed(self, span: Range, n: int, width: int) -> DataFrame:
        """An activity series summed over neighbours, by the smallest divisor of n that makes it fit the width."""
        group = next(g for g in range(1, n + 1) if n % g == 0 and n // g <= width)
        return self.activity(span, n).groupBy(F.floor(F.col("slot") / group).cast("int").alias("slot")).agg(F.sum("tokens").alias("tokens")).orderBy("slot")

    def price_changes(self, span: Range) -> DataFrame:
        """Changes of a model's card inside the range: old and new rates, by lag over its intervals."""
        own = W.partitionBy("model_key", "tier").orderBy("from_ms")
        out = self.rates.select("model_key", "tier", "from_ms", "input", "output", F.lag("input").over(own).alias("old_input"), F.lag("output").over(own).alias("old_output"), F.lag("from_ms").over(own).alias("_prior"))
        return out.where(F.col("_prior").isNotNull() & (F.col("from_ms") > span.start) & (F.col("from_ms") < span.end) & ~(F.col("input").eqNullSafe(F.col("old_input")) & F.col("output").eqNullSafe(F.col("old_output")))).drop("_prior").orderBy("model_key", "tier", "from_ms")

    def totals_and_groups(self, span: Range | None, by: str) -> DataFrame:
        """The total and the groups of a document in one aggregation, by grouping sets."""
        rows = self.within(span)
        out = rows.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping(by).cast("int").alias("is_total"), *measures())
        return out.select(F.col(by).alias("group"), "is_total", *shown()).orderBy(F.desc("is_total"), "group")

