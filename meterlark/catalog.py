"""Every registered query of the metering engine with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.operators import merge, pricing, rollup
from meterlark.plans.periods import Range, Zone, equal_buckets
from meterlark.plans.usage import UsageQueries
from meterlark.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ZONE = "America/Toronto"
#: 1998-03-01 to 1998-07-01 UTC, a range of whole days with a clock change in it.
SPAN = Range(888_710_400_000, 899_251_200_000)
#: A range whose ends are inside hours.
ODD = Range(888_710_400_000 + 1_234_567, 899_251_200_000 - 7_654_321)
NOW = 899_251_200_000


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merged(merge.storable(T.usage_rows(spark, sf_dir)))


def q(spark: SparkSession, sf_dir: str) -> UsageQueries:
    return UsageQueries(usage(spark, sf_dir), T.accounts(spark), T.rates(spark), Zone(ZONE))


PRICED = "with " + T.priced_sql()
IN = f"ts >= {SPAN.start} and ts < {SPAN.end}"
M = T.MEASURES_SQL
#: Local date of ts in ZONE from the instants at which its offset changes.
DAY_SQL = "cast(timezone('America/Toronto', to_timestamp(ts / 1000)) as date)"


@query(f"{PRICED} select {M} from priced")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).totals()


@query(f"{PRICED} select {M} from priced where {IN}")
def totals_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).totals(SPAN)


@query(f"{PRICED}, {T.ACCOUNTS_SQL} select {M} from priced where acct in (select id from accounts where provider = 'codex')")
def totals_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = q(spark, sf_dir)
    return UsageQueries(base.usage, base.accounts, base.rates, base.zone, provider="codex").totals()


@query(f"{PRICED} select {M} from priced where acct = 3")
def totals_named_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).named("ACCOUNT 3").totals()


SHARED = "case when sum(sum(nanos)) over () > 0 then coalesce(sum(nanos), 0)::double / (sum(sum(nanos)) over ())::double else 0::double end as share"


@query(f"""{PRICED}, grouped as (select model_key, tier, {M}, {SHARED} from priced group by model_key, tier)
select g.*, r.input as rate_input, r.output as rate_output, coalesce(r.cache_read, r.input * 0.1::double) as rate_cache_read, coalesce(r.cache_write, r.input * 1.25::double) as rate_cache_write
from grouped g left join rates r on g.model_key = r.model_key and g.tier = r.rtier and r.from_ms <= {NOW} and r.to_ms > {NOW}""")
def by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).by_model(now=NOW)


@query(f"{PRICED} select model_key, tier, {M}, {SHARED} from priced where model_key like '%el-2%' group by model_key, tier")
def by_model_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).by_model(match="EL-2")


@query(f"""{PRICED}, {T.ACCOUNTS_SQL} select id, provider, label, {M}, {SHARED} from accounts left join (select * from priced where {IN} and acct <> 5) p on p.acct = id group by id, provider, label""")
def by_account_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = q(spark, sf_dir)
    return UsageQueries(base.usage.where("acct <> 5"), base.accounts, base.rates, base.zone).by_account(SPAN)


def calendar_sql(unit: str) -> str:
    from meterlark.plans.periods import calendar_slices

    rows = ", ".join(f"(date '{d}', {s.start}::bigint, {s.end}::bigint)" for d, s in calendar_slices(ODD, unit, Zone(ZONE)))
    return f"""{PRICED}, days(day, lo, hi) as (values {rows}),
slotted as (select d.day, d.lo, d.hi, p.* from days d left join priced p on p.ts >= d.lo and p.ts < d.hi),
models as (select day, model_key, coalesce(sum(nanos), 0) as n, sum(tokens) as t from slotted where key is not null group by day, model_key),
best as (select day, model_key as top_model from models qualify row_number() over (partition by day order by n desc, t desc, model_key) = 1)
select s.day, s.lo, s.hi, {M}, any_value(b.top_model) as top_model from slotted s left join best b on s.day = b.day group by s.day, s.lo, s.hi"""


@query(calendar_sql("day"))
def by_day_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).by_calendar(ODD, "day")


@query(calendar_sql("week"))
def by_week_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).by_calendar(ODD, "week")


@query(calendar_sql("month"))
def by_month_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).by_calendar(ODD, "month")


def activity_sql(n: int) -> str:
    rows = ", ".join(f"({i}, {s.start}::bigint, {s.end}::bigint)" for i, s in enumerate(equal_buckets(ODD, n)))
    return f"""{PRICED}, slots(slot, lo, hi) as (values {rows})
select slot, lo, hi, coalesce(sum(tokens), 0)::bigint as tokens, floor(coalesce(sum(nanos), 0)::double / 1e9::double * 1e6::double + 0.5::double) / 1e6::double as cost from slots left join priced on ts >= lo and ts < hi group by slot, lo, hi"""


@query(activity_sql(72))
def activity_72(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).activity(ODD, 72)


@query(f"""{PRICED}, {T.ACCOUNTS_SQL} select id, coalesce(sum(tokens), 0)::double * (60::double / 4320) as tokens_per_hour, floor(coalesce(sum(nanos), 0)::double / 1e9::double * 1e6::double + 0.5::double) / 1e6::double * (60::double / 4320) as cost_per_hour
from accounts left join (select * from priced where ts >= {NOW} - 4320 * 60000 and ts < {NOW} + 1) p on acct = id group by id""")
def pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).pace(NOW, 4320)


@query(f"with {T.USAGE_SQL}, {T.ACCOUNTS_SQL} select id, label, min(ts) as first_seen, max(ts) as last_seen from accounts left join usage on acct = id group by id, label")
def first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).accounts_seen()


@query(f"{PRICED} select model_key, min(ts) as first_seen from priced group by model_key")
def models_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).models_first_seen()


@query(f"{PRICED} select model_key, tier, price_status as reason, sum(tokens)::bigint as tokens from priced where price_status <> 'priced' group by all having sum(tokens) > 0")
def unpriced_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).unpriced()


SPANS = {"day": Range(NOW - 86_400_000, NOW + 1), "week": Range(NOW - 7 * 86_400_000, NOW + 1), "month": Range(NOW - 30 * 86_400_000, NOW + 1), "everything": None}


@query(f"{PRICED} select " + ", ".join(f"floor(coalesce(sum(nanos){f' filter (ts >= {s.start} and ts < {s.end})' if s else ''}, 0)::double / 1e9::double * 1e6::double + 0.5::double) / 1e6::double as {k}" for k, s in SPANS.items()) + " from priced")
def multi_period_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).spend(SPANS)


@query(f"""{PRICED}, sums as (select model_key, sum(nanos) as n, sum(tokens)::bigint as tokens from priced group by model_key),
ranked as (select model_key, floor(coalesce(n, 0)::double / 1e9::double * 1e6::double + 0.5::double) / 1e6::double as cost, tokens, coalesce(n, 0)::double / (sum(n) over ())::double as cost_share, tokens::double / (sum(tokens) over ())::double as token_share,
  row_number() over (order by n desc nulls last, tokens desc, model_key)::int as cost_rank, row_number() over (order by tokens desc, model_key)::int as token_rank from sums)
select * from ranked where cost_rank <= 5 or token_rank <= 5""")
def top_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).top_models()


@query(f"""{PRICED}, sums as (select model_key, tier, acct, coalesce(sum(nanos), 0) as n, sum(tokens)::bigint as t from priced group by all)
select model_key, tier, string_agg(acct || ':' || t, ',' order by n desc, t desc, acct) as users from sums group by model_key, tier""")
def model_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).model_users()


def sparkline_sql() -> str:
    from meterlark.plans.periods import calendar_slices

    span = Range(NOW - 30 * 86_400_000, NOW)
    rows = ", ".join(f"({i}, {s.start}::bigint, {s.end}::bigint)" for i, (_, s) in enumerate(calendar_slices(span, "day", Zone(ZONE))))
    return f"""{PRICED}, {T.ACCOUNTS_SQL}, days(slot, lo, hi) as (values {rows}),
cells as (select id, slot, coalesce(sum(nanos), 0) as n, coalesce(sum(tokens), 0) as t from accounts cross join days left join priced on acct = id and ts >= lo and ts < hi group by id, slot)
select id, string_agg(floor(n::double / 1e7::double + 0.5::double)::bigint::varchar, ',' order by slot) as cents, string_agg(t::bigint::varchar, ',' order by slot) as tokens from cells group by id"""


@query(sparkline_sql())
def sparkline_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).sparklines(Range(NOW - 30 * 86_400_000, NOW))


def baseline_sql() -> str:
    zone = Zone(ZONE)
    today = zone.start_of(zone.date_at(NOW))
    start = zone.start_of(zone.date_at(today - 30 * 86_400_000))
    n = round((today - start) / 86_400_000)
    return f"""{PRICED}, c as (select floor(coalesce(sum(nanos) filter (ts >= {start} and ts < {today}), 0)::double / 1e9::double * 1e6::double + 0.5::double) / 1e6::double as before,
  floor(coalesce(sum(nanos) filter ({IN}), 0)::double / 1e9::double * 1e6::double + 0.5::double) / 1e6::double as cost from priced)
select cost, {n} as days, before / {n}::double as daily, case when before > 0 then cost / (before / {n}::double * {len(__import__('meterlark.plans.periods', fromlist=['x']).calendar_slices(SPAN, 'day', zone))}) end as ratio from c"""


@query(baseline_sql())
def baseline_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).baseline(NOW, SPAN)


@query(calendar_sql("day").replace("select s.day, s.lo", "select day, tokens, (case when tokens <= 0 then 0 else least(3, floor(tokens::double / (max(tokens) over ())::double * 4::double)) + 1 end)::int as level from (select s.day, s.lo") + ")")
def heat_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).heat(ODD)


@query(f"select slot // 4 as slot, sum(tokens)::bigint as tokens from ({activity_sql(72)}) group by 1")
def activity_rebucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).rebucketed(ODD, 72, 18)


@query(f"""{PRICED}, lagged as (select model_key, rtier::int as tier, from_ms, input, output, lag(input) over w as old_input, lag(output) over w as old_output, lag(from_ms) over w as prior from rates window w as (partition by model_key, rtier order by from_ms))
select l.model_key, l.tier, from_ms, input, output, old_input, old_output, count(key) filter (ts >= from_ms) as records_since, count(key) filter (ts < from_ms) as records_before from lagged l left join (select key, ts, model_key, tier from priced) p on p.model_key = l.model_key and p.tier = l.tier
where prior is not null and (input is distinct from old_input or output is distinct from old_output) group by l.model_key, l.tier, from_ms, input, output, old_input, old_output""")
def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price changes, with the rows of their model and tier before and since."""
    base = q(spark, sf_dir)
    changes, rows = base.price_changes(Range(1, 2**52)), base.within(None).select("key", "ts", F.col("model_key").alias("_model"), F.col("tier").alias("_tier"))
    both = changes.join(rows, (F.col("model_key") == F.col("_model")) & (F.col("tier") == F.col("_tier")), "left")
    count = lambda when: F.count(F.when(when, F.col("key")))
    return both.groupBy(*changes.columns).agg(count(F.col("ts") >= F.col("from_ms")).alias("records_since"), count(F.col("ts") < F.col("from_ms")).alias("records_before"))


@query(f'{PRICED} select model_key as "group", grouping(model_key)::int as is_total, {M} from priced group by grouping sets ((model_key), ())')
def grouping_sets_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q(spark, sf_dir).totals_and_groups(None, "model_key")


@query(f"{PRICED} select key, acct, ts, model_key, tier, tokens, price_status, nanos::double as nanos from priced where is_long")
def long_context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q(spark, sf_dir).within(None).where("is_long")
    return rows.select("key", "acct", "ts", "model_key", "tier", (F.col("inp") + F.col("outp") + F.col("cr") + F.col("cc")).alias("tokens"), "price_status", F.col("nanos").cast("double").alias("nanos"))


@query(f"{PRICED} select key, model, model_key, tier, price_status, is_estimated, nanos::double as nanos from priced")
def rate_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.priced(usage(spark, sf_dir), T.rates(spark)).select("key", "model", "model_key", "tier", "price_status", "is_estimated", F.col("nanos").cast("double").alias("nanos"))


# --- merging --------------------------------------------------------------------------------------------------------


@query(f"with {T.USAGE_SQL} select * from usage")
def max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir)


ROLLUP_SQL = f"""with {T.USAGE_SQL}, rollup_ as (select ts // 3600000 as hour, acct, model, tier, sum(inp)::bigint as inp, sum(outp)::bigint as outp, sum(cr)::bigint as cr, sum(cc)::bigint as cc, coalesce(sum(e5), 0)::bigint as e5, coalesce(sum(e1), 0)::bigint as e1,
  sum(case when e5 is null and e1 is null then cc else 0 end)::bigint as ccx, count(*) as n from usage group by 1, 2, 3, 4)"""


@query(f"{ROLLUP_SQL} select * from rollup_")
def rollup_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.built(usage(spark, sf_dir))


@query(f"{ROLLUP_SQL} select * from rollup_")
def rollup_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of rows before a change, then kept up by the change: equal to a rebuild."""
    rows = merge.storable(T.usage_rows(spark, sf_dir))
    before = merge.merged(rows.where("acct < 6"))
    after = merge.merged(rows)
    touched = rows.where("acct >= 6").select("key").distinct()
    return rollup.maintained(rollup.built(before), before.join(touched, "key", "left_semi"), after.join(touched, "key", "left_semi"))


@query(f"""{ROLLUP_SQL} select 'stored' as side, hour, acct from rollup_ where hour % 5 = 0 and hour % 7 <> 0 union all select 'rebuilt', hour, acct from rollup_ where hour % 5 = 0 or hour % 7 = 0""")
def rollup_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup that lacks every seventh hour and counts one token too many in every fifth: these buckets are told, and no others."""
    rows = usage(spark, sf_dir)
    spoilt = rollup.built(rows).where("hour % 7 != 0").withColumn("inp", F.when(F.col("hour") % 5 == 0, F.col("inp") + 1).otherwise(F.col("inp")))
    return rollup.drift(spoilt, rows).select("side", "hour", "acct")


@query(f"with {T.USAGE_SQL}, c as (select count(*) as rows, count(*) filter (ts // 3600000 % 7 <> 0) as counted from usage) select rows, counted, rows = counted as agree from c")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a store against those that a rollup without every seventh hour counts."""
    rows = usage(spark, sf_dir)
    return rollup.counts_agree(rollup.built(rows).where("hour % 7 != 0"), rows)


@query(f"{PRICED} select model_key, tier, sum(inp)::bigint as input, sum(outp)::bigint as output, sum(cr)::bigint as cache_read, sum(cc)::bigint as cache_write, count(*)::bigint as records, round(coalesce(sum(nanos), 0)::double / 1e9::double, 2) as cost from priced where ts >= {ODD.start} and ts < {ODD.end} group by model_key, tier")
def rollup_repriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By model from the rollup: whole hours by their sums, edges, price changes and long rows from rows."""
    rows = usage(spark, sf_dir)
    out = rollup.repriced(rows, rollup.built(rows), T.rates(spark), ODD.start, ODD.end)
    return out.select("model_key", "tier", F.col("inp").alias("input"), F.col("outp").alias("output"), F.col("cr").alias("cache_read"), F.col("cc").alias("cache_write"), "records", F.round(F.col("nanos").cast("double") / F.lit(1e9), 2).alias("cost"))


from meterlark import catalog_ingest, catalog_kept, catalog_limits, catalog_stores, catalog_told  # noqa: E402, F401  register their queries
