"""Registered queries over what is shown: documents, boards, told times, periods and the life of alerts."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark import catalog
from meterlark.catalog import NOW, PRICED, SPAN, ZONE, M, q, query, usage
from meterlark.catalog_limits import ALERTS_SQL, AT, CURRENT, WINDOWS, alert_rows, current
from meterlark.functions import limits
from meterlark.operators import alerts
from meterlark.operators import windows as W
from meterlark.plans import documents, views
from meterlark.plans.periods import Zone, resolve_period
from meterlark.plans.usage import local_day
from meterlark.sources import tables as T
from meterlark.sources.local import local_table

# --- documents -----------------------------------------------------------------------------------------------------------

DOCUMENT = "query string, grouped string, label string, tokens long, cost double, records long, status string"


def told(name: str, grouped: str | None, rows: list[tuple[str, dict]]) -> list[tuple]:
    return [(name, grouped, label, r["tokens"]["total"], float(r["cost"]), r["records"], r["status"]) for label, r in rows]


def group_label(g: dict) -> str:
    return f"{g['model']}/{g['tier']}" if "model" in g else g["account"]["label"] if "account" in g else g["key"]


@query(f"""{PRICED}, {T.ACCOUNTS_SQL}, p as (select *, {catalog.DAY_SQL} as day from priced where ts >= {SPAN.start} and ts < {SPAN.end}),
days as (select day::date as day from (select unnest(generate_series(date '1998-03-01', date '1998-07-01', interval 1 day)) as day)),
parts as (
  select 'usage' as query, null as grouped, 'total' as label, {M} from p
  union all select 'usage', 'model', model_key || case when tier = 1 then '/fast' else '/standard' end, {M} from p group by model_key, tier
  union all select 'models', null, model_key || case when tier = 1 then '/fast' else '/standard' end, {M} from p group by model_key, tier
  union all select 'accounts', null, label, {M} from accounts left join p on acct = id group by label
  union all select 'usage', 'account', label, {M} from accounts left join p on acct = id group by label
  union all select 'usage', 'day', strftime(d.day, '%Y-%m-%d'), {M} from (select * from days where day between timezone('America/Toronto', to_timestamp({SPAN.start} / 1000))::date and timezone('America/Toronto', to_timestamp(({SPAN.end} - 1) / 1000))::date
    union select timezone('America/Toronto', to_timestamp({SPAN.start} / 1000))::date) d left join p on p.day = d.day group by d.day
  union all select 'usage', 'month', strftime(m.day, '%Y-%m'), {M} from (select distinct date_trunc('month', day)::date as day from (select day from days where day between timezone('America/Toronto', to_timestamp({SPAN.start} / 1000))::date and timezone('America/Toronto', to_timestamp(({SPAN.end} - 1) / 1000))::date
    union select timezone('America/Toronto', to_timestamp({SPAN.start} / 1000))::date)) m left join p on date_trunc('month', p.day) = m.day group by m.day)
select query, grouped, label, tokens, cost, records, status from parts""")
def usage_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that six requests ask for, as parsed from arguments: their totals and groups as rows."""
    stored = usage(spark, sf_dir).persist()  # asked some thirty times
    base, rows = replace(q(spark, sf_dir), usage=stored), []
    iso = base.zone.iso
    span = ["--since", iso(SPAN.start), "--until", iso(SPAN.end)]
    for args in (["usage"], ["usage", "--group-by", "model"], ["usage", "--group-by", "account"], ["usage", "--group-by", "day"], ["usage", "--group-by", "month"], ["models"], ["accounts"]):
        d = documents.document(base, documents.parse([*args, *span]), NOW)
        groups = d.get("groups") or d.get("models") or d.get("accounts") or []
        if args == ["usage"]:
            rows += told("usage", None, [("total", d["totals"])])
        rows += told(args[0], d.get("group_by"), [(group_label(g), g) for g in groups])
    stored.unpersist()
    return local_table(spark, rows, DOCUMENT)


@query(f"""{PRICED}, p as (select * from priced where ts >= {SPAN.start} and ts < {SPAN.end}), first_ as (select mkey as model_key, min(ts) as first_seen from keyed group by mkey),
per as (select model_key, tier, acct, coalesce(sum(nanos), 0) as n, sum(tokens) as t from p group by all),
users as (select model_key, tier, string_agg(acct || ':' || t, ',' order by n desc, t desc, acct) as users from per group by model_key, tier),
g as (select model_key, tier, {M} from p group by model_key, tier)
select g.model_key, g.tier, g.model_key as name, tokens, cost, status, users, first_seen, case when status = 'unpriced' then 'unpriced' when status = 'partial' then '*' when est_tokens > 0 then '≈' else '' end as mark
from g join users using (model_key, tier) join first_ using (model_key)""")
def rate_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board of models: use, users, first use, name and mark."""
    return views.rate_board(q(spark, sf_dir), SPAN, NOW).select("model_key", "tier", "name", "tokens", "cost", "status", "users", "first_seen", "mark")


@query(f"""{PRICED}, {T.ACCOUNTS_SQL}, s as (select acct, min(ts) as first_seen, max(ts) as last_seen from usage group by acct), g as (select id, label, {M} from accounts left join (select * from priced where ts >= {SPAN.start} and ts < {SPAN.end}) p on acct = id group by id, label)
select row_number() over (order by coalesce({NOW} - last_seen > 2592000000, true), cost desc, tokens desc, id)::int as place, id, g.label, tokens, cost, first_seen, last_seen, coalesce({NOW} - last_seen > 2592000000, true) as away from g left join s on acct = id""")
def account_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts in the order of their view: those in use first, then by cost, tokens and id."""
    from pyspark.sql import Window

    rows = views.account_rows(q(spark, sf_dir), SPAN, NOW)
    place = F.row_number().over(Window.orderBy("away", F.desc("cost"), F.desc("tokens"), "id"))
    return rows.select(place.alias("place"), "id", "label", "tokens", "cost", "first_seen", "last_seen", "away")


@query(f"""{PRICED}, g as (select acct % 3 as part, acct, {M} from priced group by acct), days as (select {catalog.DAY_SQL} as day, sum(tokens)::bigint as tokens from priced where ts >= {SPAN.start} and ts < {SPAN.end} group by 1)
select 'part ' || part as name, sum(tokens)::bigint as tokens, round(sum(priced_tokens)::double / sum(tokens)::double, 9) as value from g group by part
union all select 'day ' || day, tokens, case when tokens <= 0 then 0 else least(7, ceil(tokens / (max(tokens) over ()) * 7)) end::double from days""")
def merged_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups merged with their priced share weighted by tokens; days as levels of a sparkline."""
    base = q(spark, sf_dir)
    groups = views.merged_shares(base.by_account().where("records > 0").withColumn("part", F.col("id") % 3), "part")
    days = base.by_calendar(SPAN, "day").where("records > 0").select("day", "tokens", views.spark_level(F.col("tokens")).cast("double").alias("value"))
    return groups.select(F.concat(F.lit("part "), "part").alias("name"), "tokens", F.round("priced_share", 9).alias("value")).unionByName(days.select(F.concat(F.lit("day "), F.col("day").cast("string")).alias("name"), "tokens", "value"))


# --- periods and told times ------------------------------------------------------------------------------------------------


@query("""with nows as (select unnest(generate_series(0, 399, 9)) as k), n as (select 888710400000 + k * 86400000 + k * 3333333 as now from nows), l as (select now, timezone('America/Toronto', to_timestamp(now / 1000))::date as d from n),
p as (select now, 'today' as name, d as a, d + 1 as b from l union all select now, 'this_week', date_trunc('week', d)::date, date_trunc('week', d)::date + 7 from l union all select now, 'this_month', date_trunc('month', d)::date, (date_trunc('month', d) + interval 1 month)::date from l)
select now, name, epoch_ms(timezone('America/Toronto', a::timestamp)) as lo, epoch_ms(timezone('America/Toronto', b::timestamp)) as hi from p
union all select now, name, now - ms, now + 1 from n, (values ('1h', 3600000), ('5h', 18000000), ('24h', 86400000)) r(name, ms)""")
def periods_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar and rolling periods at many instants of a year, clock changes among them."""
    zone = Zone(ZONE)
    nows = [888_710_400_000 + k * 86_400_000 + k * 3_333_333 for k in range(0, 400, 9)]
    names = ("today", "this_week", "this_month", "1h", "5h", "24h")
    rows = [(now, name, (s := resolve_period(name, now, zone)).start, s.end) for now in nows for name in names]
    return local_table(spark, rows, "now long, name string, lo long, hi long")


@query(f"""with {T.USAGE_EVENTS_SQL}, days as (select unnest(generate_series(date '2023-12-25', date '2025-01-07', interval 1 day))::date as day)
select day, date_trunc('week', day)::date as week, date_trunc('month', day)::date as month, epoch_ms(timezone('America/Toronto', day::timestamp)) as starts, epoch_ms(timezone('America/Toronto', (day + 1)::timestamp)) - epoch_ms(timezone('America/Toronto', day::timestamp)) as length, (select count(*) from usage where timezone('America/Toronto', to_timestamp(ts / 1000))::date = day) as records from days""")
def days_of_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's days with their week, month, first instant, length and rows."""
    from meterlark.plans.periods import unit_start

    zone, days = Zone(ZONE), [date(2023, 12, 25) + timedelta(days=i) for i in range(380)]
    rows = [(d, unit_start(d, "week"), unit_start(d, "month"), zone.start_of(d), zone.start_of(d + timedelta(days=1)) - zone.start_of(d)) for d in days]
    days = local_table(spark, rows, "day date, week date, month date, starts long, length long")
    records = T.usage_events(spark, sf_dir).groupBy(local_day(zone).alias("day")).agg(F.count(F.lit(1)).alias("_n"))
    return days.join(records, "day", "left").withColumn("records", F.coalesce("_n", F.lit(0).cast("long"))).drop("_n")


STEPS_SQL = " ".join(f"when left_ <= {m * 60_000} then '{name}'" for m, name in limits.STEPS)


@query(f"""{WINDOWS}, w as (select identity, seq, kind, utilization, resets_at, resets_at - at_ms as left_, at_ms, greatest(0, floor((resets_at - at_ms) / 1000::double + 0.5::double)::bigint) as s from windows),
x as (select *, floor(s / 60::double + 0.5::double)::bigint as m from w), y as (select *, m // 60 as h from x)
select identity, seq, kind, floor(utilization * 100 + 0.5::double)::bigint || '%' as share,
  case when s < 60 then s || 's' when s < 600 then s // 60 || 'm' || case when s % 60 = 0 then '' else ' ' || s % 60 || 's' end when m < 60 then m || 'm' when h < 24 then h || 'h' || case when m % 60 = 0 then '' else ' ' || m % 60 || 'm' end else h // 24 || 'd' || case when h % 24 = 0 then '' else ' ' || h % 24 || 'h' end end as lasts,
  case when s < 60 then s || 's' when m < 60 then m || 'm' when h < 24 then h || 'h' || case when m % 60 = 0 then '' else m % 60 || 'm' end else h // 24 || 'd' || case when h % 24 = 0 then '' else h % 24 || 'h' end end as short,
  strftime(timezone('America/Toronto', to_timestamp(resets_at // 1000)), '%H:%M') as at_hour from y""")
def told_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares, durations (two ways) and clock times of windows as they are told."""
    rows = W.windows(T.captures(spark, sf_dir).where("identity is not null"), "seq")
    left = F.col("resets_at") - F.col("at")
    return rows.select("identity", "seq", "kind", limits.percent(F.col("utilization")).alias("share"), limits.duration(left).alias("lasts"), limits.compact(left).alias("short"), F.date_format(limits.local(F.col("resets_at"), ZONE), "HH:mm").alias("at_hour"))


@query(f"""{WINDOWS}, {CURRENT}, c as (select identity, kind, resets_at, resets_at - {AT} as left_ from current_)
select identity, kind, case when left_ < 60000 then 'now' {STEPS_SQL} else '~' || ceil(left_ / 86400000::double)::bigint || 'd' end as countdown,
  case when timezone('America/Toronto', to_timestamp(resets_at / 1000))::date = timezone('America/Toronto', to_timestamp({AT} / 1000))::date then '' else strftime(timezone('America/Toronto', to_timestamp(resets_at / 1000)), '%b %-d') || ' ' end || strftime(timezone('America/Toronto', to_timestamp(resets_at / 1000)), '%H:%M') as clock from c""")
def told_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countdowns to resets and their local times, with the date where it isn't today's."""
    return current(spark, sf_dir).select("identity", "kind", limits.countdown(F.col("resets_at"), AT).alias("countdown"), limits.clock(F.col("resets_at"), AT, ZONE).alias("clock"))


# --- the life of alerts ------------------------------------------------------------------------------------------------------

WATCHED_SQL = f"""{WINDOWS}, {CURRENT}, {ALERTS_SQL}, each as (select a.alert_id, a.win, a.threshold, unnest(a.members) as identity from alerts a),
latest as (select alert_id, max({{'at_ms': at_ms, 'identity': c.identity}}) as n from each join current_ c using (identity) group by alert_id),
watched as (select e.alert_id, e.threshold, c.* from each e join latest l using (alert_id) join current_ c on c.identity = e.identity where c.identity = l.n.identity
  and case e.win when 'any' then true when '5h' then c.scope is null and minutes = 300 when 'weekly' then c.scope is null and minutes = 10080 else c.scope is not null and minutes = 10080 end),
done as (select alert_id, kind, case when alert_id % 2 = 0 then resets_at - 300000 else resets_at - 1200000 end as resets_at, {AT} - alert_id * 1000 as at_ms, alert_id = 4 as on_set from watched where alert_id <> 3),
states as (select w.*, (select min(d.at_ms) from done d where d.alert_id = w.alert_id and d.kind = w.kind and abs(d.resets_at - w.resets_at) < 900000 and w.resets_at > {AT}) as fired_at from watched w)"""


def watched_now(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alerts, current windows, deliveries): those of odd alerts are of another instance, alert 3 has none."""
    now = current(spark, sf_dir).withColumn("window_s", F.col("minutes") * 60)
    none = spark.createDataFrame([], "alert_id int, kind string, resets_at long, at long, on_set boolean")
    rows = alerts.watched(alert_rows(spark), now, none, AT).where("alert_id != 3")
    a = F.col("alert_id")
    done = rows.select("alert_id", "kind", (F.col("resets_at") - F.when(a % 2 == 0, 300_000).otherwise(1_200_000)).alias("resets_at"), (F.lit(AT) - a * 1000).cast("long").alias("at"), (a == 4).alias("on_set"))
    return alert_rows(spark), now, done


@query(f"{WATCHED_SQL} select a.alert_id, case when bool_and(fired_at is not null) filter (kind is not null) then 'fired' else 'armed' end as status, case when bool_and(fired_at is not null) filter (kind is not null) then max(fired_at) end as fired_at from alerts a left join states s on s.alert_id = a.alert_id group by a.alert_id")
def alert_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.statuses(*watched_now(spark, sf_dir), AT)


@query(f"{WATCHED_SQL} select 'on set' as what, alert_id, kind, resets_at as at_ms from states where fired_at is null and resets_at > {AT} and utilization * 100 >= threshold - 1e-9 union all select 'last', alert_id, null, max(at_ms) from done where not on_set group by alert_id")
def alert_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over the line as alerts are set, and when each alert last fired."""
    rules, now, done = watched_now(spark, sf_dir)
    over = alerts.set_over_line(rules, now, done, AT).select(F.lit("on set").alias("what"), "alert_id", "kind", F.col("resets_at").alias("at_ms"))
    return over.unionByName(alerts.last_fired(done).select(F.lit("last").alias("what"), "alert_id", F.lit(None).cast("string").alias("kind"), F.col("last_fired").alias("at_ms")))


@query(f"""{WATCHED_SQL}, left_ as (select alert_id from alerts where alert_id in (1, 3, 5) or alert_id = 6)
select 'alert' as what, alert_id, 0::bigint as n from left_ union all select 'delivery', alert_id, count(*) from done where resets_at + 900000 >= {AT} and alert_id in (select alert_id from left_) group by alert_id""")
def alerts_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts left after a quiet day of their sessions (even ones but 6 have been quiet), and the deliveries that may still count."""
    rules, _, done = watched_now(spark, sf_dir)
    rules = rules.withColumn("session", F.when(F.col("alert_id") % 2 == 0, F.concat(F.lit("s"), "alert_id"))).withColumn("created_at", F.lit(AT - 2 * 86_400_000).cast("long"))
    active = alerts.session_activity(local_table(spark, [("s6", AT - 1000), ("s2", AT - 86_400_001), (None, AT)], "session string, at long"), local_table(spark, [("s6", AT - 5000)], "session string, at long"))
    kept, due = alerts.pruned(rules, done, active, AT)
    return kept.select(F.lit("alert").alias("what"), "alert_id", F.lit(0).cast("long").alias("n")).unionByName(due.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("delivery").alias("what"), "alert_id", "n"))


@query(f"with {T.USAGE_SQL}, {T.ACCOUNTS_SQL}, seen as (select acct, min(ts) as first_seen, max(ts) as last_seen, count(*) as n from usage where acct in (select id from accounts where provider = 'codex' and label in ('Account 1', 'Account 3')) group by acct) select acct, first_seen, last_seen, n from seen")
def rows_of_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a provider's accounts by label: pushed to the scan as a list of numbers."""
    ids = [r["id"] for r in T.accounts(spark).where("provider = 'codex' and label in ('Account 1', 'Account 3')").collect()]  # a few accounts of one user
    return usage(spark, sf_dir).where(F.col("acct").isin(ids)).groupBy("acct").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))
