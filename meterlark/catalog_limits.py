"""Registered queries over limit captures: windows, events, groups, forecasts, advice and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.catalog import query
from meterlark.operators import account_groups, alerts, limit_events, pricing
from meterlark.operators import windows as W
from meterlark.plans import forecasts
from meterlark.sources import tables as T
from meterlark.sources.local import local_table

#: 2024-01-20 12:00 UTC, inside the events.
AT = 1_705_752_000_000
WINDOWS = f"with {T.windows_sql()}"
GROUPS = ((0, "g1"), (2, "g1"), (1, "g2"), (3, "g2"), (5, "g2"))
GROUPS_SQL = "members as (select 'identity-' || i as identity, i as acct, g as grp from (values " + ", ".join(f"({i}, '{g}')" for i, g in GROUPS) + ") t(i, g))"

FIRST_SQL = """(select {keys}, label, resets_at, at_ms from (select *, sum(fresh) over (partition by {keys} order by resets_at rows unbounded preceding) as instance from (
  select *, case when resets_at - lag(resets_at) over (partition by {keys} order by resets_at) < 900000 then 0 else 1 end as fresh from (
    select {keys}, resets_at, f.at_ms as at_ms, f.label as label from (select {keys}, resets_at, min({{'at_ms': at_ms, 'label': label}}) as f from {source} group by {keys}, resets_at)))) qualify row_number() over (partition by {keys}, instance order by at_ms, resets_at) = 1)"""

EVENTS = f"""{WINDOWS}, live as (select *, kind as win from windows where at_ms < resets_at),
hits as (select identity, 'reached' as event, win, label, resets_at, at_ms from live where utilization >= 1 union all select identity, 'passed_80', win, label, resets_at, at_ms from live where utilization >= 0.8 and minutes = 10080),
found as (select identity, event, win, label, resets_at, at_ms from {FIRST_SQL.format(keys="identity, event, win", source="hits")}),
calm as (select identity, win, at_ms, min({{'resets_at': resets_at, 'label': label}}) as c from live where utilization < 1 group by identity, win, at_ms),
closed as (select f.*, (select min(c.at_ms) from calm c where c.identity = f.identity and c.win = f.win and c.at_ms >= f.resets_at) as resumed_at from found f where event = 'reached'),
closers as (select distinct k.identity, k.win, c.c.resets_at as resets_at, c.c.label as label, c.at_ms from closed k join calm c on c.identity = k.identity and c.win = k.win and c.at_ms = k.resumed_at),
resumes as (select * from {FIRST_SQL.format(keys="identity, win", source="closers")}),
limit_events as (select identity, event, win, label, resets_at, at_ms, resumed_at from closed union all select identity, event, win, label, resets_at, at_ms, null::bigint from found where event <> 'reached'
  union all select identity, 'resumed', win, label, resets_at, at_ms, null::bigint from resumes)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.windows(T.captures(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_events.detect(windows(spark, sf_dir))


def members(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(f"identity-{i}", i, g) for i, g in GROUPS], "identity string, acct int, group string")


@query(f"{WINDOWS} select identity, provider, at_ms, kind, label, utilization, resets_at, minutes, scope from windows")
def capture_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).drop("rank").withColumnRenamed("at", "at_ms")


@query(f"{EVENTS} select * from limit_events")
def limit_event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumnRenamed("window", "win").withColumnRenamed("at", "at_ms")


@query(f"""{EVENTS}, {GROUPS_SQL}, joined as (select e.*, m.grp from limit_events e left join members m using (identity)),
folded as (select grp, event, win, resets_at, min({{'at_ms': at_ms, 'identity': identity, 'label': label}}) as f, min(case when resumed_at is not null then {{'at_ms': at_ms, 'resumed_at': resumed_at}} end) as r from joined where grp is not null group by all),
numbered as (select *, sum(fresh) over (partition by grp, event, win order by resets_at rows unbounded preceding) as instance from (select *, case when resets_at - lag(resets_at) over (partition by grp, event, win order by resets_at) < 900000 then 0 else 1 end as fresh from folded)),
one as (select grp, event, win, instance, min({{'at_ms': f.at_ms, 'identity': f.identity, 'resets_at': resets_at, 'label': f.label}}) as e, min(r) as r from numbered group by grp, event, win, instance)
select identity, event, win, label, resets_at, at_ms, resumed_at from joined where grp is null union all select e.identity, event, win, e.label, e.resets_at, e.at_ms, r.resumed_at from one""")
def instance_dedupe_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_events.deduped(events(spark, sf_dir), members(spark).select("identity", "group")).withColumnRenamed("window", "win").withColumnRenamed("at", "at_ms")


@query(f"""{EVENTS} select * from limit_events e where not (event = 'resumed' and exists (select 1 from limit_events r where r.event = 'reached' and r.identity = e.identity and r.win = e.win and r.resumed_at = e.at_ms))""")
def events_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_events.listed(events(spark, sf_dir)).withColumnRenamed("window", "win").withColumnRenamed("at", "at_ms")


CURRENT = f"newest as (select identity, max(seq) as seq from (select identity, seq, at_ms from windows where at_ms <= {AT} qualify rank() over (partition by identity order by at_ms desc, seq) = 1) group by identity), current_ as (select w.* from windows w join newest n on w.identity = n.identity and w.seq = n.seq)"


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.windows(W.freshest(T.captures(spark, sf_dir).where(F.col("captured_at") * 1000 <= AT), "seq"))


@query(f"{WINDOWS}, {CURRENT} select identity, provider, at_ms, kind, utilization, resets_at from current_")
def freshest_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir).select("identity", "provider", F.col("at").alias("at_ms"), "kind", "utilization", "resets_at")


@query(f"""{EVENTS}, {CURRENT}, week as (select identity, kind as win, resets_at + case when resets_at <= {AT} then (({AT} - resets_at) // 604800000 + 1) else 0 end * 604800000 as r, case when resets_at > {AT} then utilization end as u from current_ where kind in ('weekly_all', 'codex_secondary')),
slots as (select *, r - k * 604800000 as slot from week cross join (select unnest(generate_series(0, 7)) as k))
select identity, slot as resets_at, case when k = 0 then u when full_ > 0 then 1.0::double when passed > 0 then 0.8::double end as value, case when k = 0 then 'now' when full_ > 0 then 'reached' when passed > 0 then 'passed_80' end as source
from (select s.identity, s.slot, s.k, any_value(s.u) as u, count(*) filter (e.event = 'reached') as full_, count(*) filter (e.event = 'passed_80') as passed from slots s left join limit_events e on e.identity = s.identity and e.win = s.win and abs(e.resets_at - s.slot) < 302400000 group by s.identity, s.slot, s.k)""")
def weekly_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_events.weekly_slots(current(spark, sf_dir), events(spark, sf_dir), AT)


@query(f"{WINDOWS} select identity, max(utilization) filter (resets_at > {AT}) as highest from windows group by identity")
def highest_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_events.highest(windows(spark, sf_dir), AT)


ROUND_SQL = f"""{WINDOWS}, rounds as (select at_ms // 600000 as round, * from windows), latest as (select round, identity, max(seq) as seq from (select distinct round, identity, seq, at_ms from rounds qualify rank() over (partition by round, identity order by at_ms desc, seq) = 1) group by round, identity),
w as (select r.* from rounds r join latest l on r.round = l.round and r.identity = l.identity and r.seq = l.seq)"""


@query(f"""{ROUND_SQL} select a.identity || '|' || b.identity as pair, a.at_ms as at_a, b.at_ms as at_b, count(*) as shared, bool_and(abs(a.resets_at - b.resets_at) <= 2000) as resets_agree, bool_and(a.utilization = b.utilization) as same_use, abs(a.at_ms - b.at_ms) <= 60000 as close
from w a join w b on a.round = b.round and a.provider = b.provider and a.kind = b.kind and a.identity < b.identity and abs(a.at_ms - b.at_ms) <= 600000 and least(a.resets_at, b.resets_at) > greatest(a.at_ms, b.at_ms) group by a.identity, b.identity, a.at_ms, b.at_ms""")
def pair_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparisons(spark, sf_dir).select("pair", "at_a", "at_b", "shared", "resets_agree", "same_use", "close")


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = T.captures(spark, sf_dir).withColumn("round", F.floor((F.col("captured_at") * 1000 + 0.5) / 600_000).cast("long"))
    own = W.windows(W.freshest(caps, "seq", "provider", "identity", "round")).withColumn("round", F.floor(F.col("at") / 600_000).cast("long"))
    return account_groups.compared(own)


#: The detector without steps: which comparisons count, where links begin and break among them, and sums between these times.
PAIR_SQL = f"""{ROUND_SQL}, compared as (select a.identity || '|' || b.identity as pair, a.at_ms as at_a, b.at_ms as at_b, bool_and(abs(a.resets_at - b.resets_at) <= 2000) as agreeing, bool_and(a.utilization = b.utilization) as equal_use,
  abs(a.at_ms - b.at_ms) <= 60000 as close, list({{'kind': a.kind, 'u': a.utilization, 'r': a.resets_at}} order by a.kind) as uses
  from w a join w b on a.round = b.round and a.provider = b.provider and a.kind = b.kind and a.identity < b.identity and abs(a.at_ms - b.at_ms) <= 600000 and least(a.resets_at, b.resets_at) > greatest(a.at_ms, b.at_ms) group by a.identity, b.identity, a.at_ms, b.at_ms),
later as (select * from compared where close or not agreeing qualify at_b > coalesce(max(at_b) over (partition by pair order by at_a, at_b rows between unbounded preceding and 1 preceding), -1)
  and at_a > coalesce(lag(at_a) over (partition by pair order by at_a, at_b), -1)),
decided as (select *, max(case when equal_use or not agreeing then at_a end) over (partition by pair order by at_a) as since from later),
verdicts as (select *, case when not agreeing then 'apart' when equal_use then 'same' when row_number() over (partition by pair, since, agreeing and not equal_use order by at_a) % 2 = 0 then 'apart' else 'open' end as verdict from decided),
neighbours as (select *, lag(verdict) over o as verdict0, lag(at_a) over o as at0, lag(uses) over o as uses0 from verdicts where verdict <> 'open' window o as (partition by pair order by at_a)),
marks as (select *, verdict = 'same' and coalesce(verdict0 = 'same' and at_a - at0 <= 660000, false) as follows, verdict = 'apart' and coalesce(verdict0 = 'apart', false) as breaks from neighbours),
changes as (select n.pair, n.at_a, n.at_b from (select pair, at_a, at_b, unnest(uses) as x from marks where follows) n join (select pair, at_a, unnest(uses0) as y from marks where follows) o
    on n.pair = o.pair and n.at_a = o.at_a and x.kind = y.kind and abs(x.r - y.r) < 900000 and x.u <> y.u),
links as (select distinct pair, at_a, at_b from changes semi join (select pair, at_a from (select pair, at_a, unnest(uses) as x from marks) where x.u > 0) using (pair, at_a)),
bounds as (select pair, max(at_a) filter (verdict = 'same') as last_same, max(at_a) filter (verdict = 'same' and not follows) as streak_from, max(at_a) as last_at, max(at_a) filter (breaks) as broken_at from marks group by pair),
sums as (select pair, count(*) filter (verdict = 'same' and last_same = last_at and at_a >= streak_from) as agree, count(*) filter (verdict = 'apart' and at_a > coalesce(last_same, -1)) as disagree from marks join bounds using (pair) group by pair),
since as (select pair, min(greatest(at_a, at_b)) as detected_at from links join bounds using (pair) where at_a > coalesce(broken_at, -1) group by pair),
ends as (select pair, max(at_a) as at_a, max(at_b) as at_b, (arg_max(verdict, at_a) = 'open')::int as inconclusive from verdicts group by pair)
select pair, coalesce(agree, 0)::int as agree, coalesce(disagree, 0)::int as disagree, inconclusive, detected_at is not null as linked, detected_at, at_a, at_b, case when last_same = last_at then last_same end as agreed_at
from ends left join bounds using (pair) left join sums using (pair) left join since using (pair)"""


@query(PAIR_SQL)
def pair_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link detector over all comparisons, by windows; its SQL tells the times at which links begin and break."""
    return account_groups.pair_states(comparisons(spark, sf_dir)).drop("kinds")


FORECAST_SQL = f"""with {T.priced_sql(T.USAGE_EVENTS_SQL)}, {T.windows_sql()}, {CURRENT},
timed as (select *, case when {AT} >= resets_at then 0::double else utilization end as u, (minutes * 60000)::bigint as len, resets_at - (minutes * 60000)::bigint as begins from current_),
started as (select *, resets_at + (case when {AT} >= resets_at then ({AT} - resets_at) // len + 1 else 0 end - 1) * len as start_at from timed),
spent as (select s.identity, s.kind, any_value(s.u) as utilization, any_value(s.at_ms) as at_ms, any_value(s.resets_at) as resets_at, any_value(s.label) as label, any_value(s.scope) as scope, any_value(s.len) as len, any_value(s.start_at) as start_at,
  coalesce(sum(nanos) filter (ts >= begins and ts < s.at_ms), 0)::double / 1e9::double as captured, coalesce(sum(nanos) filter (ts >= s.at_ms and ts < {AT} + 1), 0)::double / 1e9::double as since, coalesce(sum(nanos) filter (ts >= {AT} - 1800000 and ts < {AT} + 1), 0)::double / 1e9::double as recent, coalesce(sum(nanos) filter (ts >= start_at and ts < {AT} + 1), 0)::double / 1e9::double as average
  from started s left join priced p on 'identity-' || p.acct = s.identity group by s.identity, s.kind),
paced as (select *, len >= 604800000 and {AT} - start_at >= 21600000 as weekly from spent),
rated as (select *, case when weekly then average / (({AT} - start_at) / 3600000::double) else recent * 2 end as pace, case when utilization < 1 and resets_at > {AT} and at_ms < resets_at and captured >= 0.5 then greatest(0, utilization) / captured end as k from paced),
moved as (select *, utilization + k * case when k > 0 and at_ms <= {AT} then since else 0::double end as now_u from rated),
ends as (select *, case when k > 0 and pace > 0 then {AT} + (1 - now_u) / (k * pace) * 3600000 end as e from moved),
forecast as (select *, case when k > 0 and pace > 0 then case when now_u >= 1 then {AT} when e < resets_at then floor(e + 0.5::double)::bigint end end as projected_at from ends)"""


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = pricing.priced(T.usage_events(spark, sf_dir), T.rates(spark))
    own = local_table(spark, [(f"identity-{i}", i) for i in range(T.N_ACCOUNTS)], "identity string, acct int")
    return forecasts.forecast(current(spark, sf_dir), own, usage, AT, extra=True)


@query(f"""{FORECAST_SQL} select identity, kind, utilization, pace as pace_cost_per_h, case when weekly then 'window_avg' else '30m' end as pace_basis, projected_at // 1000 as projected_s, case when projected_at is not null then 'at' when k is not null and pace > 0 then 'safe' end as projection,
  round(case when k is not null and pace > 0 then now_u + k * pace * ((resets_at - {AT}) / 3600000::double) end, 6) as at_reset, greatest(0, floor(({AT} - at_ms) / 1000::double))::bigint as stale_s from forecast""")
def limit_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast(spark, sf_dir).select("identity", "kind", "utilization", "pace_cost_per_h", "pace_basis", F.floor(F.col("projected_at") / 1000).cast("long").alias("projected_s"), "projection", F.round("at_reset", 6).alias("at_reset"), "stale_s")


@query(f"""{FORECAST_SQL}, bound as (select *, row_number() over (partition by identity order by kind) as n, scope is null or scope = 'MODEL-11' as binds,
  utilization >= 0.9 - 1e-9 or coalesce(projected_at < resets_at and projected_at < {AT} + 600000, false) or coalesce(utilization + k * (since + 5) >= 0.9 - 1e-9, false) as over_ from forecast),
hit as (select * from bound where binds and over_ qualify row_number() over (partition by identity order by resets_at desc, case kind when 'five_hour' then 0 else 2 end, kind) = 1),
top as (select * from bound where binds qualify row_number() over (partition by identity order by utilization desc, case kind when 'five_hour' then 0 else 2 end, kind) = 1)
select t.identity, h.identity is not null as wait, floor(coalesce(h.utilization, t.utilization) * 10000 + 0.5::double) / 10000::double as utilization, coalesce(h.resets_at, t.resets_at) as resets_at, case when h.identity is not null then greatest(0, ceil((h.resets_at - {AT}) / 1000::double))::bigint + 30 else 0 end as wait_s
from top t left join hit h using (identity)""")
def wait_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether to wait before work of five dollars with one model; the texts are held by tests."""
    return forecasts.should_wait(forecast(spark, sf_dir), AT, "America/Toronto", cost=5.0, model="anthropic/model-11").select("identity", "wait", "utilization", "resets_at", "wait_s")


@query(f"""{FORECAST_SQL}, card as (select *, case when k is not null and pace > 0 then now_u + k * pace * ((resets_at - {AT}) / 3600000::double) end as at_reset, len = 604800000 as week_, len in (18000000, 604800000) as told_, case kind when 'five_hour' then 0 when 'seven_day' then 1 else 2 end as rank_ from forecast where scope is null),
by_ as (select identity, max(resets_at) filter (utilization >= 1 and resets_at > {AT}) as until, min(projected_at) as hits_at, min({{'r': rank_, 'k': kind, 'v': at_reset}}) filter (week_) as week, max(pace) filter (not weekly) as recent,
  max({{'u': utilization, 'w': case when week_ then 'week' else '5h' end}}) filter (told_ and resets_at > {AT} and utilization >= {forecasts.WARNING}) as high, bool_or(projected_at is null and k is not null and pace > 0) as safe from card group by identity),
said as (select *, case when until is not null then 'full' when hits_at is not null then 'hits' when week.v >= {forecasts.WARNING} then 'week' when not coalesce(recent > 0, false) then 'idle' when safe then 'safe' else 'unknown' end as verdict from by_)
select identity, verdict, coalesce(until, hits_at) // 1000 as at_s, round(case verdict when 'week' then week.v when 'idle' then high.u end, 6) as utilization, case when verdict = 'idle' then high.w end as named from said""")
def card_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forecasts.verdicts(forecast(spark, sf_dir), AT)
    return out.select("identity", "verdict", F.floor(F.col("at") / 1000).cast("long").alias("at_s"), F.round("utilization", 6).alias("utilization"), "named")


@query(f"""with {T.priced_sql(T.USAGE_EVENTS_SQL)}, {GROUPS_SQL} select grp as "group", coalesce(sum(nanos), 0)::double / 1e9::double / 24::double as cost_per_h, coalesce(sum(inp + outp + cr + cc), 0)::double / 24::double as tokens_per_h
from members left join (select * from priced where ts >= {AT} - 86400000 and ts < {AT}) p using (acct) group by grp""")
def shared_group_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = pricing.priced(T.usage_events(spark, sf_dir), T.rates(spark))
    return forecasts.shared_spend(usage, members(spark), AT - 86_400_000, AT)


ALERTS = [(i, [f"identity-{i}"] + ([f"identity-{i + 2}"] if i < 4 else []), ("any", "5h", "weekly", "weekly_scoped")[i % 4], 30 + 10 * i, None if i % 2 else "pause", f"Account {i}") for i in range(7)]


def alert_rows(spark: SparkSession) -> DataFrame:
    return local_table(spark, ALERTS, "alert_id int, members array<string>, window string, threshold int, note string, label string")


ALERTS_SQL = "alerts as (select * from (values " + ", ".join(f"({a}, {m!r}, '{w}', {t})" for a, m, w, t, _, _ in ALERTS) + ") t(alert_id, members, win, threshold))"


@query(f"""{WINDOWS}, {CURRENT}, {ALERTS_SQL}, each as (select a.alert_id, a.win, a.threshold, unnest(a.members) as identity from alerts a),
latest as (select alert_id, max({{'at_ms': at_ms, 'identity': c.identity}}) as n from each join current_ c using (identity) group by alert_id),
rows_ as (select e.alert_id, e.win, e.threshold, c.* from each e join latest l using (alert_id) join current_ c on c.identity = e.identity where c.identity = l.n.identity)
select alert_id, kind, resets_at from rows_ where resets_at > {AT} and utilization * 100 >= threshold - 1e-9 and case win when 'any' then true when '5h' then scope is null and minutes = 300 when 'weekly' then scope is null and minutes = 10080 else scope is not null and minutes = 10080 end
and alert_id <> 4""")
def alerts_firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that fire; those of alert 4 were delivered a few minutes off the reset and stay silent."""
    now = current(spark, sf_dir).withColumn("window_s", F.col("minutes") * 60)
    done = now.select(F.lit(4).alias("alert_id"), "kind", (F.col("resets_at") - 300_000).alias("resets_at"), F.lit(AT - 1).cast("long").alias("at"), F.lit(False).alias("on_set"))
    return alerts.firing(alert_rows(spark), now, done, AT).select("alert_id", "kind", "resets_at")
