"""Registered queries over log lines, merging and store comparison; lines are made from the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlark import catalog
from meterlark.catalog import ODD, PRICED, SPAN, ZONE, q, query, usage
from meterlark.functions.models import normalize_model, pretty_model
from meterlark.operators import merge
from meterlark.plans import checks, views
from meterlark.plans.periods import Zone
from meterlark.sources import rollouts, transcripts
from meterlark.sources import tables as T

# --- lines ---------------------------------------------------------------------------------------------------------


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the file (user) they stand in and their line number; ts as ISO text."""
    e = T.table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.concat(F.lit("/logs/sessions/s"), "user_id", F.lit(".jsonl")).alias("path"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("line_no"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"))


NUMBERED = "numbered as (select event_id, user_id, '/logs/sessions/s' || user_id || '.jsonl' as path, row_number() over (partition by user_id order by event_id) - 1 as line_no, epoch_us(ts) // 1000 as ms from events)"


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    count = lambda a, b: (e * a % b)
    split = F.when(e % 3 != 0, F.struct(count(7, 40).alias("ephemeral_5m_input_tokens"), count(11, 30).alias("ephemeral_1h_input_tokens")))
    body = F.struct(count(13, 900).alias("input_tokens"), count(17, 700).alias("output_tokens"), count(19, 9000).alias("cache_read_input_tokens"), F.when(e % 4 == 0, 0).otherwise(count(23, 80)).alias("cache_creation_input_tokens"), split.alias("cache_creation"), F.when(e % 6 == 0, "fast").alias("speed"))
    kind = F.when(e % 10 == 9, "user").otherwise("assistant")
    line = F.to_json(F.struct(kind.alias("type"), F.concat(F.lit("r"), e).alias("requestId"), "at", F.col("at").alias("timestamp"), F.struct(F.concat(F.lit("m"), (e / 2).cast("long")).alias("id"), F.when(e % 8 == 7, "<synthetic>").otherwise(F.concat(F.lit("model-"), e % 5)).alias("model"), body.alias("usage")).alias("message")))
    return numbered(spark, sf_dir).select("path", "line_no", F.when(e % 16 == 5, F.substring(line, 1, 60)).otherwise(line).alias("value"))


@query(f"""with {NUMBERED} select path, line_no, ms as ts, 'model-' || event_id % 5 as model, event_id * 13 % 900 as inp, event_id * 17 % 700 as outp, event_id * 19 % 9000 as cr,
  case when (case when event_id % 4 = 0 then 0 else event_id * 23 % 80 end) = 0 and event_id % 3 <> 0 and event_id * 7 % 40 + event_id * 11 % 30 > 0 then event_id * 7 % 40 + event_id * 11 % 30 when event_id % 4 = 0 then 0 else event_id * 23 % 80 end as cc,
  case when event_id % 3 <> 0 then event_id * 7 % 40 end as e5, case when event_id % 3 <> 0 then event_id * 11 % 30 end as e1, case when event_id % 6 = 0 then 1 else 0 end as tier
from numbered where event_id % 10 <> 9 and event_id % 8 <> 7 and event_id % 16 <> 5""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines parsed: counts by type, split cache writes, broken, synthetic and other lines left out."""
    return transcripts.parse(transcript_lines(spark, sf_dir)).drop("key")


@query(f"with {NUMBERED} select path, count(*) as lines, count(*) filter (event_id % 16 <> 5) as candidates, 0::bigint as malformed, count(*) filter (event_id % 10 <> 9 and event_id % 8 <> 7 and event_id % 16 <> 5) as usage_lines, 0::bigint as unkeyed from numbered group by path")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.stats(transcript_lines(spark, sf_dir))


def paired_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines of which each two share a message, in one file or two; every ninth has no time."""
    e = F.col("event_id")
    untimed = F.regexp_replace("value", '"timestamp":"[^"]*"', '"timestamp":"soon"')
    request = F.concat(F.lit('"requestId":"r'), F.floor(e / 2), F.lit('"'))
    rows = transcript_lines(spark, sf_dir).join(numbered(spark, sf_dir).select("path", "line_no", "event_id"), ["path", "line_no"])
    return rows.withColumn("value", F.when(e % 9 == 4, untimed).otherwise(F.col("value"))).select("path", "line_no", F.regexp_replace(F.col("value"), F.lit('"requestId":"r[0-9]+"'), request).alias("value"))


@query(f"""with {NUMBERED}, parsed as (select event_id // 2 as key, path, line_no, case when event_id % 9 <> 4 then ms end as ts, 'model-' || event_id % 5 as model, event_id * 13 % 900 as inp, event_id * 17 % 700 as outp, event_id * 19 % 9000 as cr,
  case when (event_id % 4 = 0 or event_id * 23 % 80 = 0) and event_id % 3 <> 0 and event_id * 7 % 40 + event_id * 11 % 30 > 0 then event_id * 7 % 40 + event_id * 11 % 30 when event_id % 4 = 0 then 0 else event_id * 23 % 80 end as cc,
  case when event_id % 3 <> 0 then event_id * 7 % 40 end as e5, case when event_id % 3 <> 0 then event_id * 11 % 30 end as e1, case when event_id % 6 = 0 then 1 else 0 end as tier
  from numbered where event_id % 10 <> 9 and event_id % 8 <> 7 and event_id % 16 <> 5),
first_ as (select key, min({{'path': path, 'line_no': line_no, 'ts': ts, 'model': model}}) as f from parsed where ts is not null group by key)
select f.path as path, f.ts as ts, f.model as model, max(inp) as inp, max(outp) as outp, max(cr) as cr, max(cc) as cc, max(e5) as e5, max(e1) as e1, max(tier) as tier
from parsed p join first_ using (key) where (p.path, p.line_no) >= (f.path, f.line_no) group by key, f""")
def transcript_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of the transcripts' keys (a 64-bit digest that SQL lacks), folded in path and line order."""
    return transcripts.folded(transcripts.parse(paired_lines(spark, sf_dir))).drop("key")


def rollout_lines(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    e = F.col("event_id")
    x = e % 97 * 10
    named = lambda a, b, c: F.struct(a.alias("input_tokens"), b.alias("cached_input_tokens"), c.alias("output_tokens"))
    total, last = F.when(e % 7 != 0, named(x, F.floor(x / 2), F.floor(x / 3))), named(x % 50, x % 20, x % 11)
    line = F.when(e % 5 == 0, F.to_json(F.struct(F.lit("turn_context").alias("type"), F.col("at").alias("timestamp"), F.struct(F.concat(F.lit("gpt-"), e % 3).alias("model")).alias("payload")))).when(
        e % 5 == 1, F.to_json(F.struct(F.lit("event_msg").alias("type"), F.col("at").alias("timestamp"), F.struct(F.lit("thread_settings_applied").alias("type"), F.struct(F.when(e % 2 == 0, "fast").otherwise("flex").alias("service_tier")).alias("thread_settings")).alias("payload")))).otherwise(
        F.to_json(F.struct(F.lit("event_msg").alias("type"), F.col("at").alias("timestamp"), F.struct(F.lit("token_count").alias("type"), F.struct(total.alias("total_token_usage"), last.alias("last_token_usage")).alias("info")).alias("payload"))))
    return (numbered(spark, sf_dir) if rows is None else rows).select("path", "line_no", line.alias("value"))


@query(f"""with {NUMBERED}, counts as (select path, line_no, ms as ts, case when event_id % 7 <> 0 then [event_id % 97 * 10, event_id % 97 * 10 // 2, event_id % 97 * 10 // 3] end as total, [event_id % 97 * 10 % 50, event_id % 97 * 10 % 20, event_id % 97 * 10 % 11] as last_ from numbered where event_id % 5 >= 2),
lagged as (select *, last_value(total ignore nulls) over (partition by path order by line_no rows between unbounded preceding and 1 preceding) as was from counts),
used as (select path, line_no, ts, case when total is null or was is null then last_ when total = was then null when total[1] >= was[1] and total[2] >= was[2] and total[3] >= was[3] then [total[1] - was[1], total[2] - was[2], total[3] - was[3]]
  when total = last_ or (total[1] < was[1] and total[2] < was[2] and total[3] < was[3]) then total else last_ end as u from lagged)
select path, line_no, ts, u[1] as input, u[2] as cached, u[3] as output from used where u is not null and not (u[1] = 0 and u[3] = 0)""")
def counter_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cumulative counters add, line by line."""
    rows = rollouts.advanced(rollouts.parse(rollout_lines(spark, sf_dir)))
    return rows.select("path", "line_no", "ts", F.col("usage")[0].alias("input"), F.col("usage")[1].alias("cached"), F.col("usage")[2].alias("output"))


@query(f"""with {NUMBERED}, said as (select path, line_no, case when event_id % 5 = 0 then 'gpt-' || event_id % 3 end as m, case when event_id % 5 = 1 then (event_id % 2 = 0)::int end as t from numbered)
select path, line_no, coalesce(last_value(m ignore nulls) over back, first_value(m ignore nulls) over ahead, 'codex-unattributed') as model, coalesce(last_value(t ignore nulls) over back, 0) as tier from said
window back as (partition by path order by line_no rows between unbounded preceding and current row), ahead as (partition by path order by line_no rows between current row and unbounded following)""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model and tier in force at each line; models also reach back to lines before the first."""
    return rollouts.carried(rollouts.parse(rollout_lines(spark, sf_dir))).select("path", "line_no", "model", "tier")


#: Lines of a parent that its child's file begins with; the parent's line at whose time the child was forked off.
HEAD, FORK = 12, 8


def forked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts of which every second of three is forked from the one before and retells its head; every third one's parent is gone and its head a burst."""
    u, zone = F.col("user_id"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    rows = numbered(spark, sf_dir)
    first = rows.where("line_no = 0").select("user_id", F.to_timestamp("at").alias("_first"))
    quick = F.date_format(F.timestamp_millis(F.unix_millis("_first") + 400 * F.col("line_no")), zone)
    rows = rows.join(first, "user_id").withColumn("at", F.when((u % 3 == 2) & (F.col("line_no") < 5), quick).otherwise(F.col("at")))
    lines = rollout_lines(spark, sf_dir, rows).withColumn("user_id", F.regexp_extract("path", r"s(\d+)\.jsonl$", 1).cast("long"))
    path = lambda x: F.concat(F.lit("/logs/sessions/s"), x, F.lit(".jsonl"))
    own = lines.select("path", (F.col("line_no") + F.when(u % 3 == 1, HEAD + 1).when(u % 3 == 2, 1).otherwise(0)).alias("line_no"), "value")
    users = rows.select("user_id").distinct().where("user_id % 3 != 0")
    heads = lines.where((u % 3 == 0) & (F.col("line_no") < HEAD)).select((u + 1).alias("user_id"), (F.col("line_no") + 1).alias("line_no"), "value").join(users, "user_id", "left_semi")
    forks = rows.where((u % 3 == 0) & (F.col("line_no") == FORK)).select((u + 1).alias("user_id"), F.col("at").alias("fork"))
    told = F.struct(F.lit("session_meta").alias("type"), F.col("fork").alias("timestamp"), F.struct(F.when(u % 3 == 1, F.concat(F.lit("s"), u - 1)).otherwise("gone").alias("forked_from_id")).alias("payload"))
    metas = users.join(forks, "user_id", "left").select(path("user_id").alias("path"), F.lit(0).cast("long").alias("line_no"), F.to_json(told).alias("value"))
    return own.unionByName(heads.select(path("user_id").alias("path"), "line_no", "value")).unionByName(metas)


@query(f"""with {NUMBERED}, firsts as (select user_id, ms as ms0 from numbered where line_no = 0),
own as (select user_id as u, event_id as e, line_no as n, case when user_id % 3 = 2 and line_no < 5 then ms0 + 400 * line_no else ms end as ms from numbered join firsts using (user_id)),
lines as (select u, n + case u % 3 when 1 then {HEAD + 1} when 2 then 1 else 0 end as n, e, ms from own union all select u + 1, n + 1, e, ms from own where u % 3 = 0 and n < {HEAD} and u + 1 in (select u from own)),
forks as (select u + 1 as u, ms as fork from own where u % 3 = 0 and n = {FORK}),
said as (select u, n, ms, e, coalesce(last_value(case when e % 5 = 0 then 'gpt-' || e % 3 end ignore nulls) over back, first_value(case when e % 5 = 0 then 'gpt-' || e % 3 end ignore nulls) over ahead, 'codex-unattributed') as model,
  coalesce(last_value(case when e % 5 = 1 then (e % 2 = 0)::int end ignore nulls) over back, 0) as tier from lines
  window back as (partition by u order by n rows between unbounded preceding and current row), ahead as (partition by u order by n rows between current row and unbounded following)),
counts as (select *, case when e % 7 <> 0 then [e % 97 * 10, e % 97 * 10 // 2, e % 97 * 10 // 3] end as total, [e % 97 * 10 % 50, e % 97 * 10 % 20, e % 97 * 10 % 11] as last_ from said where e % 5 >= 2),
probes as (select u, nth_value(ms, 1) over w as t1, nth_value(ms, 2) over w as t2 from counts window w as (partition by u order by n rows between unbounded preceding and unbounded following)),
lagged as (select *, last_value(total ignore nulls) over (partition by u order by n rows between unbounded preceding and 1 preceding) as was from counts),
used as (select *, case when total is null or was is null then last_ when total = was then null when total[1] >= was[1] and total[2] >= was[2] and total[3] >= was[3] then [total[1] - was[1], total[2] - was[2], total[3] - was[3]]
  when total = last_ or (total[1] < was[1] and total[2] < was[2] and total[3] < was[3]) then total else last_ end as x from lagged),
events_ as (select *, row_number() over (partition by u order by n) as i from used where x is not null and not (x[1] = 0 and x[3] = 0)),
met as (select c.*, t1, t2, coalesce(c.x = p.x and (fork is null or p.ms <= fork), false) as same from events_ c left join events_ p on c.u % 3 = 1 and p.u = c.u - 1 and p.i = c.i left join forks f on f.u = c.u left join (select distinct * from probes) q on q.u = c.u),
told as (select *, bool_and(same) over (partition by u order by n) as retold, bool_and(coalesce(ms - coalesce(prior, t1) between 0 and 1000, false)) over (partition by u order by n) as close from (select *, lag(ms) over (partition by u order by n) as prior from met)),
judged as (select *, u % 3 <> 0 and case when max(retold::int) over (partition by u) > 0 then retold else coalesce(t2 - t1 between 0 and 1000, false) and close end as inherited from told),
one as (select u, ms, total, last_, min({{'n': n, 'model': model, 'tier': tier}}) as f, max(x[1] - least(x[1], x[2])) as inp, max(x[3]) as outp, max(least(x[1], x[2])) as cr from judged where not inherited group by u, ms, total, last_)
select '/logs/sessions/s' || u || '.jsonl' as path, ms as ts, f.model as model, inp, outp, cr, f.tier as tier from one""")
def rollout_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of rollouts, some of which retell their parent's head or begin with a burst: what they inherit isn't counted again."""
    return rollouts.usage_rows(rollouts.parse(forked_lines(spark, sf_dir))).select("path", "ts", "model", "inp", "outp", "cr", "tier")


# --- merging and models ----------------------------------------------------------------------------------------------


@query(f"""with {T.USAGE_ROWS_SQL}, m as (select key, min({{'acct': acct, 'ts': ts, 'model': model}}) as f, max(inp) as inp, max(outp) as outp, max(cr) as cr, max(cc) as cc, max(e5) as e5, max(e1) as e1, max(tier) as tier, side from
  (select *, 0 as side from usage_rows where acct < 6 union all select * replace (inp // 2 as inp, 0 as tier), 1 as side from usage_rows where acct >= 4) group by key, side)
select coalesce(s.key, n.key) as key, coalesce(s.f.acct, n.f.acct) as acct, coalesce(s.f.ts, n.f.ts) as ts, case when n.key is not null then n.f.model else s.f.model end as model, {", ".join(f"case when n.key is not null then n.{c} else s.{c} end as {c}" for c in merge.COUNTERS)}
from (select * from m where side = 0) s full join (select * from m where side = 1) n on s.key = n.key""")
def replace_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.storable(T.usage_rows(spark, sf_dir))
    incoming = rows.where("acct >= 4").withColumn("inp", F.floor(F.col("inp") / 2).cast("long")).withColumn("tier", F.lit(0))
    return merge.replaced(merge.merged(rows.where("acct < 6")), incoming)


@query(f"with {T.USAGE_SQL} select * from usage where not (key % 11 = 0 and acct <> 3)")
def tombstone_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys dropped and others restored before: what is left."""
    rows = usage(spark, sf_dir)
    mark = lambda df: df.select("key", F.lit("replayed").alias("reason"), F.lit(0).cast("long").alias("at"))
    dropped = mark(rows.where("key % 11 = 0"))
    lifted = dropped.join(rows.where("key % 11 = 0 and acct = 3").select("key"), "key", "left_anti")
    return merge.without(rows, lifted)


@query(f"""with {T.USAGE_ROWS_SQL}, n as (select distinct model, regexp_replace(regexp_replace(regexp_replace(replace(lower(model), '[1m]', ''), '^anthropic/', ''), '-[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$', ''), '-[0-9]{{6,8}}$', '') as model_key from usage_rows) select model, model_key, model_key as shown from n""")
def normalized_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.usage_rows(spark, sf_dir).select("model").distinct().select("model", normalize_model(F.col("model")).alias("model_key")).withColumn("shown", pretty_model(F.col("model_key")))


@query(f"with {T.USAGE_SQL} select acct, min(ts) as lo, max(ts) as hi, count(*) as n from usage where key in (select key from usage_rows group by key having count(*) filter (acct < 6) = 0) group by acct")
def changed_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which accounts a pass touched: rows whose keys the store lacked before."""
    rows = merge.storable(T.usage_rows(spark, sf_dir))
    before, after = merge.merged(rows.where("acct < 6")), merge.merged(rows)
    keys = merge.changed_keys(before, after).join(before.select("key"), "key", "left_anti")
    return after.join(keys, "key", "left_semi").groupBy("acct").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n"))


# --- comparison and views --------------------------------------------------------------------------------------------

DAY = catalog.DAY_SQL
CELLS = f"select {DAY} as day, acct, model_key, tier, sum(inp) as inp, sum(outp) as outp, sum(cr) as cr, sum(cc) as cc, count(*) as rows from priced"


@query(f"""{PRICED}, a as ({CELLS} group by all), b as ({CELLS} where key % 7 <> 0 group by all)
select coalesce(a.day, b.day) as day, coalesce(a.acct, b.acct) as acct, coalesce(a.model_key, b.model_key) as model_key, coalesce(a.tier, b.tier) as tier, case when b.day is null then 'only_before' else 'fewer_rows' end as category,
  (coalesce(b.inp + b.outp + b.cr + b.cc, 0) - coalesce(a.inp + a.outp + a.cr + a.cc, 0))::bigint as tokens, coalesce(b.rows, 0) - coalesce(a.rows, 0) as rows
from a full join b on a.day = b.day and a.acct = b.acct and a.model_key = b.model_key and a.tier = b.tier where coalesce(a.rows, 0) <> coalesce(b.rows, 0)""")
def parity_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores compared by day, account, model and tier."""
    own = q(spark, sf_dir)
    cells = lambda rows: checks.cells(rows, Zone(ZONE))
    return checks.differing(cells(own.within(None)), cells(own.within(None).where("key % 7 != 0"))).drop("cost")


@query(f"""with {T.USAGE_SQL}, {T.ACCOUNTS_SQL} select coalesce(provider, 'unknown') as provider, count(*) as rows, count(distinct acct) as accounts, count(distinct model) as models, 0::bigint as unattributed, min(ts) as first_ts, max(ts) as last_ts, 0::bigint as drifted
from usage left join accounts on acct = id and id <> 5 group by 1""")
def store_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterlark.operators import rollup

    rows = usage(spark, sf_dir)
    return checks.health(rows, T.accounts(spark).where("id != 5"), rollup.built(rows))


@query(f"""{PRICED}, s as (select date_trunc('week', {DAY})::date as slot, model_key, acct, tokens, nanos from priced where ts >= {ODD.start} and ts < {ODD.end})
select grouping(slot, model_key, acct)::int as grouping, slot, model_key, acct, sum(tokens)::bigint as tokens, floor(coalesce(sum(nanos), 0)::double / 1e9::double * 1e6::double + 0.5::double) / 1e6::double as cost, count(*) as records from s group by grouping sets ((slot), (slot, model_key), (slot, acct), (model_key), (acct), ())""")
def history_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history by week, by model and by account and their totals, from one aggregation."""
    return views.history(q(spark, sf_dir), ODD, "week")


@query(f"""{PRICED} select {DAY} as day, {catalog.M} from priced where ts >= {SPAN.start} and ts < {SPAN.end} and date_trunc('week', {DAY}) = date '1998-04-06' group by 1""")
def week_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.days_within(q(spark, sf_dir), SPAN, "week", "1998-04-06")
