"""Registered queries over what keeps a store: batches, recovery, accounts, keys, captures and rate cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.catalog import PRICED, query, usage
from meterlark.catalog_ingest import NUMBERED, numbered
from meterlark.catalog_limits import GROUPS
from meterlark.functions.keys import group_id, root_identity
from meterlark.functions.models import normalize_model
from meterlark.functions.timestamps import timestamp_ms
from meterlark.operators import account_groups, alerts, merge
from meterlark.plans import views
from meterlark.sources import limits_cache, rollouts
from meterlark.sources import tables as T
from meterlark.sources.local import local_table

# --- batches and recovery --------------------------------------------------------------------------------------------

MAXIMA = ", ".join(f"max({c}) as {c}" for c in merge.COUNTERS)
#: A store of accounts below 6; a batch drops keys of 3, restores those of 5 (dropped before), replaces some and merges the rest.
PARTS_SQL = f"""{T.USAGE_SQL},
stored as (select key, min({{'acct': acct, 'ts': ts, 'model': model}}) as f, {MAXIMA} from usage_rows where acct < 6 and acct <> 5 group by key),
upserts as (select * from usage_rows where acct >= 4),
replaces as (select key, min({{'acct': acct, 'ts': ts, 'model': model}}) as f, max(inp) // 3 as inp, max(outp) as outp, max(cr) as cr, max(cc) as cc, max(e5) as e5, max(e1) as e1, max(tier) as tier from usage_rows where acct = 2 and key % 2 = 0 group by key)"""


def _parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = merge.storable(T.usage_rows(spark, sf_dir))
    mark = lambda df, why: df.select("key").distinct().select("key", F.lit(why).alias("reason"), F.lit(0).cast("long").alias("at"))
    replace = merge.merged(rows.where("acct = 2 and key % 2 = 0")).withColumn("inp", F.floor(F.col("inp") / 3).cast("long"))
    return {
        "stored": merge.merged(rows.where("acct < 6 and acct <> 5")), "dropped": mark(rows.where("acct = 5"), "before"), "restore": rows.where("acct = 5").select("key"),
        "drop": mark(rows.where("acct = 3"), "replayed"), "replace": replace, "upsert": rows.where("acct >= 4"),
    }


@query(f"""with {PARTS_SQL}, going as (select distinct key from usage_rows where acct = 3 and key not in (select key from upserts) and key not in (select key from replaces)),
a as (select coalesce(s.key, r.key) as key, case when s.key is null then r.f else s.f end as f, case when r.key is not null then r.f.model else s.f.model end as model, {", ".join(f"case when r.key is not null then r.{c} else s.{c} end as {c}" for c in merge.COUNTERS)}
  from (select * from stored where key not in (select key from going)) s full join (select * from replaces where key not in (select key from going)) r on s.key = r.key),
b as (select 0 as o, key, f.acct as acct, f.ts as ts, model, {", ".join(merge.COUNTERS)} from a union all select 1, key, acct, ts, model, {", ".join(merge.COUNTERS)} from upserts where key not in (select key from going)),
m as (select key, min({{'o': o, 'acct': acct, 'ts': ts, 'model': model}}) as f, {MAXIMA} from b group by key)
select key, f.acct as acct, f.ts as ts, f.model as model, {", ".join(merge.COUNTERS)} from m""")
def batch_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage after one batch: keys restored, dropped (but those the batch counts), replaced and merged, in this order."""
    p = _parts(spark, sf_dir)
    return merge.written(p["stored"], p["dropped"], restore=p["restore"], drop=p["drop"], replace=p["replace"], upsert=p["upsert"])[0]


@query(f"""with {PARTS_SQL} select distinct key, 'replayed' as reason from usage_rows where acct = 3 and key not in (select key from upserts) and key not in (select key from replaces)
union select distinct key, 'before' from usage_rows where acct = 5 and key not in (select key from usage_rows where acct = 5)""")
def batch_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys dropped after the same batch."""
    p = _parts(spark, sf_dir)
    return merge.written(p["stored"], p["dropped"], restore=p["restore"], drop=p["drop"], replace=p["replace"], upsert=p["upsert"])[1].select("key", "reason")


@query(f"""with {T.USAGE_SQL}, both_ as (select key, 0 as o, acct, ts, model, {", ".join(merge.COUNTERS)} from usage_rows where acct < 5 union all select key, 1, acct, ts, model, {", ".join(merge.COUNTERS)} from usage_rows where acct >= 3),
firsts as (select o, key, min({{'acct': acct, 'ts': ts, 'model': model}}) as f, {MAXIMA} from both_ group by o, key), m as (select key, min({{'o': o, 'f': f}}) as x, {MAXIMA} from firsts group by key)
select key, x.f.acct as acct, x.f.ts as ts, x.f.model as model, {", ".join(merge.COUNTERS)} from m where key % 13 <> 0""")
def store_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store joined with a damaged copy: the copy's dropped keys hold, its rows are merged in."""
    rows = merge.storable(T.usage_rows(spark, sf_dir))
    gone = rows.where("key % 13 = 0").select("key", F.lit("copy").alias("reason"), F.lit(1).cast("long").alias("at")).distinct()
    found, _ = merge.recovered(merge.merged(rows.where("acct < 5")), merge.merged(rows.where("acct >= 3")), gone.where("key < 0"), gone)
    return found


@query(f"with {T.USAGE_ROWS_SQL} select count(*) as rows, count(*) filter (inp % 10 < 8 and ts < 900000000000) as plausible from usage_rows")
def rows_salvaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with spoilt counts and times those that can be real."""
    rows = T.usage_rows(spark, sf_dir)
    spoilt = rows.withColumn("inp", F.when(F.col("inp") % 10 >= 8, -F.col("inp") - 1).otherwise(F.col("inp")))
    return spoilt.agg(F.count(F.lit(1)).alias("rows")).join(merge.plausible(spoilt, 900_000_000_000 - 1).agg(F.count(F.lit(1)).alias("plausible")), F.lit(True))


# --- accounts, identities, groups --------------------------------------------------------------------------------------


@query("""with seen as (select case c_nationkey % 2 when 0 then 'claude' else 'codex' end as provider, 'root-' || c_nationkey || '-' || c_custkey % 40 as identity, c_name as label, c_custkey % 3 = 0 as explicit, c_custkey as seq from customer),
new_ as (select provider, identity, max_by(label, {'e': explicit, 's': seq}) as n_label, bool_or(explicit) as explicit, min(seq) as seq from seen group by all),
stored as (select provider, identity, 'old ' || identity as label, row_number() over (order by identity)::int as id from (select distinct provider, identity from seen where seq % 40 < 10))
select s.id, s.provider, s.identity, case when n.explicit then n.n_label else s.label end as label from stored s left join new_ n using (provider, identity)
union all select ((select max(id) from stored) + row_number() over (order by n.seq, n.provider, n.identity))::int, n.provider, n.identity, n.n_label from new_ n anti join stored s using (provider, identity)""")
def accounts_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts seen by a pass, against stored ones: explicit labels rename, new ones get the next numbers."""
    from pyspark.sql import Window as W

    c = T.table(spark, sf_dir, "customer")
    seen = c.select(F.when(F.col("c_nationkey") % 2 == 0, "claude").otherwise("codex").alias("provider"), F.concat(F.lit("root-"), "c_nationkey", F.lit("-"), F.col("c_custkey") % 40).alias("identity"), F.col("c_name").alias("label"), (F.col("c_custkey") % 3 == 0).alias("explicit"), F.col("c_custkey").alias("seq"))
    stored = seen.where("seq % 40 < 10").select("provider", "identity").distinct().select(F.row_number().over(W.orderBy("identity")).alias("id"), "provider", "identity", F.concat(F.lit("old "), "identity").alias("label"))
    return merge.accounts_interned(stored, seen)


@query(f"with {NUMBERED}, p as (select distinct path from numbered) select path, substr(sha256(path), 1, 32) as identity, substr(sha256(list_aggregate(list_sort([path, '/logs/other', '/logs/a']), 'string_agg', chr(10))), 1, 32) as grouped from p")
def root_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of folders, and of groups of them."""
    rows = numbered(spark, sf_dir).select("path").distinct()
    return rows.select("path", root_identity(F.col("path")).alias("identity"), group_id(F.array(F.col("path"), F.lit("/logs/other"), F.lit("/logs/a"))).alias("grouped"))


@query("select * from (values ('identity-0', 'identity-0,identity-2', 'auto'), ('identity-2', 'identity-0,identity-2', 'auto'), ('identity-1', 'identity-1,identity-3', 'manual'), ('identity-3', 'identity-1,identity-3', 'manual'), ('identity-5', 'identity-5,identity-7', 'auto'), ('identity-7', 'identity-5,identity-7', 'auto')) t(identity, members, source)")
def groups_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of roots from manual and detected links, less those that must stay apart."""
    roots = [(T.PROVIDERS[i % 2], f"identity-{i}") for i in range(T.N_ACCOUNTS)]
    found = account_groups.resolve_groups(roots, [["identity-1", "identity-3", "identity-4"]], [("identity-3", "identity-5"), ("identity-2", "identity-6")], ["identity-0|identity-2", "identity-2|identity-6", "identity-3|identity-5", "identity-5|identity-7"])
    return local_table(spark, [(k, ",".join(v["members"]), v["source"]) for k, v in found.items()], "identity string, members string, source string")


@query(f"""with {T.USAGE_SQL}, {T.ACCOUNTS_SQL}, members as (select 'identity-' || i as identity, g from (values {", ".join(f"({i}, '{g}')" for i, g in GROUPS)}) t(i, g)),
known as (select distinct 'identity-' || (user_id % 9) as identity from events where user_id % 9 < 4)
select a.identity as id, a.label, a.provider, m.g as "group", exists (select 1 from known k left join members km on km.identity = k.identity where k.identity = a.identity or km.g = m.g) as known, u.last_seen, a.identity = 'identity-2' as is_current
from accounts a left join members m on m.identity = a.identity left join (select acct, max(ts) as last_seen from usage group by acct) u on u.acct = a.id""")
def account_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every root with its group, whether anything is known of its sign-in, its last use and which is the current one."""
    groups = local_table(spark, [(f"identity-{i}", g) for i, g in GROUPS], "identity string, group string")
    status = T.captures(spark, sf_dir).select("identity").where(F.substring("identity", 10, 5).cast("int") < 4).distinct()
    return views.account_list(T.accounts(spark), groups, status, usage(spark, sf_dir), "identity-2")


# --- captures and files --------------------------------------------------------------------------------------------------


@query("""with caps as (select 'identity-' || (user_id % 9) as identity, case user_id % 9 % 2 when 0 then 'claude' else 'codex' end as provider, epoch_us(ts) // 1000 as at_ms, event_id as seq from events),
one as (select identity, seq % 2 as side, max({'at': at_ms, 'seq': seq, 'provider': provider}) as c from caps group by all)
select identity, c.provider as provider, c.at as at_ms, side from one qualify row_number() over (partition by identity order by c.at desc, side) = 1""")
def captures_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of captures with newer ones written into it: of each identity the fresher; of equally fresh ones the stored."""
    rows = T.captures(spark, sf_dir).withColumn("side", (F.col("seq") % 2).cast("long"))
    newest = rows.groupBy("identity", "side").agg(F.max_by(F.struct("provider", "captured_at", "via"), F.struct("captured_at", "seq")).alias("c")).select("identity", "side", "c.*")
    out = limits_cache.merged(newest.where("side = 0"), newest.where("side = 1"))
    return out.select("identity", "provider", F.round(F.col("captured_at") * 1000).cast("long").alias("at_ms"), "side")


def session_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's files by user: some names end with a UUID in capitals, some sessions were archived, too."""
    u = numbered(spark, sf_dir).select("user_id").distinct()
    uuid = F.format_string("AB%06d-0000-4000-8000-%012d", F.col("user_id"), F.col("user_id"))
    name = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("rollout-2026-"), uuid)).otherwise(F.concat(F.lit("plain-"), "user_id"))
    live = u.select(F.concat(F.lit("/home/x/sessions/2026/"), name, F.lit(".jsonl")).alias("path"))
    return live.unionByName(u.where("user_id % 2 = 0").select(F.concat(F.lit("/home/x/archived_sessions/"), name, F.lit(".jsonl")).alias("path")))


@query("""with u as (select distinct user_id as u from events), n as (select u, case when u % 3 = 0 then 'rollout-2026-AB' || printf('%06d', u) || '-0000-4000-8000-' || printf('%012d', u) else 'plain-' || u end as name, case when u % 3 = 0 then 'ab' || printf('%06d', u) || '-0000-4000-8000-' || printf('%012d', u) else 'plain-' || u end as sid from u)
select sid, '/home/x/sessions/2026/' || name || '.jsonl' || case when u % 2 = 0 then ',/home/x/archived_sessions/' || name || '.jsonl' else '' end as paths from n""")
def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and their files, active ones before archived ones."""
    return rollouts.session_index(session_paths(spark, sf_dir)).select("sid", F.array_join("paths", ",").alias("paths"))


@query(f"""with {NUMBERED}, newest as (select path, max({{'ms': ms, 'line_no': line_no, 'e': event_id}}) as x from numbered where event_id % 3 <> 0 and not (event_id % 7 = 0 and event_id % 5 = 0) group by path)
select path, x.ms as at_ms, case when x.e % 7 <> 0 then (x.e % 100)::double end as primary_used, case when x.e % 5 <> 0 then (x.e % 90)::double end as weekly_used from newest""")
def rollout_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest limits that each rollout tells; windows that are missing are left out."""
    e = F.col("event_id")
    window = lambda used, minutes: F.struct(used.alias("used_percent"), F.lit(minutes).alias("window_minutes"), (F.unix_timestamp(F.to_timestamp("at")) + 3600).alias("resets_at"))
    limits = F.struct(F.when(e % 7 != 0, window((e % 100).cast("double"), 300)).alias("primary"), F.when(e % 5 != 0, window((e % 90).cast("double"), 10_080)).alias("secondary"))
    body = F.struct(F.lit("event_msg").alias("type"), F.col("at").alias("timestamp"), F.struct(F.when(e % 3 != 0, "token_count").otherwise("other").alias("type"), limits.alias("rate_limits")).alias("payload"))
    found = rollouts.latest_limits(numbered(spark, sf_dir).select("path", "line_no", F.to_json(body).alias("value")))
    used = lambda kind: F.col("rate_limits")[kind]["used_percentage"]
    return found.select("path", F.round(F.col("captured_at") * 1000).cast("long").alias("at_ms"), used("codex_primary").alias("primary_used"), used("codex_secondary").alias("weekly_used"))


SHAPES_SQL = """with t as (select event_id as e, epoch_us(ts) // 1000 as ms from events)
select e as event_id, case e % 8 when 0 then ms when 1 then ms // 1000 * 1000 when 2 then ms // 1000 * 1000 - 3600000 when 3 then ms // 86400000 * 86400000 when 4 then ms // 86400000 * 86400000 when 5 then ms // 86400000 * 86400000 + 86400000 when 6 then ms // 60000 * 60000 else null end as ms from t"""


@query(SHAPES_SQL)
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants written in eight ways (ISO, basic form with an offset, dates, weeks, 24:00, minutes, nonsense), read back."""
    at = F.col("ts").cast("timestamp")
    e, shown = F.col("event_id"), lambda pattern: F.date_format(at, pattern)
    week = F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.concat(F.lit("W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0")), (F.weekday(at) + 1).cast("string"))
    text = (
        F.when(e % 8 == 0, shown("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(e % 8 == 1, shown("yyyyMMdd'T'HHmmss")).when(e % 8 == 2, shown("yyyyMMdd'T'HHmmss'+0100'")).when(e % 8 == 3, shown("yyyy-MM-dd"))
        .when(e % 8 == 4, week).when(e % 8 == 5, shown("yyyy-MM-dd'T24:00'")).when(e % 8 == 6, shown("yyyy-MM-dd HH:mm")).otherwise(shown("dd.MM.yyyy HH:mm"))
    )
    return T.table(spark, sf_dir, "events").select("event_id", timestamp_ms(text).alias("ms"))


# --- rate cards and alerts' life ---------------------------------------------------------------------------------------------


@query(f"with {T.USAGE_SQL}, {T.rates_sql()}, one as (select distinct from_ms from rates where from_ms > 0 and rtier = 0) select from_ms, count(*) over () as n, (select count(*) from usage where ts >= from_ms) as records_since from one")
def rate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every instant at which some price changes, with the rows since: one scan, as the instants are those of the cards."""
    found = T.rate_table().boundaries()
    counts = usage(spark, sf_dir).agg(F.array(*(F.struct(F.lit(t).alias("from_ms"), F.lit(len(found)).cast("long").alias("n"), F.count_if(F.col("ts") >= t).alias("records_since")) for t in found)).alias("x"))
    return counts.select(F.inline("x"))


@query(f"""{PRICED}, used as (select model_key, count(*) as records from priced group by model_key), card as (select * from rates where rtier = 0 and from_ms <= 904608000000 and to_ms > 904608000000), fast as (select * from rates where rtier = 1 and from_ms <= 904608000000 and to_ms > 904608000000 and rstatus = 'priced')
select c.model_key, c.input, c.output, coalesce(c.cache_read, c.input * 0.1::double) as cache_read, c.cache_write, f.input as fast_input, f.output as fast_output, c.lc_threshold,
  case when c.model_key = 'model-51' then 'model-31' end as estimated_as, case when c.model_key = 'model-51' then 'alias' when c.model_key in ('model-12', 'model-99') then 'override' else 'bundled' end as source, coalesce(u.records, 0) as records
from (select * from card where model_key <> 'model-12' union all select * replace (7.5::double as input, 30::double as output, null::double as cache_read) from card where model_key = 'model-12'
  union all select * replace ('model-99' as model_key, 7.5::double as input, 30::double as output, null::double as cache_read, null::double as cache_write, null::bigint as lc_threshold) from card where model_key = 'model-12') c
left join (select * from fast where model_key not in ('model-12', 'model-99')) f on f.model_key = c.model_key left join used u on u.model_key = c.model_key""")
def rate_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's card now, its fast pair, and where it comes from: bundled, a user's own, or another model's by alias; with the rows it is for."""
    card = '{"input": 7.5, "output": 30}'
    bundled = T.rate_table()
    records = usage(spark, sf_dir).groupBy(normalize_model(F.col("model")).alias("model_key")).agg(F.count(F.lit(1)).alias("_n"))
    cards = views.rate_cards(bundled.overridden('{"models": {"model-12": %s, "model-99": %s}}' % (card, card)), bundled, spark, 904_608_000_000)
    return cards.join(records, "model_key", "left").withColumn("records", F.coalesce("_n", F.lit(0).cast("long"))).drop("_n")


@query("""with calls as (select user_id % 50 as session, epoch_us(ts) // 1000 as at_ms, event_id as seq, event_type as tool from events), recent as (select * from calls where (select max(at_ms) from calls) - at_ms <= 600000 * 50)
select session, at_ms, seq, tool from recent qualify row_number() over (partition by session order by at_ms desc, seq desc) = 1""")
def sessions_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's latest call of the last eight hours."""
    calls = T.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool"))
    now = calls.agg(F.max("at")).first()[0]
    return alerts.agent_activity(calls, now, window_ms=600_000 * 50)[0].withColumnRenamed("at", "at_ms").select("session", "at_ms", "seq", "tool")


@query("""with spans as (select o_orderpriority as name, o_totalprice as taken from orders) select name, count(*) as runs, quantile_cont(taken, 0.5) as median, quantile_cont(taken, 0.95) as p95 from spans group by name""")
def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and 95th percentiles by name, as a bench reports them."""
    return views.timings(T.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("taken")))
