"""Usage facts, accounts and rates made from the driver's tables, and the same as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.sources.local import local_table
from meterlark.sources.rates import RateTable, periods_of

PROVIDERS = ("claude", "codex")
N_ACCOUNTS = 9  # one of them never used


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as usage events; keys repeat, so that they need merging."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    name = F.concat(F.lit("model-"), F.expr("substring(p_brand, 7)"))
    spelled = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.upper(name), F.lit("-20250101"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("anthropic/"), name)).otherwise(F.concat(name, F.lit("[1m]")))
    cc = F.col("l_partkey") % 5000
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"),
        (F.col("l_suppkey") % 8).cast("int").alias("acct"),
        (F.unix_millis(F.col("l_shipdate").cast("timestamp")) + (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729) % 86400 * 1000).alias("ts"),
        spelled.alias("model"),
        (F.col("l_quantity") * 100).cast("long").alias("inp"),
        F.floor(F.col("l_extendedprice") / 10).cast("long").alias("outp"),
        F.floor(F.col("l_extendedprice") * F.col("l_quantity")).cast("long").alias("cr"),
        cc.alias("cc"),
        F.when(F.col("l_returnflag") == "A", None).when(F.col("l_returnflag") == "R", cc).otherwise(F.floor(cc / 2)).cast("long").alias("e5"),
        F.when(F.col("l_returnflag").isin("A", "R"), None).otherwise(cc - F.floor(cc / 2)).cast("long").alias("e1"),
        (F.col("l_linestatus") == "F").cast("int").alias("tier"),
    )


USAGE_ROWS_SQL = """
usage_rows as (
  select l_orderkey * 10 + l_linenumber as key, (l_suppkey % 8)::int as acct,
         epoch_ms(l_shipdate) + (l_orderkey * 7919 + l_partkey * 104729) % 86400 * 1000 as ts,
         case l_linenumber % 3 when 0 then upper('model-' || substring(p_brand, 7)) || '-20250101' when 1 then 'anthropic/model-' || substring(p_brand, 7) else 'model-' || substring(p_brand, 7) || '[1m]' end as model,
         (l_quantity * 100)::bigint as inp, floor(l_extendedprice / 10)::bigint as outp, floor(l_extendedprice * l_quantity)::bigint as cr, l_partkey % 5000 as cc,
         case when l_returnflag = 'A' then null when l_returnflag = 'R' then l_partkey % 5000 else (l_partkey % 5000) // 2 end as e5,
         case when l_returnflag in ('A', 'R') then null else l_partkey % 5000 - (l_partkey % 5000) // 2 end as e1,
         case when l_linestatus = 'F' then 1 else 0 end as tier
  from lineitem join part on l_partkey = p_partkey)
"""

#: Struct members are picked by name, which both engines do.
USAGE_SQL = USAGE_ROWS_SQL + """,
usage_first as (
  select key, min({'acct': acct, 'ts': ts, 'model': model}) as f, max(inp) as inp, max(outp) as outp, max(cr) as cr, max(cc) as cc, max(e5) as e5, max(e1) as e1, max(tier) as tier from usage_rows group by key),
usage as (select key, f.acct as acct, f.ts as ts, f.model as model, inp, outp, cr, cc, e5, e1, tier from usage_first)
"""


def accounts(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(i, PROVIDERS[i % 2], f"identity-{i}", f"Account {i}") for i in range(N_ACCOUNTS)], "id int, provider string, identity string, label string")


ACCOUNTS_SQL = "accounts as (select i::int as id, case i % 2 when 0 then 'claude' else 'codex' end as provider, 'identity-' || i as identity, 'Account ' || i as label from range(9) t(i))"


def rate_table() -> RateTable:
    """Cards by rule for models 11 to 55: dated, fast, long-context, cache rates, one estimated, some missing."""
    models = {}
    for x in range(1, 6):
        for y in range(1, 6):
            if (x, y) in ((4, 4), (5, 5), (5, 1)):
                continue
            card = {"input": x + y / 4, "output": 5 * (x + y / 4)}
            if y % 2 == 0:
                card["cache_read"] = card["input"] * 0.08
            if x == 5:
                card["cache_write"] = card["input"] * 1.1
            if y == 3:
                card |= {"long_context_threshold": 1_000_000, "long_context_input_multiplier": 2, "long_context_output_multiplier": 1.5, "long_context_counts_cache_writes": x % 2 == 0}
            if x <= 3:
                card["fast"] = {"input": card["input"] * 6, "output": card["output"] * 6} | ({} if x == 2 else {"long_context_input_multiplier": 2, "long_context_output_multiplier": 1.5})
            periods = [{"from": "1996-01-01T00:00:00Z" if y == 2 else None, "card": card}]
            if y == 1:
                periods.append({"from": "1998-01-01T05:30:00Z", "card": card | {"input": card["input"] / 2, "output": card["output"] / 2}})
            models[f"model-{x}{y}"] = periods_of({"periods": periods}, f"model-{x}{y}")
    return RateTable(models, {"model-51": [(0, "model-31"), (915_148_800_000, "model-41")]})


def rates(spark: SparkSession) -> DataFrame:
    return rate_table().dimension(spark)


def _literal(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return f"{x!r}::double"
    return f"'{x}'" if isinstance(x, str) else f"{x}::bigint"


def rates_sql() -> str:
    rows = ",\n  ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rate_table().rows())
    return f"""rates(model_key, rtier, from_ms, to_ms, rstatus, input, output, cache_read, cache_write, lc_threshold, lc_in_mult, lc_out_mult, lc_counts_cw, lc_unpriced, estimated) as (values
  {rows})"""


def priced_sql(usage_sql: str = USAGE_SQL) -> str:
    """usage, rates and priced (one row per usage row) as common table expressions."""
    return usage_sql + ", " + rates_sql() + """,
keyed as (select *, regexp_replace(regexp_replace(regexp_replace(replace(lower(model), '[1m]', ''), '^anthropic/', ''), '-[0-9]{4}-[0-9]{2}-[0-9]{2}$', ''), '-[0-9]{6,8}$', '') as mkey from usage),
joined as (select k.*, r.*, coalesce(inp + cr + case when lc_counts_cw then cc else 0 end > lc_threshold, false) as is_long
           from keyed k left join rates r on k.mkey = r.model_key and least(k.tier, 1) = r.rtier and k.ts >= r.from_ms and k.ts < r.to_ms),
multiplied as (select *, case when is_long then coalesce(lc_in_mult, 1::double) else 1::double end as im, case when is_long then coalesce(lc_out_mult, 1::double) else 1::double end as om,
               case when rstatus is null then 'unpriced' when rstatus = 'priced' and is_long and lc_unpriced then 'unpriced-tier' else rstatus end as price_status from joined),
costed as (select *, inp * (input * im / 1e6::double) + outp * (output * om / 1e6::double) + cr * (case when cache_read is not null then cache_read * im else input * im * 0.1::double end) / 1e6::double as base from multiplied),
priced as (select key, acct, ts, model, inp, outp, cr, cc, e5, e1, least(tier, 1)::int as tier, mkey as model_key, price_status, is_long, coalesce(estimated, false) as is_estimated, inp + outp + cr + cc as tokens,
  case when price_status = 'priced' then floor((case when cache_write is not null then base + cc * cache_write * im / 1e6::double
    when e5 is null and e1 is null then base + cc * (input * im / 1e6::double) * 1.25::double
    else base + coalesce(e5, 0) * (input * im / 1e6::double) * 1.25::double + coalesce(e1, 0) * (input * im / 1e6::double) * 2::double end) * 1e9::double + 0.5::double)::hugeint end as nanos from costed)
"""


#: Measures and shown columns over `priced` (or another table of its columns), as SQL.
MEASURES_SQL = """coalesce(sum(inp), 0)::bigint as input, coalesce(sum(outp), 0)::bigint as output, coalesce(sum(cr), 0)::bigint as cache_read, coalesce(sum(cc), 0)::bigint as cache_write,
  coalesce(sum(tokens), 0)::bigint as tokens, count(key)::bigint as records, floor(coalesce(sum(nanos), 0)::double / 1e9::double * 1e6::double + 0.5::double) / 1e6::double as cost,
  coalesce(sum(case when price_status = 'priced' then tokens end), 0)::bigint as priced_tokens, coalesce(sum(case when price_status = 'unpriced' then tokens end), 0)::bigint as unpriced_tokens,
  coalesce(sum(case when price_status = 'unpriced-tier' then tokens end), 0)::bigint as unpriced_tier_tokens,
  floor(coalesce(sum(case when is_estimated and price_status = 'priced' then nanos end), 0)::double / 1e9::double * 1e6::double + 0.5::double) / 1e6::double as est_cost,
  coalesce(sum(case when is_estimated and price_status = 'priced' then tokens end), 0)::bigint as est_tokens,
  case when coalesce(sum(tokens), 0) = 0 then 1::double else coalesce(sum(case when price_status = 'priced' then tokens end), 0)::double / sum(tokens)::double end as priced_share,
  case when sum(case when price_status = 'unpriced' then tokens end) > 0 then 'unpriced'
       when sum(case when price_status = 'unpriced-tier' then tokens end) >= sum(tokens) and sum(tokens) > 0 then 'unpriced-tier'
       when sum(case when price_status = 'unpriced-tier' then tokens end) > 0 then 'partial' else 'priced' end as status"""


# --- captures of limits, and usage of the same days --------------------------------------------------------------------


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage rows of the nine accounts."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("key"), (F.col("user_id") % N_ACCOUNTS).cast("int").alias("acct"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("model-"), e % 3 + 1, e % 4 + 2).alias("model"),
        (e * 7919 % 50000).alias("inp"), (e * 104729 % 3000).alias("outp"), (e * 31 % 90000).alias("cr"), F.lit(0).cast("long").alias("cc"), F.lit(None).cast("long").alias("e5"), F.lit(None).cast("long").alias("e1"), F.lit(0).alias("tier"),
    )


USAGE_EVENTS_SQL = """usage as (
  select event_id as key, (user_id % 9)::int as acct, epoch_us(ts) // 1000 as ts, 'model-' || (event_id % 3 + 1) || (event_id % 4 + 2) as model, event_id * 7919 % 50000 as inp, event_id * 104729 % 3000 as outp, event_id * 31 % 90000 as cr, 0::bigint as cc, null::bigint as e5, null::bigint as e1, 0 as tier from events)"""

#: (provider's remainder, kind, label, stated minutes, used percent, length in ms) of the windows made from events.
WINDOW_RULES = (
    (0, "five_hour", None, None, "event_id * 37 % 130", 18_000_000), (0, "weekly_all", "WEEKLY", None, "event_id * 13 % 112", 604_800_000), (0, "weekly_scoped", "MODEL-11 WEEKLY", None, "event_id * 7 % 95", 604_800_000),
    (1, "codex_primary", None, 300, "event_id * 41 % 125", 18_000_000), (1, "codex_secondary", None, 10_080, "event_id * 17 % 108", 604_800_000), (1, "sol_primary", "GPT SOL 5-HOUR", 300, "event_id * 11 % 105", 18_000_000),
)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as limit captures, three windows each; resets jitter as providers' do."""
    rows = table(spark, sf_dir, "events").withColumn("_a", F.col("user_id") % N_ACCOUNTS).withColumn("_at", F.unix_millis(F.col("ts").cast("timestamp")))

    def limits(side: int):
        parts = []
        for own, kind, label, minutes, used, length in WINDOW_RULES:
            if own == side:
                resets = (F.floor(F.col("_at") / length) + 1) * length + F.col("event_id") % 3 * 200
                parts += [F.lit(kind), F.struct(F.lit(label).cast("string").alias("label"), F.expr(used).cast("double").alias("used_percentage"), (resets / 1000).alias("resets_at"), F.lit(minutes).cast("double").alias("window_minutes"))]
        return F.create_map(*parts)

    side = F.col("_a") % 2
    return rows.select(F.concat(F.lit("identity-"), "_a").alias("identity"), F.when(side == 0, PROVIDERS[0]).otherwise(PROVIDERS[1]).alias("provider"), (F.col("_at") / 1000).alias("captured_at"), F.lit("api").alias("via"), F.when(side == 0, limits(0)).otherwise(limits(1)).alias("rate_limits"), F.col("event_id").alias("seq"))


def windows_sql() -> str:
    """windows: what operators.windows.windows makes of captures."""
    shown = {"five_hour": ("5-HOUR", None), "weekly_all": ("WEEKLY", None), "weekly_scoped": ("MODEL-11 WEEKLY", "MODEL-11"), "codex_primary": ("5-HOUR", None), "codex_secondary": ("WEEKLY", None), "sol_primary": ("GPT SOL 5-HOUR", "GPT SOL")}
    parts = []
    for own, kind, _, _, used, length in WINDOW_RULES:
        label, scope = shown[kind]
        parts.append(f"select event_id as seq, 'identity-' || (user_id % 9) as identity, '{PROVIDERS[own]}' as provider, epoch_us(ts) // 1000 as at_ms, '{kind}' as kind, '{label}' as label, ({used})::double / 100 as utilization, (epoch_us(ts) // 1000 // {length} + 1) * {length} + event_id % 3 * 200 as resets_at, {length // 60_000}::double as minutes, {_literal(scope)}::varchar as scope from events where user_id % 9 % 2 = {own}")
    return "windows as (" + " union all ".join(parts) + ")"
