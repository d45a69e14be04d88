"""Registered queries over what is kept from batch to batch: the bucketed store, its changes by day, its rollup and the log of limit events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.catalog import DAY_SQL, ODD, PRICED, ROLLUP_SQL, ZONE, M, q, query, usage
from meterlark.catalog_limits import AT, EVENTS, windows
from meterlark.operators import limit_events, merge
from meterlark.operators.store import UsageStore
from meterlark.plans import checks
from meterlark.plans.periods import Zone
from meterlark.schema import EVENT_LOG
from meterlark.sources import tables as T
from meterlark.sources.local import estimated_bytes
from meterlark.sources.shared import kept, new_folder, read, removed


def filled(spark: SparkSession, sf_dir: str) -> UsageStore:
    """A store of the line items in three batches, the second of which sends the first's rows once more."""
    store = UsageStore(spark, new_folder(spark, "store"), buckets=8, days=128)
    rows = T.usage_rows(spark, sf_dir)
    for number, part in enumerate(("acct < 3", "acct < 6", "acct >= 5")):
        store.write(rows.where(part), number)
    return store


@query(f"with {T.USAGE_SQL} select * from usage")
def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches merged one after another, each into the buckets of its keys, are the rows merged at once."""
    return filled(spark, sf_dir).usage().drop("bucket")


@query(f"{ROLLUP_SQL} select * from rollup_")
def rollup_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup from the batches' signed sums, the first of them compacted, without looking at the rows again."""
    store = UsageStore(spark, new_folder(spark, "store"), buckets=8, days=128)
    rows = T.usage_rows(spark, sf_dir)
    store.write(rows.where("acct < 3"), 0)
    store.write(rows.where("acct < 6"), 1)
    store.compact()
    store.write(rows.where("acct >= 5"), 2)
    return store.rollup()


@query(f"{PRICED} select model_key, tier, {M} from priced where ts >= {ODD.start} and ts < {ODD.end} group by model_key, tier")
def usage_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By model over a range whose ends are inside days: of the stored changes only the range's periods are read."""
    own = replace(q(spark, sf_dir), usage=filled(spark, sf_dir).between(ODD.start, ODD.end))
    return own.by_model(ODD).drop("share")


@query(f"{EVENTS} select * from limit_events")
def events_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit events from two halves of the captures, the second of which sees the first's stored events alone: the whole history's."""
    rows, log = windows(spark, sf_dir), new_folder(spark, "events")
    limit_events.detect(rows.where(f"at < {AT}")).write.parquet(log)
    found = limit_events.advanced(read(spark, log, EVENT_LOG), rows.where(f"at >= {AT}"))
    return found.withColumnRenamed("window", "win").withColumnRenamed("at", "at_ms")


# --- comparison by causes ----------------------------------------------------------------------------------------------

_PART = f"{DAY_SQL} as day, acct, model_key, tier, inp + outp + cr + cc as t, coalesce(nanos, 0) as n"


@query(f"""{PRICED}, after_ as (select * replace (case when key % 11 = 1 then inp + 10 else inp end as inp, case when key % 13 = 2 then (acct + 1) % 8 else acct end as acct, case when model_key = 'model-22' then nanos * 2 else nanos end as nanos) from priced where key % 7 <> 0),
a as (select key, {_PART} from priced), b as (select key, {_PART} from after_), parts as (
  select 'file_gone' as cause, day, acct, model_key, tier, -t as t, -n as n, -1 as r from a where key % 21 = 0
  union all select 'replayed', day, acct, model_key, tier, -t, -n, -1 from a where key % 7 = 0 and key % 3 = 1
  union all select 'row_gone', day, acct, model_key, tier, -t, -n, -1 from a where key % 7 = 0 and key % 3 = 2
  union all select 'moved', day, acct, model_key, tier, -t, -n, -1 from a where key % 7 <> 0 and key % 13 = 2
  union all select 'moved', day, acct, model_key, tier, t, n, 1 from b where key % 13 = 2
  union all select case when key % 11 = 1 then 'counts' else 'price' end, b.day, b.acct, b.model_key, b.tier, b.t - a.t, b.n - a.n, 0 from a join b using (key) where key % 13 <> 2 and (key % 11 = 1 or a.n <> b.n))
select day, acct, model_key, tier, cause, sum(t)::bigint as tokens, sum(n)::double as nanos, sum(r)::bigint as rows from parts group by all""")
def parity_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores cell by cell and cause by cause: rows gone with their file, as retold heads or for no known reason, moved, recounted, repriced."""
    before = q(spark, sf_dir).within(None)
    changed = {
        "inp": F.when(F.col("key") % 11 == 1, F.col("inp") + 10).otherwise(F.col("inp")), "acct": F.when(F.col("key") % 13 == 2, (F.col("acct") + 1) % 8).otherwise(F.col("acct")),
        "nanos": F.when(F.col("model_key") == "model-22", F.col("nanos") * 2).otherwise(F.col("nanos")),
    }
    after = before.where("key % 7 != 0").withColumns(changed)
    out = checks.causes(before, after, Zone(ZONE), files_gone=before.where("key % 21 = 0").select("key"), replayed=before.where("key % 7 = 0 and key % 3 = 1").select("key"))
    return out.withColumn("nanos", F.col("nanos").cast("double"))


# --- another scheme of keys ----------------------------------------------------------------------------------------------

#: What becomes of a stored key k: every tenth isn't read again; the others stay, move, meet in fours or split in two.
REKEYED_SQL = f"""with {T.USAGE_SQL}, read_ as (select * from usage where key // 10 % 10 <> 9),
links as (select key as old_key, case key // 10 % 4 when 0 then key when 1 then key + 1000000000000 when 2 then 2000000000000 + key // 40 else 3000000000000 + key * 2 end as new_key, 1 as share, * exclude (key) from read_
  union all select key, 3000000000001 + key * 2, 0, * exclude (key) from read_ where key // 10 % 4 = 3),
rows_ as (select new_key as key, acct, ts, model, case when share = 1 then inp else 0 end as inp, outp, cr, cc, e5, e1, tier from links),
now_ as (select key, min({{'acct': acct, 'ts': ts, 'model': model}}) as f, max(inp) as inp, max(outp) as outp, max(cr) as cr, max(cc) as cc, max(e5) as e5, max(e1) as e1, max(tier) as tier from rows_ group by key)"""


#: Shares of keys in which a store is re-keyed at most, and bytes of line items for each.
SHARES, SHARE_BYTES = 4, 32 << 20


def _reread(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows read again, lineage)."""
    k, scheme = F.col("key"), F.expr("key div 10 % 4")
    to = F.when(scheme == 0, F.array(k)).when(scheme == 1, F.array(k + 1_000_000_000_000)).when(scheme == 2, F.array(F.expr("2000000000000 + key div 40"))).otherwise(F.array(3_000_000_000_000 + k * 2, 3_000_000_000_001 + k * 2))
    lines = stored.where("key div 10 % 10 != 9").select("*", F.posexplode(to).alias("_n", "_new"))
    rows = lines.withColumn("inp", F.when(F.col("_n") == 0, F.col("inp")).otherwise(F.lit(0).cast("long"))).withColumn("key", F.col("_new")).select(*merge.COLUMNS)
    return rows, lines.select(k.alias("old_key"), F.col("_new").alias("new_key"))


@query(f"""{REKEYED_SQL} select key, f.acct as acct, f.ts as ts, f.model as model, {", ".join(merge.COUNTERS)} from now_ union all select key, acct, ts, model, {", ".join(merge.COUNTERS)} from usage where key // 10 % 10 = 9""")
def rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage after all lines but a tenth are read again under another scheme of keys; each step is stored by shares of the keys."""
    shares = min(SHARES, 1 + estimated_bytes(T.table(spark, sf_dir, "lineitem")) // SHARE_BYTES)
    before, met = new_folder(spark, "usage"), new_folder(spark, "links")
    stored = kept(usage(spark, sf_dir), "key", shares, before)
    reread, lineage = _reread(stored)
    new = kept(merge.merged(merge.storable(reread)), "key", shares, new_folder(spark, "reread"))
    links = kept(merge.links_read(lineage, new), "new_key", shares, met)
    rows = new.unionByName(kept(merge.unread(stored, new, links), "key", shares, new_folder(spark, "unread")))
    removed(spark, before)
    removed(spark, met)
    return rows


@query(f"""{REKEYED_SQL}, met as (select new_key, count(*) as m from links group by new_key),
olds as (select old_key as key, case when count(*) > 1 then 'split' when max(m) > 1 then 'merged' when max(old_key) = max(new_key) then 'kept' else 'moved' end as category from links join met using (new_key) group by old_key),
both_ as (select coalesce(category, 'unread') as category, 1 as o, 0 as n, inp + outp + cr + cc as ot, 0 as nt from usage left join olds using (key)
  union all select case when key >= 3000000000000 then 'split' when m > 1 then 'merged' when key < 1000000000000 then 'kept' else 'moved' end, 0, 1, 0, inp + outp + cr + cc from now_ join met on new_key = key)
select category, sum(o)::bigint as old_rows, sum(n)::bigint as new_rows, sum(ot)::bigint as old_tokens, sum(nt)::bigint as new_tokens from both_ group by category""")
def rekeyed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the stored rows: kept, moved, merged, split or not read again."""
    stored = usage(spark, sf_dir)
    return merge.rekeyed(stored, *_reread(stored))[1]
