"""The keyed merge of usage rows: idempotent, counters by maximum, identity by first writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlark.functions.models import PLACEHOLDER
from meterlark.schema import TOO_LARGE

COUNTERS = ("inp", "outp", "cr", "cc", "e5", "e1", "tier")
COLUMNS = ("key", "acct", "ts", "model", *COUNTERS)


def storable(rows: DataFrame) -> DataFrame:
    """Rows whose counts and time are whole numbers that can be stored."""
    fits = lambda c: (F.col(c) >= 0) & (F.col(c) < TOO_LARGE)
    good = F.col("key").isNotNull() & F.col("acct").isNotNull() & F.col("ts").isNotNull() & F.col("model").isNotNull() & F.col("tier").isNotNull()
    for c in ("ts", "inp", "outp", "cr", "cc"):
        good = good & fits(c)
    for c in ("e5", "e1"):
        good = good & (F.col(c).isNull() | fits(c))
    return rows.where(good)


def merged(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per key: the field-wise maximum of counts (null only if all are), and account, time and model of the first row.

    First means least by `order`, then account, time, model.  A placeholder model yields to the first real one.
    Counters stay in hash aggregation of fixed-width values; identity travels as one ordered struct.
    """
    first = F.struct(*([order.alias("_o")] if order is not None else []), "acct", "ts", "model")
    out = rows.groupBy("key").agg(F.min(first).alias("_first"), F.min(F.when(F.col("model") != PLACEHOLDER, first)).alias("_real"), *(F.max(c).alias(c) for c in COUNTERS))
    return out.select("key", F.col("_first.acct").alias("acct"), F.col("_first.ts").alias("ts"), F.coalesce("_real.model", F.lit(PLACEHOLDER)).alias("model"), *COUNTERS)


def upserted(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows with incoming ones merged in: stored rows come first, so their account, time and real model stay."""
    both = stored.select(*COLUMNS, F.lit(0).alias("_from")).unionByName(incoming.select(*COLUMNS, F.lit(1).alias("_from")))
    return merged(both, F.col("_from"))


def changed_keys(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming keys that are new or raise something of the stored row (a no-op merge changes nothing)."""
    old, new = stored.select(*(F.col(c).alias(f"_{c}") for c in COLUMNS)), merged(incoming)
    raises = F.col("_key").isNull() | ((F.col("_model") == PLACEHOLDER) & (F.col("model") != PLACEHOLDER))
    for c in COUNTERS:
        raises = raises | F.coalesce(F.col(c) > F.col(f"_{c}"), F.col(c).isNotNull() & F.col(f"_{c}").isNull())
    return new.join(old, F.col("key") == F.col("_key"), "left").where(raises).select("key")


def replaced(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows with counts and tier of incoming ones taken outright; account and time stay, and a real model isn't given up for the placeholder."""
    new = merged(incoming).select(*(F.col(c).alias(f"n_{c}") for c in COLUMNS))
    both = stored.join(new, F.col("key") == F.col("n_key"), "full_outer")
    has = F.col("n_key").isNotNull()
    model = F.when(has & ((F.col("n_model") != PLACEHOLDER) | F.col("model").isNull()), F.col("n_model")).otherwise(F.col("model"))
    return both.select(F.coalesce("key", "n_key").alias("key"), F.coalesce("acct", "n_acct").alias("acct"), F.coalesce("ts", "n_ts").alias("ts"), model.alias("model"), *(F.when(has, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in COUNTERS))


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose key isn't dropped."""
    return rows.join(dropped.select("key").distinct(), "key", "left_anti")


def tombstoned(dropped: DataFrame, more: DataFrame) -> DataFrame:
    """Dropped keys with more of them; of a key's records the first stays."""
    both = dropped.select("key", F.struct(F.lit(0).alias("o"), "at", "reason").alias("x")).unionByName(more.select("key", F.struct(F.lit(1).alias("o"), "at", "reason").alias("x")))
    return both.groupBy("key").agg(F.min("x").alias("x")).select("key", F.col("x.reason").alias("reason"), F.col("x.at").alias("at"))


def written(stored: DataFrame, dropped: DataFrame, *, restore: DataFrame, drop: DataFrame, replace: DataFrame, upsert: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usage, dropped keys) after one batch, in this order: restore keys, drop keys (but none the batch still counts), replace rows, upsert rows."""
    lifted = dropped.join(restore.select("key").distinct(), "key", "left_anti")
    going = drop.join(upsert.select("key").union(replace.select("key")).distinct(), "key", "left_anti")
    marks = tombstoned(lifted, going)
    left = without(stored, going)
    return upserted(replaced(left, without(replace, marks)), without(upsert, marks)), marks


def accounts_interned(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Accounts by provider and identity: an explicit label renames, a derived one only names a new account.

    seen: provider, identity, label, explicit (boolean), seq.  New ids follow the largest stored one, by first sight.
    """
    new = seen.groupBy("provider", "identity").agg(F.max_by("label", F.struct("explicit", "seq")).alias("n_label"), F.max("explicit").alias("explicit"), F.min("seq").alias("seq"))
    # only new accounts are numbered: a handful of a pass, however many are stored
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    fresh = new.join(stored.select("provider", "identity"), ["provider", "identity"], "left_anti").join(last, F.lit(True))
    fresh = fresh.select((F.col("_last") + F.row_number().over(W.orderBy("seq", "provider", "identity"))).cast("int").alias("id"), "provider", "identity", F.col("n_label").alias("label"))
    known = stored.join(new, ["provider", "identity"], "left")
    named = F.when(F.col("label").isNull() | F.coalesce("explicit", F.lit(False)), F.coalesce("n_label", "label")).otherwise(F.col("label"))
    return known.select("id", "provider", "identity", named.alias("label")).unionByName(fresh)


def recovered(usage: DataFrame, copy: DataFrame, dropped: DataFrame, copy_dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union with another copy of a store: its tombstones first, then its rows merged in."""
    marks = tombstoned(dropped, copy_dropped)
    return without(upserted(usage, copy), marks), marks


def plausible(rows: DataFrame, latest_ms: int = 4_102_444_800_000) -> DataFrame:
    """Salvaged rows that can be real: storable and before the year 2100."""
    return storable(rows).where(F.col("ts") <= latest_ms)


def rekeyed(stored: DataFrame, reread: DataFrame, lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usage, report) after an account's rows are read again under another scheme of keys.

    stored: the account's rows under old keys; reread: its rows as read now (merged here); lineage: old_key, new_key of each line read.
    Rows read now take the place of those that their lines made before; rows whose lines can't be read any more stay as they were,
    unless a row read now has their key.
    report: category, old_rows, new_rows, old_tokens, new_tokens.  kept: the same key, alone on both sides; moved: another key, alone on both
    sides; split: one old key has become several; merged: several old keys have become one; unread: no line of it was read, so it
    stays; taken: unread, but its key is now another row's; fresh: read now, from no line stored before.
    """
    new = merged(storable(reread))
    told = lineage.select("old_key", "new_key").where("old_key is not null and new_key is not null").distinct()
    links = links_read(told.join(stored.select(F.col("key").alias("old_key")), "old_key", "left_semi"), new)
    rows = unread(stored, new, links).unionByName(new.select(*COLUMNS))
    same = F.max((F.col("old_key") == F.col("new_key")).cast("int")).alias("_same")
    outs = links.groupBy("old_key").agg(F.count(F.lit(1)).alias("_outs"), same)
    ins = links.groupBy("new_key").agg(F.count(F.lit(1)).alias("_ins"), same)
    of_old = links.join(ins.drop("_same"), "new_key").groupBy("old_key").agg(F.max("_ins").alias("_ins"))
    of_new = links.join(outs.drop("_same"), "old_key").groupBy("new_key").agg(F.max("_outs").alias("_outs"))
    category = F.when(F.col("_outs") > 1, "split").when(F.col("_ins") > 1, "merged").when(F.col("_same") == 1, "kept").when(F.col("_same") == 0, "moved")
    tokens = F.col("inp") + F.col("outp") + F.col("cr") + F.col("cc")
    old_told = stored.join(outs.join(of_old, "old_key").withColumnRenamed("old_key", "key"), "key", "left").join(new.select("key", F.lit(True).alias("_now")), "key", "left")
    old_told = old_told.withColumn("category", F.coalesce(category, F.when(F.col("_now"), "taken").otherwise("unread")))
    new_told = new.join(ins.join(of_new, "new_key").withColumnRenamed("new_key", "key"), "key", "left").withColumn("category", F.coalesce(category, F.lit("fresh")))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    counted = old_told.select("category", one.alias("o"), none.alias("n"), tokens.alias("ot"), none.alias("nt")).unionByName(new_told.select("category", none.alias("o"), one.alias("n"), none.alias("ot"), tokens.alias("nt")))
    report = counted.groupBy("category").agg(F.sum("o").alias("old_rows"), F.sum("n").alias("new_rows"), F.sum("ot").alias("old_tokens"), F.sum("nt").alias("new_tokens"))
    return rows, report


def links_read(lineage: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new keys of the lines whose row is among those read now."""
    links = lineage.select("old_key", "new_key").where("old_key is not null and new_key is not null")
    return links.join(new.select(F.col("key").alias("new_key")), "new_key", "left_semi").select("old_key", "new_key")


def unread(stored: DataFrame, new: DataFrame, links: DataFrame) -> DataFrame:
    """Stored rows that no link leads away from and whose key no row read now has."""
    return stored.select(*COLUMNS).join(links.select(F.col("old_key").alias("key")), "key", "left_anti").join(new.select("key"), "key", "left_anti")
