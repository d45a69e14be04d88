"""Limit events: windows reached, passed 80 % and resumed, once per window instance, from a history of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlark.functions.limits import WEEK_MINUTES
from meterlark.schema import DAY_MS

#: Resets closer than this are one window instance; what counts as passed; how long a week's slot reaches.
SAME_INSTANCE_MS = 15 * 60_000
PASSED = 0.8
WEEK_MS = 7 * DAY_MS


def instances(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with `instance`: a running number of resets at least 15 minutes apart, per keys.

    rows must be few per key and reset time: group by reset time first, so that a hot account doesn't reach the window whole.
    """
    own = W.partitionBy(*keys).orderBy("resets_at")
    new = F.coalesce(F.col("resets_at") - F.lag("resets_at").over(own) >= SAME_INSTANCE_MS, F.lit(True))
    return rows.withColumn("_new", new.cast("int")).withColumn("instance", F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def first_of_instance(rows: DataFrame, *keys: str) -> DataFrame:
    """The earliest row (at, then resets_at) of each window instance."""
    small = rows.groupBy(*keys, "resets_at").agg(F.min(F.struct("at", "label")).alias("_f"))
    return instances(small, *keys).groupBy(*keys, "instance").agg(F.min(F.struct("_f.at", "resets_at", "_f.label")).alias("_e")).select(*keys, "_e.label", "_e.resets_at", "_e.at")


def detect(windows: DataFrame) -> DataFrame:
    """Events of a history of windows: identity, event, window, label, resets_at, at, resumed_at.

    reached: at 100 %; passed_80: a weekly window at 80 %; resumed: the first capture below 100 % at or after the reset of
    a reached instance.  Each once per instance.  A capture at or after its own window's reset decides nothing.
    """
    live = windows.where("at < resets_at").withColumnRenamed("kind", "window")
    hit = live.where("utilization >= 1").withColumn("event", F.lit("reached"))
    passed = live.where((F.col("utilization") >= PASSED) & (F.col("minutes") == WEEK_MINUTES)).withColumn("event", F.lit("passed_80"))
    found = first_of_instance(hit.unionByName(passed), "identity", "event", "window")
    reached = found.where("event = 'reached'").drop("event").withColumn("day", F.floor(F.col("resets_at") / DAY_MS).cast("long"))
    calm = live.where("utilization < 1").select("identity", "window", F.floor(F.col("at") / DAY_MS).cast("long").alias("day"), F.struct("at", "resets_at", "label").alias("c"))

    # The first calm capture at or after the reset: within the reset's own day by a join, on later days by the days' firsts.
    same_day = reached.select("identity", "window", "day", "resets_at").join(calm, ["identity", "window", "day"]).where("c.at >= resets_at").groupBy("identity", "window", "resets_at").agg(F.min("c").alias("_same"))
    daily = calm.groupBy("identity", "window", "day").agg(F.min("c").alias("_c"))
    after = W.partitionBy("identity", "window").orderBy("day").rangeBetween(1, W.unboundedFollowing)
    asked = reached.select("identity", "window", "day").distinct()
    later = daily.unionByName(asked.withColumn("_c", F.lit(None).cast(daily.schema["_c"].dataType)))
    later = later.withColumn("_later", F.min("_c").over(after)).groupBy("identity", "window", "day").agg(F.first("_later", ignorenulls=True).alias("_later"))
    closed = reached.join(same_day, ["identity", "window", "resets_at"], "left").join(later, ["identity", "window", "day"], "left").withColumn("_by", F.coalesce("_same", "_later"))
    resumed = first_of_instance(closed.where("_by is not null").select("identity", "window", "_by.*"), "identity", "window")
    none = F.lit(None).cast("long")
    columns = ["identity", "event", "window", "label", "resets_at", "at", "resumed_at"]
    return (
        closed.select("identity", F.lit("reached").alias("event"), "window", "label", "resets_at", "at", F.col("_by.at").alias("resumed_at")).select(*columns)
        .unionByName(found.where("event != 'reached'").withColumn("resumed_at", none).select(*columns))
        .unionByName(resumed.withColumn("event", F.lit("resumed")).withColumn("resumed_at", none).select(*columns))
    )


def recorded(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored events with found ones added: none of an instance that is stored already; resumed_at is set once."""
    keys = ["identity", "event", "window"]
    both = stored.select(*keys, "label", "resets_at", "at", "resumed_at", F.lit(0).alias("_n")).unionByName(found.select(*keys, "label", "resets_at", "at", "resumed_at", F.lit(1).alias("_n")))
    small = both.groupBy(*keys, "resets_at").agg(F.min(F.struct("_n", "at", "label")).alias("_f"), F.min(F.when(F.col("resumed_at").isNotNull(), F.struct("_n", "at", "resumed_at"))).alias("_r"))
    out = instances(small, *keys).groupBy(*keys, "instance").agg(F.min(F.struct("_f._n", "_f.at", "resets_at", "_f.label")).alias("e"), F.min("_r").alias("r"))
    return out.select(*keys, "e.label", "e.resets_at", "e.at", F.col("r.resumed_at").alias("resumed_at"))


def advanced(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored events after new captures' windows (none older than those looked at before): the history itself isn't read again.

    What is carried is the stored events.  Reached ones that nothing has closed yet take part as the captures they were found by, so that a
    new capture can close them; new captures of an instance that is closed already decide nothing about its limit.
    """
    reached = stored.where("event = 'reached'")
    none = {c: F.lit(None).cast(t) for c, t in fresh.dtypes if c not in ("identity", "kind", "label", "at", "resets_at", "utilization")}
    carried = reached.where("resumed_at is null").select("identity", F.col("window").alias("kind"), "label", "at", "resets_at", F.lit(1.0).alias("utilization")).withColumns(none)
    # neighbours within one instance's span are found by slots of that span: an equality join, whatever an account's share of all rows
    slot = F.floor(F.col("resets_at") / SAME_INSTANCE_MS)
    closed = reached.where("resumed_at is not null").select(F.col("identity").alias("_i"), F.col("window").alias("_w"), F.col("resets_at").alias("_r"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("_s"))
    over = (F.col("utilization") >= 1) & (F.col("identity") == F.col("_i")) & (F.col("kind") == F.col("_w")) & (slot == F.col("_s")) & (F.abs(F.col("resets_at") - F.col("_r")) < SAME_INSTANCE_MS)
    late = fresh.where("utilization >= 1").join(closed, over, "left_anti")
    return recorded(stored, detect(fresh.where("utilization is null or utilization < 1").unionByName(late).unionByName(carried)))


def deduped(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events of accounts that are one (members: identity, group) shown once per instance, with the first resume any of them has."""
    rows = events.join(members, "identity", "left")
    alone = rows.where(F.col("group").isNull()).drop("group")
    keys = ["group", "event", "window"]
    small = rows.where(F.col("group").isNotNull()).groupBy(*keys, "resets_at").agg(F.min(F.struct("at", "identity", "label")).alias("_f"), F.min(F.when(F.col("resumed_at").isNotNull(), F.struct("at", "resumed_at"))).alias("_r"))
    one = instances(small, *keys).groupBy(*keys, "instance").agg(F.min(F.struct("_f.at", "_f.identity", "resets_at", "_f.label")).alias("e"), F.min("_r").alias("r"))
    return alone.unionByName(one.select("e.identity", "event", "window", "e.label", "e.resets_at", "e.at", F.col("r.resumed_at").alias("resumed_at")).select(*alone.columns))


def within(events: DataFrame, accounts: DataFrame, start: int, end: int) -> DataFrame:
    """Events of [start, end) with their account, oldest first."""
    return events.where((F.col("at") >= start) & (F.col("at") < end)).join(accounts.select("identity", "provider", F.col("label").alias("account")), "identity").orderBy("at", "identity", "event", "window")


def listed(events: DataFrame) -> DataFrame:
    """What a list shows: not the resumed events that a reached one already tells; reached ones first, each newest first."""
    closed = events.where("event = 'reached' and resumed_at is not null").select("identity", "window", F.col("resumed_at").alias("at"), F.lit("resumed").alias("event")).distinct()
    return events.join(closed, ["identity", "window", "at", "event"], "left_anti").orderBy(F.col("event") != "reached", F.desc("at"))


def weekly_slots(current: DataFrame, events: DataFrame, now: int, weeks: int = 8) -> DataFrame:
    """The last weeks of each account's weekly window: identity, resets_at, value, source.

    This week's value is the capture's; an earlier week is known only by its events, nearest by reset.
    """
    own = current.where("kind in ('weekly_all', 'seven_day') or (minutes = 10080 and not startswith(kind, 'weekly_scoped') and scope is null)")
    first = F.struct((~F.col("kind").isin("weekly_all", "seven_day")).alias("o"), "rank", "kind", "resets_at", "utilization")
    week = own.groupBy("identity").agg(F.min(first).alias("w")).select("identity", F.col("w.kind").alias("window"), F.col("w.resets_at").alias("_r"), F.col("w.utilization").alias("_u"))
    over = F.when(F.col("_r") <= now, F.floor((F.lit(now) - F.col("_r")) / WEEK_MS) + 1).otherwise(0).cast("long")
    week = week.withColumn("_over", over).withColumn("_r", F.col("_r") + F.col("_over") * WEEK_MS)
    slots = week.select("identity", "window", "_u", "_over", F.explode(F.transform(F.sequence(F.lit(weeks - 1), F.lit(0), F.lit(-1)), lambda k: F.struct(k.alias("k"), (F.col("_r") - k.cast("long") * F.lit(WEEK_MS)).alias("resets_at")))).alias("s")).select("identity", "window", "_u", "_over", "s.k", "s.resets_at")
    # An event belongs to the nearest week, found by arithmetic: no range join.
    told = events.where("event in ('reached', 'passed_80')").select("identity", "window", F.col("resets_at").alias("_at"), "event").join(week.select("identity", "window", "_r"), ["identity", "window"])
    offset = F.floor((F.col("_r") - F.col("_at")) / WEEK_MS + 0.5).cast("long")
    told = told.withColumn("k", offset).where(F.abs(F.col("_r") - F.col("k") * F.lit(WEEK_MS) - F.col("_at")) < WEEK_MS / 2).groupBy("identity", "k").agg(F.max((F.col("event") == "reached").cast("int")).alias("_full"))
    out = slots.join(told, ["identity", "k"], "left")
    value = F.when(F.col("k") == 0, F.when(F.col("_over") == 0, F.col("_u"))).when(F.col("_full") == 1, 1.0).when(F.col("_full") == 0, PASSED)
    source = F.when(F.col("k") == 0, "now").when(F.col("_full") == 1, "reached").when(F.col("_full") == 0, "passed_80")
    return out.select("identity", "resets_at", value.alias("value"), source.alias("source")).orderBy("identity", "resets_at")


def highest(windows: DataFrame, now: int) -> DataFrame:
    """Each account's highest utilisation among running windows; null if none runs."""
    return windows.groupBy("identity").agg(F.max(F.when(F.col("resets_at") > now, F.col("utilization"))).alias("highest"))
