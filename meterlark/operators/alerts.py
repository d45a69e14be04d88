"""Alerts on limit windows: what they watch, when they fire, what they say, and when they lapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.functions.limits import compact, percent
from meterlark.operators.limit_events import SAME_INSTANCE_MS, WEEK_MS

FIVE_HOURS_S, WEEK_S = 5 * 3600, WEEK_MS // 1000
STALE_MS = 2 * 60_000
SESSION_MS = 24 * 3_600_000
EPSILON = 1e-9


def watches(window: Column, scope: Column, window_s: Column) -> Column:
    """`any`; `5h` and `weekly` the account-wide ones; `weekly_scoped` a model's own weekly one."""
    hours, week = F.coalesce(window_s == FIVE_HOURS_S, F.lit(False)), F.coalesce(window_s == WEEK_S, F.lit(False))
    return F.when(window == "any", True).when(window == "5h", scope.isNull() & hours).when(window == "weekly", scope.isNull() & week).otherwise(scope.isNotNull() & week)


def watched(alerts: DataFrame, windows: DataFrame, deliveries: DataFrame, now: int) -> DataFrame:
    """Every window an alert watches with its status: alert_id, kind, status (`armed`, `fired`), fired_at, fires.

    alerts: alert_id, members (identities of its account now), provider, window, threshold (percent), note, label.
    windows: identity, at, kind, label, scope, utilization, resets_at, window_s; of an account's roots the freshest capture
    counts.  deliveries: alert_id, kind, resets_at, at, on_set; one within 15 minutes of the reset is this instance's.
    """
    each = alerts.select("*", F.explode("members").alias("_member")).withColumnRenamed("label", "account")
    rows = each.join(windows.withColumnRenamed("label", "window_label").drop("provider"), F.col("_member") == F.col("identity"))
    newest = rows.groupBy("alert_id").agg(F.max(F.struct("at", "identity")).alias("_n"))
    rows = rows.join(newest, "alert_id").where("identity = _n.identity").drop("_n", "_member", "members")
    rows = rows.where(watches(F.col("window"), F.col("scope"), F.col("window_s"))).withColumn("utilization", F.when(F.col("resets_at") > now, F.col("utilization")).otherwise(0.0))
    done = deliveries.select(F.col("alert_id").alias("_a"), F.col("kind").alias("_k"), F.col("resets_at").alias("_r"), F.col("at").alias("_at"))
    met = rows.join(done, (F.col("alert_id") == F.col("_a")) & (F.col("kind") == F.col("_k")) & (F.abs(F.col("resets_at") - F.col("_r")) < SAME_INSTANCE_MS) & (F.col("resets_at") > now), "left")
    met = met.groupBy(*rows.columns).agg(F.min("_at").alias("fired_at"))
    over = (F.col("resets_at") > now) & (F.col("utilization") * 100 >= F.col("threshold") - EPSILON)
    return met.withColumn("status", F.when(F.col("fired_at").isNull(), "armed").otherwise("fired")).withColumn("fires", F.col("fired_at").isNull() & over)


def message(now: int) -> Column:
    """The line an agent reads when an alert fires."""
    name = F.when(F.col("scope").isNull() & (F.col("window_s") == FIVE_HOURS_S), "5-hour limit").when(F.col("scope").isNull() & (F.col("window_s") == WEEK_S), "weekly limit").otherwise(F.concat("window_label", F.lit(" limit")))
    stale = F.when(F.lit(now) - F.col("at") > STALE_MS, F.concat(F.lit(" (limits as of "), compact(F.lit(now) - F.col("at")), F.lit(" ago)"))).otherwise("")
    note = F.when(F.col("note").isNull(), "").otherwise(F.concat(F.lit(" Note: "), "note", F.when(F.rlike("note", F.lit("[.!?]$")), "").otherwise(".")))
    return F.concat(F.lit("[alert] "), name, F.lit(" ("), "account", F.lit(") is at "), percent(F.col("utilization")), F.lit(" (alert at "), F.col("threshold").cast("string"), F.lit("%), resets in "), compact(F.col("resets_at") - now), stale, F.lit("."), note, F.lit(" Call should_wait before long tasks."))


def firing(alerts: DataFrame, windows: DataFrame, deliveries: DataFrame, now: int) -> DataFrame:
    """Alerts that fire now, once per window instance, with their message; to be recorded as deliveries."""
    return watched(alerts, windows, deliveries, now).where("fires").select("alert_id", "kind", "resets_at", F.lit(now).cast("long").alias("at"), message(now).alias("message"))


def set_over_line(alerts: DataFrame, windows: DataFrame, deliveries: DataFrame, now: int) -> DataFrame:
    """Deliveries to record when alerts are set: windows already over the line don't fire for this instance."""
    return watched(alerts, windows, deliveries, now).where("fires").select("alert_id", "kind", "resets_at", F.lit(now).cast("long").alias("at"), F.lit(True).alias("on_set"))


def statuses(alerts: DataFrame, windows: DataFrame, deliveries: DataFrame, now: int) -> DataFrame:
    """alert_id, status and fired_at: fired when every watched window has fired for its instance; without windows, armed."""
    by = watched(alerts, windows, deliveries, now).groupBy("alert_id").agg(F.bool_and(F.col("status") == "fired").alias("_all"), F.max("fired_at").alias("_at"))
    return alerts.select("alert_id").join(by, "alert_id", "left").select("alert_id", F.when(F.col("_all"), "fired").otherwise("armed").alias("status"), F.when(F.col("_all"), F.col("_at")).alias("fired_at"))


def last_fired(deliveries: DataFrame) -> DataFrame:
    return deliveries.where("not coalesce(on_set, false)").groupBy("alert_id").agg(F.max("at").alias("last_fired"))


def session_activity(*sources: DataFrame) -> DataFrame:
    """When each session was last active, over several tables of (session, at)."""
    out = sources[0].select("session", "at")
    for more in sources[1:]:
        out = out.unionByName(more.select("session", "at"))
    return out.where("session is not null and at is not null").groupBy("session").agg(F.max("at").alias("at"))


def pruned(alerts: DataFrame, deliveries: DataFrame, activity: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(alerts, deliveries) less session alerts quiet for a day and deliveries of instances long reset."""
    seen = alerts.join(activity.select("session", F.col("at").alias("_at")), "session", "left")
    left = seen.where(F.col("session").isNull() | (F.lit(now) - F.greatest("created_at", F.coalesce("_at", F.lit(0))) <= SESSION_MS)).select(*alerts.columns)
    return left, deliveries.where(F.col("resets_at") + SAME_INSTANCE_MS >= now).join(left.select("alert_id"), "alert_id", "left_semi")


def agent_activity(calls: DataFrame, now: int, window_ms: int = 600_000, shown: int = 20) -> tuple[DataFrame, DataFrame]:
    """(each session's latest call of the last ten minutes, later ones winning ties; the newest calls of all)."""
    recent = calls.where(F.lit(now) - F.col("at") <= window_ms)
    rest = [c for c in calls.columns if c != "session"]
    latest = recent.groupBy("session").agg(F.max_by(F.struct(*rest), F.struct("at", "seq")).alias("c")).select("session", "c.*").orderBy(F.desc("at"), "session")
    return latest, recent.orderBy(F.desc("at"), F.desc("seq")).limit(shown)
