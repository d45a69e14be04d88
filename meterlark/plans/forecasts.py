"""Where limit windows are heading: pace, utilisation per dollar, projected exhaustion, and whether to wait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.functions.cost import tokens
from meterlark.functions.limits import clock, duration, percent, roughly, scope_matches
from meterlark.operators.limit_events import WEEK_MS
from meterlark.schema import HOUR_MS

#: Fixed values of the estimate and of the advice.
PACE_MINUTES = 30
LEAST_SPEND = 0.5
LEAST_AVERAGE_MS = 6 * HOUR_MS
HEADROOM = 0.1
HORIZON_MS = 10 * 60_000
MARGIN_S = 30
STALE_MS = 10 * 60_000
EPSILON = 1e-9
WARNING = 0.8


def _dollars(nanos: Column) -> Column:
    return F.coalesce(nanos, F.lit(0)).cast("double") / F.lit(1e9)


def forecast(windows: DataFrame, members: DataFrame, usage: DataFrame, now: int, *, extra: bool = False) -> DataFrame:
    """Current windows with their pace and projection.

    windows: one capture's windows per account; members: identity to the store accounts (acct) that spend from its limits;
    usage: priced rows.  An account without store accounts has no pace.  One join of usage with the few windows of its
    account, one aggregation of conditional sums: spend since the window began up to the capture, since the capture, in the
    last 30 minutes, and over the instance that runs now.

    utilization is 0 past the reset.  pace: the last 30 minutes, for a window of a week its average since it began (after
    six hours).  projection: `at` (projected_at), `safe`, or null where too little is known.  All are estimates.
    """
    length = (F.col("minutes") * 60_000).cast("long")
    rows = windows.withColumns({
        "_len": length, "utilization": F.when(F.lit(now) >= F.col("resets_at"), 0.0).otherwise(F.col("utilization")),
        "_begin": F.col("resets_at") - length,
    })
    passed = F.when(F.lit(now) >= F.col("resets_at"), F.floor((F.lit(now) - F.col("resets_at")) / F.col("_len")) + 1).otherwise(0)
    rows = rows.withColumn("_start", (F.col("resets_at") + (passed - 1) * F.col("_len")).cast("long"))
    rows = rows.withColumn("_weekly", F.coalesce((F.col("_len") >= WEEK_MS) & (F.lit(now) - F.col("_start") >= LEAST_AVERAGE_MS), F.lit(False)))
    asked = rows.join(members, "identity").select(F.col("identity").alias("_i"), F.col("kind").alias("_k"), F.col("acct").alias("_acct"), F.col("at").alias("_at"), "_begin", "_start")
    ts = F.col("ts")
    recent = (ts >= now - PACE_MINUTES * 60_000) & (ts < now + 1)
    inside = {"captured": (ts >= F.col("_begin")) & (ts < F.col("_at")), "since": (ts >= F.col("_at")) & (ts < now + 1), "recent": recent, "average": (ts >= F.col("_start")) & (ts < now + 1)}
    least = F.least("_begin", "_start", "_at", F.lit(now - PACE_MINUTES * 60_000))
    spent = usage.where(ts < now + 1).join(asked, (F.col("acct") == F.col("_acct")) & (ts >= least)).groupBy("_i", "_k").agg(
        *(F.sum(F.when(c, F.col("nanos"))).alias(f"_{k}") for k, c in inside.items()), F.sum(F.when(recent, tokens())).alias("_recent_t"), F.sum(F.when(inside["average"], tokens())).alias("_average_t"))
    known = members.select("identity").distinct().withColumn("_known", F.lit(True))
    out = rows.join(known, "identity", "left").join(spent, (F.col("identity") == F.col("_i")) & (F.col("kind") == F.col("_k")), "left")
    hours = (F.lit(now) - F.col("_start")) / F.lit(float(HOUR_MS))
    per_hour = 60.0 / PACE_MINUTES
    pace = F.when(F.col("_known"), F.when(F.col("_weekly"), _dollars(F.col("_average")) / hours).otherwise(_dollars(F.col("_recent")) * per_hour))
    pace_t = F.when(F.col("_known"), F.when(F.col("_weekly"), F.coalesce("_average_t", F.lit(0)) / hours).otherwise(F.coalesce("_recent_t", F.lit(0)) * per_hour))
    out = out.withColumns({"pace_cost_per_h": pace, "pace_tokens_per_h": pace_t, "pace_basis": F.when(F.col("_known"), F.when(F.col("_weekly"), "window_avg").otherwise("30m"))})
    told = (F.col("_len").isNotNull() & (F.col("utilization") < 1) & (F.col("resets_at") > now) & (F.col("at") < F.col("resets_at")) & (_dollars(F.col("_captured")) >= LEAST_SPEND))
    out = out.withColumn("per_dollar", F.when(told, F.greatest(F.lit(0.0), F.col("utilization")) / _dollars(F.col("_captured"))))
    out = out.withColumn("_u", F.col("utilization") + F.col("per_dollar") * F.when((F.col("per_dollar") > 0) & (F.col("at") <= now), _dollars(F.col("_since"))).otherwise(0.0))
    at = F.lit(now) + (1 - F.col("_u")) / (F.col("per_dollar") * F.col("pace_cost_per_h")) * HOUR_MS
    moving = F.col("per_dollar").isNotNull() & (F.col("pace_cost_per_h") > 0)
    out = out.withColumn("projected_at", F.when(moving & (F.col("per_dollar") > 0), F.when(F.col("_u") >= 1, F.lit(now).cast("long")).when(at < F.col("resets_at"), F.floor(at + 0.5).cast("long"))))
    out = out.withColumn("projection", F.when(F.col("projected_at").isNotNull(), "at").when(moving, "safe"))
    out = out.withColumn("at_reset", F.when(moving, F.col("_u") + F.col("per_dollar") * F.col("pace_cost_per_h") * ((F.col("resets_at") - now) / F.lit(float(HOUR_MS)))))
    out = out.withColumn("since_capture", _dollars(F.col("_since")))
    more = ["per_dollar", "since_capture"] if extra else []
    return out.select(
        "identity", "provider", "kind", "label", "scope", "rank", "at", "utilization", "resets_at", (F.col("minutes") * 60).alias("window_s"), "pace_cost_per_h", "pace_tokens_per_h", "pace_basis", "projected_at", "projection", "at_reset",
        F.greatest(F.lit(0), F.floor((F.lit(now) - F.col("at")) / 1000)).cast("long").alias("stale_s"), *more,
    )


def binding(scope: Column, kind: Column, label: Column, model: str | None, window: str | None) -> Column:
    """Whether a window binds: the named one alone, else account-wide ones and those of this model."""
    if window is not None:
        wanted = window.strip().lower()
        return (F.lower(kind) == wanted) | (F.lower(label) == wanted)
    return scope.isNull() | (scope_matches(scope, F.lit(model)) if model is not None else F.lit(False))


def should_wait(forecasts: DataFrame, now: int, zone: str, *, headroom: float = HEADROOM, cost: float | None = None, model: str | None = None, window: str | None = None) -> DataFrame:
    """One row per account: wait, reason, window, utilization, resets_at, wait_s.

    forecasts: with extra.  Wait if a binding window is at 1 - headroom, is projected to run out within ten minutes and before its
    reset, or would get there by `cost` more dollars; until the triggered window that resets last, and half a minute.
    """
    ceiling = 1 - headroom
    line = lambda u: u >= F.lit(ceiling - EPSILON)
    told = lambda u: percent(u)
    limit = percent(F.lit(ceiling))
    ends = F.when(F.coalesce(F.col("window_s") >= WEEK_MS // 1000, F.lit(False)), roughly(F.col("projected_at"), now, zone)).otherwise(F.concat(F.lit("at "), clock(F.col("projected_at"), now, zone)))
    rows = forecasts.withColumn("_binds", binding(F.col("scope"), F.col("kind"), F.col("label"), model, window))
    soon = F.coalesce((F.col("projection") == "at") & (F.col("projected_at") < F.col("resets_at")) & (F.col("projected_at") < now + HORIZON_MS), F.lit(False))
    after = F.col("utilization") + F.col("per_dollar") * (F.col("since_capture") + F.lit(float(cost or 0)))
    costly = F.coalesce(line(after), F.lit(False)) if cost else F.lit(False)
    why = (
        F.when(line(F.col("utilization")), F.concat("label", F.lit(" is at "), told(F.col("utilization")), F.lit(", at or over "), limit))
        .when(soon, F.concat("label", F.lit(" is at "), told(F.col("utilization")), F.lit(" and is projected (an estimate) to run out "), ends))
        .when(costly, F.concat(F.lit(f"an estimated ${cost or 0:.2f} would take "), "label", F.lit(" from "), told(F.col("utilization")), F.lit(" to about "), told(after), F.lit(", over "), limit))
    )
    resets = F.when(F.col("resets_at") <= now, F.concat(F.lit("has reset (at "), clock(F.col("resets_at"), now, zone), F.lit(")"))).otherwise(
        F.concat(F.lit("resets at "), clock(F.col("resets_at"), now, zone), F.lit(" (in "), duration(F.col("resets_at") - now), F.lit(")")))
    which = "it limits one model only; pass model to check yours" if model is None else "another model's limit"
    note = F.when(~F.col("_binds") & line(F.col("utilization")) & F.lit(window is None), F.concat(F.lit("; note: "), "label", F.lit(" is at "), told(F.col("utilization")), F.when(F.col("resets_at") > now, F.concat(F.lit(" until "), clock(F.col("resets_at"), now, zone))).otherwise(""), F.lit(f" ({which})")))
    rows = rows.withColumns({"_why": F.when(F.col("_binds"), why), "_resets": resets, "_note": note})
    shown = F.struct("label", "utilization", "resets_at", "_why", "_resets")
    hit = F.col("_binds") & F.col("_why").isNotNull()
    calm = F.col("_binds") & F.lit(bool(cost)) & F.col("_why").isNull()
    unscaled, scaled = calm & F.col("per_dollar").isNull(), calm & F.col("per_dollar").isNotNull()
    listed = lambda c, v: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("rank", "kind", v.alias("x"))))), lambda s: s["x"])
    by = rows.groupBy("identity").agg(
        F.min_by(shown, F.when(hit, F.struct((-F.col("resets_at")).alias("o"), "rank", "kind"))).alias("hit"), F.min_by(shown, F.when(F.col("_binds"), F.struct((-F.col("utilization")).alias("o"), "rank", "kind"))).alias("top"),
        F.array_join(listed(note.isNotNull(), F.col("_note")), "").alias("notes"), F.min("stale_s").alias("stale"), F.max(unscaled).alias("unscaled"),
        F.array_join(listed(scaled, F.concat("label", F.lit(" to about "), told(after))), ", ").alias("costs"))
    tail = F.concat("notes", F.when(F.col("stale") * 1000 > STALE_MS, F.concat(F.lit(" (limits data "), duration(F.col("stale") * 1000), F.lit(" old)"))).otherwise(""))
    wait = F.col("hit").isNotNull()
    fine = F.when(F.col("top").isNull(), F.lit("headroom ok: no window limits this model")).otherwise(F.concat(
        F.lit("headroom ok: "), "top.label", F.lit(" is at "), percent(F.col("top.utilization")), F.lit(" and "), "top._resets",
        F.when(F.col("costs") != "", F.concat(F.lit(f"; an estimated ${cost or 0:.2f} takes "), "costs")).otherwise(""),
        F.when(F.col("unscaled"), "; estimated_cost not checked for windows with too little spend to scale it").otherwise("")))
    pick = lambda c: F.when(wait, F.col(f"hit.{c}")).otherwise(F.col(f"top.{c}"))
    return by.select(
        "identity", wait.alias("wait"), F.concat(F.when(wait, F.concat("hit._why", F.lit("; it "), "hit._resets")).otherwise(fine), tail).alias("reason"), pick("label").alias("window"),
        (F.floor(pick("utilization") * 10_000 + 0.5) / 10_000).alias("utilization"), pick("resets_at").alias("resets_at"),
        F.when(wait, F.greatest(F.lit(0), F.ceil((F.col("hit.resets_at") - now) / 1000)) + MARGIN_S).otherwise(0).cast("long").alias("wait_s"),
    )


def verdicts(forecasts: DataFrame, now: int) -> DataFrame:
    """What a card says of an account: full, hits, week, idle, safe or unknown, in this order, over its account-wide windows."""
    rows = forecasts.where("scope is null")
    weekly, shown = F.coalesce(F.col("window_s") == WEEK_MS // 1000, F.lit(False)), F.coalesce(F.col("window_s").isin(5 * 3600, WEEK_MS // 1000), F.lit(False))
    by = rows.groupBy("identity").agg(
        F.max(F.when((F.col("utilization") >= 1) & (F.col("resets_at") > now), F.col("resets_at"))).alias("until"), F.min("projected_at").alias("hits_at"),
        F.min_by("at_reset", F.when(weekly, F.struct("rank", "kind"))).alias("week"), F.max(F.when(F.col("pace_basis") == "30m", F.col("pace_cost_per_h"))).alias("recent"),
        F.max(F.when(shown & (F.col("resets_at") > now) & (F.col("utilization") >= WARNING), F.struct("utilization", F.when(weekly, "week").otherwise("5h").alias("window")))).alias("high"), F.max(F.col("projection") == "safe").alias("safe"))
    kind = F.when(F.col("until").isNotNull(), "full").when(F.col("hits_at").isNotNull(), "hits").when(F.col("week") >= WARNING, "week").when(~F.coalesce(F.col("recent") > 0, F.lit(False)), "idle").when(F.col("safe"), "safe").otherwise("unknown")
    return by.select("identity", kind.alias("verdict"), F.coalesce("until", "hits_at").alias("at"), F.when(kind == "week", F.col("week")).when(kind == "idle", F.col("high.utilization")).alias("utilization"), F.when(kind == "idle", F.col("high.window")).alias("named")).orderBy("identity")


def shared_spend(usage: DataFrame, members: DataFrame, start: int, end: int) -> DataFrame:
    """Spend and tokens per hour of accounts together, by group, over [start, end)."""
    hours = F.lit((end - start) / HOUR_MS)
    rows = usage.where((F.col("ts") >= start) & (F.col("ts") < end)).groupBy("acct").agg(F.sum("nanos").alias("n"), F.sum(tokens()).alias("t"))
    return members.join(rows, "acct", "left").groupBy("group").agg((_dollars(F.sum("n")) / hours).alias("cost_per_h"), (F.coalesce(F.sum("t"), F.lit(0)) / hours).alias("tokens_per_h")).orderBy("group")


def shown_errors(status: DataFrame, captures: DataFrame, members: DataFrame) -> DataFrame:
    """The error shown beside a group's data: that of the member asked last, where it is newer than the data or there is none."""
    newest = captures.join(members, "identity").groupBy("group").agg(F.max("captured_at").alias("_at"))
    last = status.join(members, "identity").groupBy("group").agg(F.max_by(F.struct("provider", "last_error", "last_attempt_at"), F.coalesce("last_attempt_at", F.lit(-1))).alias("s"))
    error = F.when(F.col("_at").isNull(), F.col("s.last_error")).when((F.col("s.provider") != "codex") & (F.coalesce("s.last_attempt_at", F.lit(0)) > F.col("_at") * 1000), F.col("s.last_error"))
    return last.join(newest, "group", "left").select("group", error.alias("error"))

