"""Limit captures: normalising provider responses, the windows of a capture, and the freshest one per account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlark.functions.limits import finite, label_for_minutes, order_rank, window_label, window_minutes, window_scope
from meterlark.functions.timestamps import timestamp_ms
from meterlark.schema import BUCKET
from meterlark.sources.transcripts import is_object, text

SLOTS = ("primary", "secondary", "individualLimit")


def epoch_seconds(v: Column, path: str) -> Column:
    """A JSON number as it is, an ISO text in epoch seconds."""
    return F.coalesce(_number(v, path), timestamp_ms(text(v, path)) / 1000)


def _number(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), F.try_variant_get(v, path, "double"))


def _said(v: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def _bucket(label: Column, used: Column, resets: Column, minutes: Column | None = None) -> Column:
    return F.struct(label.cast("string").alias("label"), used.alias("used_percentage"), resets.alias("resets_at"), (F.lit(None).cast("double") if minutes is None else minutes).alias("window_minutes"))


def from_responses_a(responses: DataFrame) -> DataFrame:
    """Captures from provider A's usage responses (identity, captured_at, body): a list of limits, else an object of them."""
    rows = responses.select("identity", "captured_at", F.try_parse_json("body").alias("_b")).where("_b is not null")
    listed = rows.select("identity", "captured_at", F.posexplode(F.try_variant_get("_b", "$.limits", "array<variant>")).alias("_i", "_v"))
    v = F.col("_v")
    kind = F.coalesce(_said(v, "$.kind"), F.concat(F.lit("limit_"), F.col("_i").cast("string")))
    scope = F.coalesce(_said(v, "$.scope.model.display_name"), _said(v, "$.scope.model.id"), _said(v, "$.scope.surface"), F.lit("SCOPED"))
    label = F.when(kind == "session", "5-HOUR").when(kind == "weekly_all", "WEEKLY").when(kind == "weekly_scoped", F.upper(F.concat(scope, F.lit(" WEEKLY")))).otherwise(F.upper(F.replace(kind, F.lit("_"), F.lit(" "))))
    listed = listed.select("identity", "captured_at", "_i", kind.alias("_k"), label.alias("_l"), _number(v, "$.percent").alias("_u"), epoch_seconds(v, "$.resets_at").alias("_r")).where("_u is not null and _r is not null")
    again = F.row_number().over(W.partitionBy("identity", "captured_at", "_k").orderBy("_i")) > 1
    listed = listed.select("identity", "captured_at", "_i", F.when(again, F.concat("_k", F.lit("_"), F.col("_i").cast("string"))).otherwise(F.col("_k")).alias("_k"), _bucket(F.col("_l"), F.col("_u"), F.col("_r")).alias("_b"))
    old = rows.select("identity", "captured_at", F.explode(F.try_variant_get("_b", "$", "map<string,variant>")).alias("_k", "_v"))
    old = old.select("identity", "captured_at", F.lit(0).alias("_i"), "_k", _bucket(F.lit(None), _number(v, "$.utilization"), epoch_seconds(v, "$.resets_at")).alias("_b")).where("_b.used_percentage is not null and _b.resets_at is not null")
    old = old.join(listed.select("identity", "captured_at").distinct(), ["identity", "captured_at"], "left_anti")
    return _gathered(listed.unionByName(old), "claude", "api")


def from_responses_b(responses: DataFrame) -> DataFrame:
    """Captures from provider B's rate-limit responses: three slots per limit id, or the one limit stated alone."""
    rows = responses.select("identity", "captured_at", F.try_parse_json("body").alias("_b")).where("_b is not null")
    by_id = F.try_variant_get("_b", "$.rateLimitsByLimitId", "map<string,variant>")
    single = F.when(is_object(F.col("_b"), "$.rateLimits"), F.create_map(F.lit("codex"), F.try_variant_get("_b", "$.rateLimits", "variant")))
    limits = rows.select("identity", "captured_at", F.explode(F.when(F.size(by_id) > 0, by_id).otherwise(single)).alias("_id", "_v"))
    slots = limits.select("identity", "captured_at", "_id", _said(F.col("_v"), "$.limitName").alias("_name"), F.posexplode(F.array(*(F.struct(F.lit(s).alias("s"), F.try_variant_get("_v", f"$.{s}", "variant").alias("v")) for s in SLOTS))).alias("_i", "_s"))
    v = F.col("_s.v")
    minutes = _number(v, "$.windowDurationMins")
    told = label_for_minutes(minutes, F.col("_s.s"))
    out = slots.select("identity", "captured_at", "_i", F.concat("_id", F.lit("_"), "_s.s").alias("_k"), _bucket(F.upper(F.coalesce(F.concat("_name", F.lit(" "), told), told)), _number(v, "$.usedPercent"), epoch_seconds(v, "$.resetsAt"), minutes).alias("_b")).where("_b.used_percentage is not null and _b.resets_at is not null")
    return _gathered(out, "codex", "rpc")


def _gathered(rows: DataFrame, provider: str, via: str) -> DataFrame:
    limits = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_k", "_b"))), lambda x: F.struct(x["_k"], x["_b"])))
    return rows.groupBy("identity", "captured_at").agg(limits.cast(f"map<string,{BUCKET}>").alias("rate_limits")).select("identity", F.lit(provider).alias("provider"), "captured_at", F.lit(via).alias("via"), "rate_limits")


def windows(captures: DataFrame, *own: str) -> DataFrame:
    """The well-formed windows of captures, one row each: at and resets_at in ms, utilization, label, length, scope, rank; last the capture's `own` columns."""
    rows = captures.select("identity", "provider", "captured_at", *own, F.explode("rate_limits").alias("kind", "_b"))
    rows = rows.where(finite(F.col("captured_at")) & finite(F.col("_b.used_percentage")) & finite(F.col("_b.resets_at")))
    label = window_label(F.col("kind"), F.col("_b.label"), F.col("_b.window_minutes"))
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    return rows.select(
        "identity", "provider", ms("captured_at").alias("at"), "kind", label.alias("label"), (F.col("_b.used_percentage") / 100).alias("utilization"), ms("_b.resets_at").alias("resets_at"),
        window_minutes(F.col("kind"), F.col("_b.label"), F.col("_b.window_minutes")).alias("minutes"), window_scope(F.col("provider"), F.col("kind"), label).alias("scope"), order_rank(F.col("kind")).alias("rank"), *own,
    )


def freshest(captures: DataFrame, seq: str | None = None, *by: str) -> DataFrame:
    """The newest capture of each account (or of each `by`); of equally new ones the first by seq."""
    keys = by or ("provider", "identity")
    order = F.struct("captured_at", -F.col(seq)) if seq else F.col("captured_at")
    return captures.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in captures.columns if c not in keys and c != seq)), order).alias("_c")).select(*keys, "_c.*")


def well_formed(captures: DataFrame) -> DataFrame:
    """Captures read back from a file: a finite time, a known provider, and only their well-formed windows."""
    keep = F.map_filter("rate_limits", lambda k, b: finite(b["used_percentage"]) & finite(b["resets_at"]))
    return captures.where(finite(F.col("captured_at")) & F.col("provider").isin("claude", "codex") & F.col("rate_limits").isNotNull()).withColumn("rate_limits", keep)
