"""Provider B rollouts: cumulative counters, carried state and replayed heads, as window functions over a file's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlark.functions.keys import SEPARATOR, ledger_key
from meterlark.functions.models import PLACEHOLDER
from meterlark.functions.timestamps import timestamp_ms
from meterlark.sources.transcripts import as_told, is_boolean, is_object, text, whole_number

#: Service tiers that are fast; the longest pause within a replayed burst; fork times at or below are seconds.
FAST_TIERS = ("fast", "priority")
BURST_MS = 1000
SECONDS_BELOW = 1e10
MARKS = ('"turn_context"', '"token_count"', '"thread_settings_applied"', '"task_started"', "inter_agent_communication")
TRIPLE = ("input_tokens", "cached_input_tokens", "output_tokens")


def session_id(path: Column) -> Column:
    """The UUID at the end of the file's stem in lower case, else the stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl$", "")
    uuid = F.regexp_extract(stem, r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$", 1)
    return F.when(uuid != "", F.lower(uuid)).otherwise(stem)


def session_index(paths: DataFrame) -> DataFrame:
    """Session to its paths: active before archived, then by path parts."""
    item = F.struct(F.contains(F.col("path"), F.lit("/archived_sessions/")).alias("a"), F.split("path", "/").alias("p"), F.col("path").alias("path"))
    return paths.select("path").distinct().groupBy(session_id(F.col("path")).alias("sid")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["path"]).alias("paths"))


def _counter(v: Column, path: str) -> Column:
    return F.greatest(whole_number(v, path), F.lit(0))


def _triple(v: Column, path: str) -> Column:
    return F.when(is_object(v, path), F.array(*(_counter(v, f"{path}.{c}") for c in TRIPLE)))


def _told(v: Column, path: str) -> Column:
    """The counts as key material, comma-joined: truth values by name, what isn't a whole number of at least 0 as 0; '' without counts."""
    one = lambda p: F.when(is_boolean(v, p), as_told(v, p)).otherwise(_counter(v, p).cast("string"))
    return F.when(is_object(v, path), F.concat_ws(",", *(one(f"{path}.{c}") for c in TRIPLE))).otherwise("")


def parse(lines: DataFrame) -> DataFrame:
    """Marked lines and first lines, with what each carries: model, tier, token counts, markers, parent."""
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(F.col("value"), F.lit(m))
    rows = lines.where(marked | (F.col("line_no") == 0)).withColumn("v", F.try_parse_json("value")).where("v is not null").withColumn("sid", session_id(F.col("path")))
    v = F.col("v")
    kind, inner = text(v, "$.type"), text(v, "$.payload.type")
    count = inner == "token_count"
    meta = (F.col("line_no") == 0) & (kind == "session_meta")
    parent = F.coalesce(text(v, "$.payload.forked_from_id"), text(v, "$.payload.source.subagent.thread_spawn.parent_thread_id"))
    number = F.try_variant_get(v, "$.timestamp", "double")
    fork_at = F.coalesce(F.when(number.isNotNull() & text(v, "$.timestamp").isNull(), F.when(number > SECONDS_BELOW, number).otherwise(number * 1000).cast("long")), timestamp_ms(text(v, "$.timestamp")))
    return rows.select(
        "path", "sid", "line_no", kind.alias("kind"), text(v, "$.timestamp").alias("at"), timestamp_ms(text(v, "$.timestamp")).alias("ts"),
        F.when((kind == "turn_context") & (text(v, "$.payload.model") != ""), text(v, "$.payload.model")).alias("model"),
        F.when((kind == "event_msg") & (inner == "thread_settings_applied") & text(v, "$.payload.thread_settings.service_tier").isNotNull(), text(v, "$.payload.thread_settings.service_tier").isin(*FAST_TIERS).cast("int")).alias("tier"),
        F.coalesce(count & is_object(v, "$.payload.info"), F.lit(False)).alias("counts"),
        F.when(count, _triple(v, "$.payload.info.total_token_usage")).alias("total"), F.when(count, _triple(v, "$.payload.info.last_token_usage")).alias("last"),
        F.when(count, F.concat_ws(SEPARATOR, _told(v, "$.payload.info.total_token_usage"), _told(v, "$.payload.info.last_token_usage"))).alias("told"),
        F.coalesce((kind == "event_msg") & (inner == "task_started"), F.lit(False)).alias("started"),
        F.coalesce(kind.isin("inter_agent_communication", "inter_agent_communication_metadata") & F.try_variant_get(v, "$.payload.trigger_turn", "boolean"), F.lit(False)).alias("trigger"),
        F.when(meta & (parent != ""), F.lower(parent)).alias("parent"), F.when(meta, fork_at).alias("fork_at"), F.coalesce(meta & is_object(v, "$.payload.source.subagent.thread_spawn"), F.lit(False)).alias("spawn"),
    )


def advanced(parsed: DataFrame) -> DataFrame:
    """Token counts that add usage, with `usage` (input, cached, output) by the counter's advance.

    First total: the event's own usage; unchanged: nothing; grown: the difference; restarted: the total; else the event's own usage.
    """
    before = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    rows = parsed.where("counts and ts is not null").withColumn("_was", F.last("total", ignorenulls=True).over(before))
    now, was, last = F.col("total"), F.col("_was"), F.col("last")
    every = lambda f: F.forall(F.arrays_zip(now.alias("a"), was.alias("b")), f)
    grown = every(lambda x: x["a"] >= x["b"])
    restarted = (last.isNotNull() & (now == last)) | every(lambda x: x["a"] < x["b"])
    usage = (
        F.when(now.isNull(), last).when(was.isNull(), last).when(now == was, None)
        .when(grown, F.zip_with(now, was, lambda a, b: a - b)).when(restarted, now).otherwise(last)
    )
    return rows.withColumn("usage", usage).where("usage is not null and not (usage[0] = 0 and usage[2] = 0)").drop("_was")


def carried(parsed: DataFrame) -> DataFrame:
    """Each line with the model and tier in force: models are carried on, and back to lines before the first."""
    own = W.partitionBy("path").orderBy("line_no")
    on, back = own.rowsBetween(W.unboundedPreceding, 0), own.rowsBetween(0, W.unboundedFollowing)
    return parsed.withColumn("model", F.coalesce(F.last("model", True).over(on), F.first("model", True).over(back), F.lit(PLACEHOLDER))).withColumn("tier", F.coalesce(F.last("tier", True).over(on), F.lit(0)))


def judged(parsed: DataFrame) -> DataFrame:
    """Counted events with `inherited`: those a child rollout's head replays from its parent.

    The head's events equal the parent's, one by one, up to the fork; or, if not even the first does, they are a burst of
    events at most a second apart from the file's start.  A spawned child's first trigger turn judges anew: only events after the last
    task start before it are its own.
    """
    own = W.partitionBy("path").orderBy("line_no")
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    rows = carried(parsed).withColumn("_started", F.sum(F.col("started").cast("int")).over(upto))
    head = parsed.groupBy("path").agg(F.max("parent").alias("_parent"), F.max("fork_at").alias("_fork"), F.max("spawn").alias("_spawn"))
    trigger = rows.where("trigger").groupBy("path").agg(F.min(F.struct("line_no", "_started")).alias("_t"))
    probes = rows.where("kind = 'event_msg' and ts is not null and (total is not null or last is not null)").withColumn("_n", F.row_number().over(own)).where("_n <= 2").groupBy("path").agg(F.max(F.when(F.col("_n") == 1, F.col("ts"))).alias("_t1"), F.max(F.when(F.col("_n") == 2, F.col("ts"))).alias("_t2"))
    events = advanced(rows).withColumn("_i", F.row_number().over(own)).join(head, "path", "left").join(trigger, "path", "left").join(probes, "path", "left")
    parents = advanced(parsed).withColumn("_pi", F.row_number().over(own)).withColumn("_first", F.min("path").over(W.partitionBy("sid"))).where("path = _first").select(F.col("sid").alias("_psid"), "_pi", F.col("usage").alias("_pu"), F.col("ts").alias("_pts"))
    rows = events.join(parents, (F.col("_parent") == F.col("_psid")) & (F.col("_parent") != F.col("sid")) & (F.col("_i") == F.col("_pi")), "left")
    same = F.coalesce((F.col("usage") == F.col("_pu")) & (F.col("_fork").isNull() | (F.col("_pts") <= F.col("_fork"))), F.lit(False))
    gap = F.col("ts") - F.coalesce(F.lag("ts").over(own), "_t1")
    burst = F.coalesce(F.col("_t2") - F.col("_t1"), F.lit(-1)).between(0, BURST_MS)
    rows = rows.withColumn("_same", F.min(same.cast("int")).over(upto)).withColumn("_close", F.min(F.coalesce(gap.between(0, BURST_MS), F.lit(False)).cast("int")).over(upto))
    any_match = F.max("_same").over(W.partitionBy("path")) > 0
    replay = F.when(any_match, F.col("_same") > 0).otherwise(burst & (F.col("_close") > 0))
    retold = F.col("_spawn") & F.col("_t").isNotNull()
    inherited = F.when(F.col("_parent").isNull(), False).when(retold & (F.col("line_no") < F.col("_t.line_no")), ~((F.col("_t._started") > 0) & (F.col("_started") == F.col("_t._started")))).when(retold & (F.col("line_no") > F.col("_t.line_no")), False).otherwise(replay)
    return rows.withColumn("inherited", inherited)


def usage_rows(parsed: DataFrame) -> DataFrame:
    """One row per key that isn't inherited: path, key, ts, model and counts; cached input counts as cache reads."""
    rows = judged(parsed)
    read = F.least(F.col("usage")[0], F.col("usage")[1])
    rows = rows.select("path", "line_no", "inherited", ledger_key(F.concat_ws(SEPARATOR, F.lit("x"), "sid", "at", "told")).alias("key"), "ts", "model", (F.col("usage")[0] - read).alias("inp"), F.col("usage")[2].alias("outp"), read.alias("cr"), "tier")
    zero = F.lit(0).cast("long")
    own = rows.where("not inherited").groupBy("key").agg(F.min(F.struct("path", "line_no", "ts", "model", "tier")).alias("f"), *(F.max(c).alias(c) for c in ("inp", "outp", "cr")))
    return own.select("key", F.col("f.path").alias("path"), F.col("f.ts").alias("ts"), F.col("f.model").alias("model"), "inp", "outp", "cr", zero.alias("cc"), zero.alias("e5"), zero.alias("e1"), F.col("f.tier").alias("tier"))


def dropped_keys(parsed: DataFrame) -> DataFrame:
    """Keys that every reading judges inherited: to be dropped from the store."""
    rows = judged(parsed).select("inherited", ledger_key(F.concat_ws(SEPARATOR, F.lit("x"), "sid", "at", "told")).alias("key"))
    return rows.groupBy("key").agg(F.min(F.col("inherited").cast("int")).alias("_all")).where("_all = 1").select("key")


def latest_limits(lines: DataFrame) -> DataFrame:
    """The newest limit snapshot of each file; of equally new ones the later line."""
    rows = lines.where(F.contains(F.col("value"), F.lit('"token_count"'))).withColumn("v", F.try_parse_json("value")).where(text(F.col("v"), "$.payload.type") == "token_count")
    v = F.col("v")

    def window(name: str) -> Column:
        at = f"$.payload.rate_limits.{name}"
        number = lambda c: F.try_variant_get(v, f"{at}.{c}", "double")
        return F.when(is_object(v, at) & number("used_percent").isNotNull() & number("resets_at").isNotNull(), F.struct(F.lit(None).cast("string").alias("label"), number("used_percent").alias("used_percentage"), number("resets_at").alias("resets_at"), number("window_minutes").alias("window_minutes")))

    rows = rows.select("path", "line_no", (F.coalesce(timestamp_ms(text(v, "$.timestamp")), F.lit(0)) / 1000).alias("captured_at"), window("primary").alias("p"), window("secondary").alias("s")).where("p is not null or s is not null")
    newest = rows.groupBy("path").agg(F.max_by(F.struct("captured_at", "p", "s"), F.struct("captured_at", "line_no")).alias("x"))
    limits = F.map_filter(F.map_from_arrays(F.array(F.lit("codex_primary"), F.lit("codex_secondary")), F.array(F.col("x.p"), F.col("x.s"))), lambda k, b: b.isNotNull())
    return newest.select("path", F.col("x.captured_at").alias("captured_at"), limits.alias("rate_limits"))
