"""Live ingestion: appended lines to a log of parsed rows, and the usage, rollup and limit tables read from it.

The log is append-only.  Merging is idempotent and commutative, so a line read twice changes nothing, and a late line counts
whenever it comes: there is no watermark and nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlark.operators import merge, rollup
from meterlark.schema import DAY_MS, HOUR_MS
from meterlark.sources import rollouts, transcripts
from meterlark.streaming.lines import register

PARSERS = {"a": transcripts.parse, "b": rollouts.parse}


def follow(spark: SparkSession, roots: list[str], log: str, checkpoint: str, *, provider: str, trigger: dict | None = None) -> StreamingQuery:
    """Lines appended below the roots, parsed, to the log.  trigger: as writeStream.trigger takes it; what is there now, by default."""
    register(spark)
    lines = spark.readStream.format("appended_lines").option("path", ",".join(roots)).load()
    rows = PARSERS[provider](lines).withColumn("day", F.floor(F.coalesce("ts", F.lit(0)) / DAY_MS).cast("long"))
    return rows.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).partitionBy("day").trigger(**(trigger or {"availableNow": True})).start()


def usage_of(log: DataFrame, accounts: DataFrame, provider: str) -> DataFrame:
    """The merged usage table of a log.  accounts: root (a folder's path) to acct; a file belongs to the longest root above it."""
    if provider == "a":
        rows = transcripts.folded(log.drop("day").dropDuplicates(["path", "line_no", "key"]))
    else:
        rows = rollouts.usage_rows(log.drop("day").dropDuplicates(["path", "line_no"]))
    # each path once, with the folders above it: roots are met by equality
    names = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda n: F.array_join(F.slice(names, 1, n), "/"))
    paths = rows.select("path").distinct().where(F.size(names) > 1).select("path", F.explode(above).alias("_folder"))
    roots = accounts.select("acct", F.rtrim(F.col("root"), F.lit("/")).alias("_root"))
    owned = paths.join(roots, F.col("_folder") == F.col("_root")).groupBy("path").agg(F.max_by("acct", F.length("_root")).alias("acct"))
    return merge.merged(merge.storable(rows.join(owned, "path").select(*merge.COLUMNS)))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Which accounts a pass touched and the span of times of changed rows: acct, lo, hi, n."""
    keys = merge.changed_keys(before, after)
    return after.join(keys, "key", "left_semi").groupBy("acct").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n"))


def related(log: DataFrame, part: DataFrame, provider: str) -> DataFrame:
    """The log's lines that decide the rows of part: those of its keys; of a rollout, its session's and its parent's."""
    if provider == "a":
        return log.join(part.where("key is not null").select("key").distinct(), "key", "left_semi")
    sessions = part.select("sid").union(part.where("parent is not null").select("parent")).distinct()
    return log.join(sessions, "sid", "left_semi")


def day_of(ts: str):
    return F.floor(F.col(ts) / DAY_MS).cast("long").alias("day")


def refresh_rollup(usage: DataFrame, days: list[int], path: str) -> None:
    """Overwrite the rollup's partitions of these days from their rows; other days stay as they are."""
    out = rollup.built(usage.where(day_of("ts").isin(days))).withColumn("day", F.floor(F.col("hour") * HOUR_MS / DAY_MS).cast("long"))
    out.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def on_batch(log_path: str, accounts: DataFrame, provider: str, rollup_path: str):
    """For foreachBatch over parsed rows: append to the log, then rebuild the rollup's days whose rows the batch touches.

    A batch run twice leaves the same tables: it overwrites its own part of the log and whole days of the rollup.  The log is
    partitioned by day, so a batch reads the days it touches; lines of the same keys on other days are found by a semi-join
    that bloom filters on the key keep small.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("day", F.floor(F.coalesce("ts", F.lit(0)) / DAY_MS).cast("long"))
        spread = rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (spread.option("parquet.bloom.filter.enabled#key", "true") if provider == "a" else spread).partitionBy("day", "batch").parquet(log_path)
        log = spark.read.schema(rows.withColumn("batch", F.lit(0)).schema).parquet(log_path).drop("batch")
        touched = usage_of(related(log, rows, provider), accounts, provider)
        days = [r["day"] for r in touched.select(day_of("ts")).distinct().collect()]  # a few numbers
        if days:
            refresh_rollup(usage_of(related(log, log.where(F.col("day").isin(days)), provider), accounts, provider), days, rollup_path)

    return work
