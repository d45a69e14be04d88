"""A cache file of limit captures, tolerant of bad entries, and merging on write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.operators.windows import well_formed
from meterlark.schema import BUCKET

CAPTURES = f"map<string,struct<captured_at:double,source:string,via:string,rate_limits:map<string,{BUCKET}>>>"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Captures of a JSON cache (`providers`: identity to capture); bad entries and bad windows are left out, a bad file is empty."""
    raw = spark.read.option("wholetext", True).text(path)
    entries = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.providers"), CAPTURES)).alias("identity", "c"))
    rows = entries.select("identity", F.col("c.source").alias("provider"), "c.captured_at", "c.via", "c.rate_limits")
    return well_formed(rows)


def merged(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """An incoming capture replaces the stored one only when it is fresher."""
    both = stored.withColumn("_n", F.lit(1)).unionByName(incoming.withColumn("_n", F.lit(0)))
    rest = [c for c in stored.columns if c != "identity"]
    return both.groupBy("identity").agg(F.max_by(F.struct(*rest), F.struct("captured_at", "_n")).alias("c")).select("identity", "c.*")
