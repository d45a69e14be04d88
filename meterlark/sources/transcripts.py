"""Provider A transcripts: JSON lines to usage rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.functions.keys import SEPARATOR, ledger_key
from meterlark.functions.models import SYNTHETIC
from meterlark.functions.timestamps import timestamp_ms
from meterlark.streaming.lines import register

COUNTS = ("inp", "outp", "cr", "cc", "e5", "e1", "tier")


def read_lines(spark: SparkSession, *roots: str) -> DataFrame:
    """Complete lines of every *.jsonl file below the roots: path, line_no, value.  An unfinished last line is left out; invalid UTF-8 is replaced.

    Files in folders that every executor sees are read in pieces of 64 MB, however long they are; line_no is then the byte a line
    begins at.  Of other stores (s3a:, hdfs:) each file is one row first, so files there must be below 2 GB; line_no counts lines.
    """
    if all(":" not in r or r.startswith("file:") for r in roots):
        register(spark)
        return spark.read.format("appended_lines").option("path", ",".join(roots)).load()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(list(roots))
    lines = files.select("path", F.split(F.make_valid_utf8(F.col("content").cast("string")), "\n").alias("_l"))
    lines = lines.select("path", F.posexplode(F.slice("_l", 1, F.greatest(F.size("_l") - 1, F.lit(0)))).alias("line_no", "value"))
    return lines.select("path", F.col("line_no").cast("long").alias("line_no"), F.rtrim(F.col("value"), F.lit("\r")).alias("value"))


def marked() -> Column:
    """The cheapest sign of a usage line."""
    return F.contains(F.col("value"), F.lit('"usage"'))


def candidate() -> Column:
    """The signs of a usage line that need no JSON."""
    has = lambda x: F.contains(F.col("value"), F.lit(x))
    return marked() & has("assistant") & ~has('"token_count"') & ~has('"turn_context"')


def raw(v: Column, path: str) -> Column:
    """The JSON text at a path (a string in its quotes): null where there is nothing.  One look at the variant tells kind and value."""
    return F.to_json(F.try_variant_get(v, path, "variant"))


def whole_number(v: Column, path: str) -> Column:
    """A JSON integer as itself, true as 1; false, floats, strings and others as 0."""
    whole = F.schema_of_variant(F.try_variant_get(v, path, "variant")).isin("BIGINT", "BOOLEAN")  # a float without a fraction is no integer
    return F.coalesce(F.when(whole, F.regexp_replace(raw(v, path), "^true$", "1").try_cast("long")), F.lit(0).cast("long"))


def is_object(v: Column, path: str) -> Column:
    return F.coalesce(F.startswith(raw(v, path), F.lit("{")), F.lit(False))


def is_text(v: Column, path: str) -> Column:
    return F.coalesce(F.startswith(raw(v, path), F.lit('"')), F.lit(False))


def is_boolean(v: Column, path: str) -> Column:
    return F.coalesce(raw(v, path).isin("true", "false"), F.lit(False))


def text(v: Column, path: str) -> Column:
    """A JSON string as itself; anything else is null."""
    return F.when(is_text(v, path), F.try_variant_get(v, path, "string"))


def truthy(v: Column, path: str) -> Column:
    """Whether a JSON value counts as stated: not null, false, zero or empty."""
    return F.coalesce(~F.rlike(raw(v, path), F.lit(r"^(null|false|\"\"|\[\]|\{\}|-?0*(\.0*)?([eE][+-]?[0-9]+)?)$")), F.lit(False))


def as_told(v: Column, path: str) -> Column:
    """A JSON value as key material: a string itself, a whole number in digits, `True`, `False`, null as ''."""
    shown = F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    return F.when(is_boolean(v, path), F.initcap(shown)).otherwise(shown)


def parse(lines: DataFrame) -> DataFrame:
    """Usage lines with path, line_no, key (null: unkeyed), ts (null: none), model and counts."""
    rows = lines.where(candidate()).withColumn("v", F.try_parse_json("value"))
    v = F.col("v")
    rows = rows.where(v.isNotNull() & (text(v, "$.type") == "assistant") & is_object(v, "$.message.usage") & ~odd_model(v))
    n = lambda name: whole_number(v, f"$.message.usage.{name}")
    split = is_object(v, "$.message.usage.cache_creation")
    out = rows.select(
        "path", "line_no", "v", n("input_tokens").alias("inp"), n("output_tokens").alias("outp"), n("cache_read_input_tokens").alias("cr"), n("cache_creation_input_tokens").alias("_cc"),
        F.when(split, n("cache_creation.ephemeral_5m_input_tokens")).alias("e5"), F.when(split, n("cache_creation.ephemeral_1h_input_tokens")).alias("e1"),
        F.coalesce(text(v, "$.message.model"), F.lit("")).alias("model"), F.when(truthy(v, "$.message.id"), as_told(v, "$.message.id")).otherwise("").alias("_id"),
        as_told(v, "$.requestId").alias("_req"), F.coalesce(text(v, "$.uuid"), F.lit("")).alias("_uuid"), text(v, "$.timestamp").alias("_ts"),
        F.coalesce(text(v, "$.message.usage.speed") == "fast", F.lit(False)).cast("int").alias("tier"),
    ).where(F.col("model") != SYNTHETIC)
    material = F.when(F.col("_id") != "", F.concat_ws(SEPARATOR, F.lit("c"), "_req", "_id")).when(F.col("_uuid") != "", F.concat_ws(SEPARATOR, F.lit("u"), "_uuid"))
    out = out.withColumn("_m", material).withColumn("cc", F.when((F.col("_cc") == 0) & (F.coalesce("e5", F.lit(0)) + F.coalesce("e1", F.lit(0)) > 0), F.col("e5") + F.col("e1")).otherwise(F.col("_cc")))
    return out.select("path", "line_no", F.when(F.col("_m").isNotNull(), ledger_key(F.col("_m"))).alias("key"), timestamp_ms(F.col("_ts")).alias("ts"), "model", *COUNTS)


def odd_model(v: Column) -> Column:
    """A model that is stated but isn't text: such a line is malformed."""
    return truthy(v, "$.message.model") & ~is_text(v, "$.message.model")


def path_order(path: Column) -> Column:
    """Paths by their parts, each by code point."""
    return F.split(path, "/")


def folded(parsed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per key of a pass over files, in path order and line order.

    The first line with a time fixes time, model and path; counts are maxima over it and later lines.  Keys without any
    timed line count only where `known` has them, to be raised (ts and model are null then).
    """
    rows = parsed.where("key is not null").withColumn("_o", F.struct(path_order(F.col("path")).alias("p"), F.col("line_no").alias("l")))
    first = rows.where("ts is not null").groupBy("key").agg(F.min(F.struct("_o", "ts", "model", "path")).alias("_f"))
    joined = rows.join(first, "key", "left").where(F.col("_f").isNull() | (F.col("_o") >= F.col("_f._o")))
    out = joined.groupBy("key").agg(F.first("_f").alias("_f"), *(F.max(c).alias(c) for c in COUNTS)).select("key", F.col("_f.path").alias("path"), F.col("_f.ts").alias("ts"), F.col("_f.model").alias("model"), *COUNTS)
    timed = out.where("ts is not null")
    if known is None:
        return timed
    return timed.unionByName(out.where("ts is null").join(known.select("key").distinct(), "key", "left_semi"))


def stats(lines: DataFrame) -> DataFrame:
    """Lines, candidates, malformed and unkeyed lines by path."""
    v = F.try_parse_json("value")
    usage = F.coalesce((text(v, "$.type") == "assistant") & is_object(v, "$.message.usage") & odd_model(v), F.lit(False))
    parsed = parse(lines).groupBy("path").agg(F.count(F.lit(1)).alias("usage_lines"), F.count_if(F.col("key").isNull()).alias("unkeyed"))
    seen = lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_if(marked()).alias("candidates"), F.count_if(candidate() & (v.isNull() | usage)).alias("malformed"))
    return seen.join(parsed, "path", "left").select("path", "lines", "candidates", "malformed", F.coalesce("usage_lines", F.lit(0)).alias("usage_lines"), F.coalesce("unkeyed", F.lit(0)).alias("unkeyed"))
