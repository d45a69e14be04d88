"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Stages filter or rewrite the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.llm._shared import scratch, sent_if_few, settled
from meterlark.llm.decontaminate import decontaminate
from meterlark.llm.language import fit_centroids, language_of
from meterlark.llm.near_dedup import near_duplicates
from meterlark.llm.packing import pack
from meterlark.llm.secrets import secrets_of

#: Columns that the stages add and take away again; other columns of documents may have any name but these.
KEY, SHARED = "__row_key", "__shared_id"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the identifier rejects (no text, no letter, or far from every language) go; the columns stay as they are.

    It learns from the rows that have a text and a lang.  Null text goes; a null id is of no account; of repeated rows all
    stay or all go; where nothing can be learned (an empty table, no lang) every document is rejected.
    """
    return docs.where(~language_of(F.col("text"), fit_centroids(docs))["rejected"])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key: the id where one row alone has it, else a hash of id and text, so that only equal rows share a key."""
    ids = docs.select(F.col("doc_id").alias(SHARED)).groupBy(SHARED).agg(F.count(F.lit(1)).alias("n"))
    shared = settled(ids.where(f"n > 1 or {SHARED} is null").select(SHARED), "shared")
    own = F.col("doc_id").cast("long")
    if shared.isEmpty():
        return docs.withColumn(KEY, own)
    rows = docs.join(shared.where(f"{SHARED} is not null"), F.col("doc_id") == F.col(SHARED), "left")
    return rows.withColumn(KEY, F.when(F.col("doc_id").isNull() | F.col(SHARED).isNotNull(), F.xxhash64("doc_id", "text")).otherwise(own)).drop(SHARED)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest id (a null id is the largest).

    Rows are near-duplicates from a similarity of 0.8 of their 5-word shingles on.  They are tied by their texts alone, whatever
    their ids; of equal rows one stays.  Rows without words (null or blank text) all stay.  An empty table stays empty.
    """
    rows = keyed(docs)
    found = near_duplicates(rows, shingle=5, part=80, whole=100, id_col=KEY).select(F.col("doc_id").alias(KEY), "n_shingles", "component_id")
    groups = settled(found.groupBy(KEY, "n_shingles", "component_id").agg(F.count(F.lit(1)).alias("n")), "groups")
    ids = rows.select(KEY, "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", KEY, "n_shingles", "n"))
    kept = settled(groups.join(ids, KEY).groupBy("component_id").agg(first.alias("f")).select(f"f.{KEY}", F.expr("f.n > 1 and f.n_shingles > 0").alias("equal")), "kept")
    equal = settled(kept.where("equal").select(KEY), "equal")
    gone = settled(groups.select(KEY).join(kept, KEY, "left_anti").union(equal).distinct(), "gone")
    left = rows.join(sent_if_few(gone), KEY, "left_anti")
    if not equal.isEmpty():
        left = left.unionByName(rows.join(sent_if_few(equal), KEY, "left_semi").dropDuplicates([KEY]))
    return left.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold benchmark passages go, and only they: other rows of their id stay.

    Null text holds none; of repeated rows all stay or all go; an empty table of documents or items changes nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = keyed(docs)
    dirty = settled(decontaminate(rows, benchmark, id_col=KEY).where("contaminated").select(F.col("doc_id").alias(KEY)).distinct(), "dirty")
    return rows.join(sent_if_few(dirty), KEY, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars, where there is such a column, counts what is left; every row stays.

    Null text stays null (and n_chars becomes null); null ids and repeated rows are of no account.
    """
    out = docs.withColumn("text", secrets_of(F.col("text"), redact=True)["redacted"])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 ids; null text is empty, repeated rows are packed each, no rows give no pieces."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=1)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]

#: Tokenising, similarity and training have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's working tables go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            done = settled(out, name, keep=True)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
