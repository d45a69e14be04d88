"""Operator 13: whitening of embeddings by the leading components of their covariance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def usable(vector: Column) -> Column:
    """Is there a vector, with every entry there and finite?"""
    whole = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(whole, F.lit(False))


def covariance(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """Gramian of centred rows divided by n; partial sums are made on executors and merged in a tree."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component, components numbered from 1 by falling variance.

    Null vectors and those with null or non-finite entries go; so do those of another length than most have (of lengths equally
    frequent the greatest is taken), as no covariance is theirs.  Null ids and repeated rows stay, each a row of the fit.  A
    component without variance beyond rounding (fewer rows than dimensions, equal rows) is whitened to 0 and left out of
    identity_error.  Signs: the entry of a component that is largest in size is positive.  No usable rows, or empty vectors, give no rows.
    deviation is exact at any size; an entry whose whole number is no long raises an arithmetic error.  The driver sees sums and Gramians, of the size of the dimensions alone.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    lengths = kept.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or not lengths["d"]:
        return spark.createDataFrame([], SCHEMA)
    dims, n = lengths["d"], lengths["n"]
    # the guard is within the expression: a filter may be evaluated after it
    x = F.when(usable(F.col("v")), F.transform("v", lambda c: F.floor(SCALE * c.cast("double")) + SHIFT))
    whole = kept.where(F.size("v") == dims).select("vec_id", x.alias("x"))
    sums = whole.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect()
    total = [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])]
    s = F.array(*[F.lit(v).cast("decimal(38,0)") for v in total]) if max(map(abs, total)) >= 2**62 else F.array(*[F.lit(v).cast("long") for v in total])
    centred = whole.select(F.transform("x", lambda c, i: (F.lit(n) * c - F.get(s, i)).cast("double") / n).alias("x"))
    values, axes = np.linalg.eigh(covariance(centred, "x", n))
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(values.sum())
    first = min(components, dims)
    values, axes = np.maximum(values[:first], 0.0), axes[:, :first]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(first)] < 0, -1.0, 1.0)
    live = values > dims * np.finfo(float).eps * max(trace, 0.0)
    scaled = np.where(live, axes / np.sqrt(np.where(live, values, 1.0)), 0.0)
    explained = np.where(live, values / (trace if trace > 0 else 1.0), 0.0)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[int], np.ndarray]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if n * (int(np.abs(x).max()) + max(map(abs, total)) // n + 1) < 2**62:
                d = n * x - np.array(total, np.int64)
            else:
                d = n * x.astype(object) - np.array(total, object)
            top = int(np.abs(d).max())
            exact = (d * d if top * top * dims < 2**63 else d.astype(object) ** 2).sum(axis=1)
            yield batch.column("vec_id"), [int(e) for e in exact], d.astype(np.float64) / n @ scaled

    def only_whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, w in batches_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(w[:, live]), pa.list_(pa.float64()))], names=["w"])

    error = 0.0
    if live.any():
        made = whole.mapInArrow(only_whitened, "w array<double>")
        means = made.select(F.posexplode("w").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s")).collect()
        mean = F.array(*[F.lit(r["s"] / n) for r in sorted(means, key=lambda r: r["i"])])
        around = made.select(F.transform("w", lambda c, i: c - F.get(mean, i)).alias("w"))
        error = float(np.abs(covariance(around, "w", n) - np.eye(int(live.sum()))).max())

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, exact, w in batches_of(batches):
            rows = len(ids)
            per_row = np.repeat(np.arange(rows), first)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(per_row)), pa.array(np.tile(np.arange(1, first + 1), rows), pa.int32()), pa.array(np.full(rows * first, n), pa.int64()),
                pa.array(exact, pa.decimal128(38, 0)).take(pa.array(per_row)), pa.array(w.reshape(-1)), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * first, error)),
            ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return whole.mapInArrow(rows_of, SCHEMA)
