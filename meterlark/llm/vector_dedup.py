"""Operator 12: near-duplicate vectors by product quantisation: inverted lists, residual codes, look-up distances, exact cosines.

Nothing is lost between the steps, as each bound is sufficient.  Unit vectors of a cosine of at least t lie within
reach = sqrt(2 - 2t) of each other, so a vector's partners are in lists whose cell comes within reach of it.  A code's distance is
wrong by no more than the code's own error, which is stored beside it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.llm._shared import scratch, settled
from meterlark.llm.components import components
from meterlark.llm.whitening import usable

#: The lists' centres are made from about so many vectors; all vectors are in the index.
SAMPLE = 20_000
#: Lists at most, parts of a residual and words of each part's codebook.
LISTS, PARTS, WORDS = 4096, 8, 16
#: Vectors of a list that meet as many others at once; longer lists are cut into blocks.
BLOCK = 1024
ROUNDS, SLACK = 6, 1e-9
PLACED = "node long, kind long, weight long, home int, list int, role int, unit binary, code binary, miss double"
FOUND = "node long, links long, root long"


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres**2).sum(axis=1)
    return np.concatenate([(square - 2 * x[i : i + 4096] @ centres.T).argmin(axis=1) for i in range(0, len(x), 4096)])


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """At most k centres of the rows by Lloyd's rounds; equal ones count once."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(1).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        to = _nearest(x, centres)
        n = np.bincount(to, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, to, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(centres, axis=0)


def units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of length one in double precision, shorter ones filled up with zeros (they meet their own length only)."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        v = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
        v = v / np.abs(v).max()
        out[i, : len(v)] = v / math.sqrt(v @ v)
    return out


class Index:
    """Centres of the lists and codebooks of residuals; sent to executors (LISTS centres at most, whatever the table's size)."""

    def __init__(self, sample: np.ndarray, lists: int, reach: float):
        self.reach, self.centres = reach, clustered(sample, lists)
        self.gaps = np.sqrt(np.maximum(((self.centres[:, None] - self.centres[None]) ** 2).sum(axis=2) if len(self.centres) <= 512 else
                                       (self.centres**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * self.centres @ self.centres.T, 0))
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), PARTS) if len(p)]
        self.books = [clustered(rest[:, p], WORDS) for p in self.parts]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Each row's list, code, the code's error, and the later lists whose cells come within reach of it."""
        square = ((x**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T).clip(0)
        own = square.argmin(axis=1)
        rest = x - self.centres[own]
        code = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        told = np.concatenate([b[code[:, m]] for m, b in enumerate(self.books)], axis=1)
        miss = np.sqrt(((rest - told) ** 2).sum(axis=1))
        # twice the distance to the plane midway between the two centres, times their gap
        beyond = square - square[np.arange(len(x)), own][:, None] <= 2 * (self.reach + SLACK) * self.gaps[own] + SLACK
        beyond &= np.arange(len(self.centres)) > own[:, None]  # a pair is met once, in the later of its two lists
        return own, code, miss, [np.flatnonzero(r) for r in beyond]

    def distances(self, x: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """From each row to each coded vector of a list: sums of looked-up squares, part by part."""
        rest = x - self.centres[home]
        out = np.zeros((len(x), len(codes)))
        for m, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            out += ((rest[:, None, p] - book[None]) ** 2).sum(axis=2)[:, codes[:, m]]
        return np.sqrt(out)


def _roots(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least node that each row and column of a table of links reaches within it."""
    top = np.iinfo(np.int64).max
    while True:
        b2 = np.minimum(b, np.where(linked, a[:, None], top).min(axis=0, initial=top))
        a2 = np.minimum(a, np.where(linked, b2[None], top).min(axis=1, initial=top))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def _matrix(column, dtype) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype) for v in column])


def _met(index: Index, cosine: float, frame):
    """Links of one block of members and one of visitors: per node the weight it is linked with, and its root in the block."""
    import pandas as pd

    members, visitors = frame[frame["role"] == 0], frame[frame["role"] == 1]
    none = pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
    if not len(members) or not len(visitors):
        return none
    x, y = _matrix(visitors["unit"], np.float64), _matrix(members["unit"], np.float64)
    maybe = index.distances(x, int(frame["list"].iloc[0]), _matrix(members["code"], np.uint8)) <= index.reach + members["miss"].to_numpy() + SLACK
    a, b = visitors["node"].to_numpy(), members["node"].to_numpy()
    # within a list both sides are its members: each pair once
    maybe &= (visitors["home"].to_numpy() != frame["list"].iloc[0])[:, None] | (a[:, None] < b)
    rows, columns = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    if not len(rows):
        return none
    linked = maybe[np.ix_(rows, columns)] & (x[rows] @ y[columns].T >= cosine)
    a, b = a[rows], b[columns]
    ra, rb = _roots(linked, a, b)
    out = pd.DataFrame({"node": np.concatenate([a, b]), "links": np.concatenate([linked @ members["weight"].to_numpy()[columns], visitors["weight"].to_numpy()[rows] @ linked]), "root": np.concatenate([ra, rb])})
    return out[out["links"] > 0]


def link_vectors(texts: DataFrame, index: Index, width: int, cosine: float) -> DataFrame:
    """(node, links, root) for blocks of distinct vectors; links are weights of others, to be summed by node."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = units(batch.column("v"), width)
                own, code, miss, more = index.place(x)
                member = np.arange(len(x))
                visits = np.concatenate([np.concatenate([[o], m]) for o, m in zip(own, more, strict=True)]).astype(np.int32)
                who = np.concatenate([member, np.repeat(member, [1 + len(m) for m in more])])
                role = np.repeat([0, 1], [len(x), len(visits)]).astype(np.int32)
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([
                    batch.column("node").take(take), batch.column("kind").take(take), batch.column("n").take(take), pa.array(own[who].astype(np.int32)),
                    pa.array(np.concatenate([own.astype(np.int32), visits])), pa.array(role), pa.array([r.tobytes() for r in x]).take(take),
                    pa.array([c.tobytes() for c in code]).take(take), pa.array(miss[who]),
                ], names=[c.split()[0] for c in PLACED.split(", ")])

    rows = settled(texts.mapInArrow(placed, PLACED), "placed")
    sizes = rows.groupBy("kind", "list", "role").agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.groupBy("kind", "list").agg(*(F.max(F.when(F.col("role") == r, F.ceil(F.col("n") / BLOCK))).cast("int").alias(c) for r, c in ((0, "ms"), (1, "vs"))))
    # a list without members meets nobody; a block of one side goes to each block of the other
    rows = rows.join(blocks.where("ms > 0"), ["kind", "list"])
    own, other = F.when(F.col("role") == 0, F.col("ms")).otherwise(F.col("vs")), F.when(F.col("role") == 0, F.col("vs")).otherwise(F.col("ms"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), own).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), other - 1)))
    swapped = F.col("role") == 1
    rows = rows.withColumn("i", F.when(swapped, F.col("theirs")).otherwise(F.col("mine"))).withColumn("j", F.when(swapped, F.col("mine")).otherwise(F.col("theirs")))
    return rows.drop("ms", "vs", "mine", "theirs").groupBy("kind", "list", "i", "j").applyInPandas(lambda frame: _met(index, cosine, frame), FOUND)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: its links, the smallest id of its component, and whether it is kept.

    Vectors of equal labels (and lengths) are linked from the cosine on.  Null, empty or zero vectors, those with null or non-finite
    entries, and rows without a label link with nothing.  Equal vectors of a label are compared once and linked with each other.
    A null id is larger than any other: it names a component only where there is no other id, and is kept there; rows that share
    an id are vectors each.  An empty table gives no rows; other columns are of no account.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    fit: Column = usable(F.col("v")) & F.col("label").isNotNull() & F.exists("v", lambda c: c != 0)
    fit = F.coalesce(fit, F.lit(False))
    groups = rows.where(fit).groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    groups = settled(groups.withColumn("node", F.monotonically_increasing_id()).withColumn("kind", F.xxhash64("label", F.size("v"))), "groups")
    n, width = groups.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    part = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(max(1, min(1 << 30, math.ceil(SAMPLE / n * (1 << 30)))))
    sample = groups.where(part).select("v").toArrow().column("v").combine_chunks()  # about SAMPLE vectors
    if not len(sample):
        sample = groups.select("v").limit(1).toArrow().column("v").combine_chunks()
    index = Index(units(sample, width), min(LISTS, math.ceil(math.sqrt(n))), math.sqrt(max(0.0, 2 - 2 * cosine)))
    with scratch(spark):
        found = settled(link_vectors(groups, index, width, cosine), "found", keep=True)
        roots = settled(components(found, "node", "root"), "roots", keep=True)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    every = groups.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = every.groupBy("root").agg(F.min("least").alias("component_id"))
    told = every.join(named, "root").select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    joined = rows.where(fit).join(told, ["label", "v"])
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return joined.select("vec_id", "n_links", "component_id", kept.alias("kept")).unionByName(alone)
