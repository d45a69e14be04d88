"""Operator 8: language identification, by nearest of several TF-IDF n-gram centroids per language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlark.llm._shared import give_back, slices, text_bytes
from meterlark.llm._words import BLANK

#: Hashed features: trigrams of bytes of the text in lower case, each run of white space as one space.
WIDTH = 1 << 14
#: Texts turned into vectors at once.
BLOCK = 64
#: Classes of length (powers of two of a text's trigrams), cosines told apart, and rows that a class's line is drawn from at least.
LENGTHS, STEPS, ENOUGH = 40, 1000, 200
#: The line stands at this part of the labelled rows' own cosine, as texts not learned from (cut ones, say) lie lower.
MARGIN = 2 / 3
UNKNOWN = "und"
#: A feature of a sampled vector on its way to the driver; such vectors sort, as bytes, as the whole rows of 16-bit numbers do.
ENTRY = np.dtype([("left", ">u2"), ("value", "<f2")])


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams, one row per text."""
    n = len(offsets) - 1
    blank = BLANK[data]
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep[(offsets[:-1] - offsets[0])[np.diff(offsets) > 0]] = True  # a text's own first blank, whatever the text before it ends in
    doc = np.repeat(np.arange(n), np.diff(offsets))[keep]
    b = np.where(blank, np.uint8(32), data)[keep].astype(np.uint32)
    if len(b) < 3:
        return np.zeros((n, WIDTH), np.float32)
    h = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(33 - WIDTH.bit_length())
    same = doc[:-2] == doc[2:]
    return np.bincount(doc[2:][same] * WIDTH + h[same], minlength=n * WIDTH).reshape(n, WIDTH).astype(np.float32)


def lengths(counts: np.ndarray) -> np.ndarray:
    """The class of length of each row of counts."""
    return np.minimum(np.log2(counts.sum(axis=1, dtype=np.float64) + 1).astype(np.int64), LENGTHS - 1)


def lines(histogram: np.ndarray, part: float) -> np.ndarray:
    """For each class of length the cosine below which at most that part of the rows lies, of a histogram by class and cosine.

    A class with fewer than ENOUGH rows takes its neighbours in, one on each side at a time.
    """
    out = np.zeros(LENGTHS)
    for c in range(LENGTHS):
        near = 0
        while histogram[max(0, c - near) : c + near + 1].sum() < ENOUGH and near < LENGTHS:
            near += 1
        upto = np.cumsum(histogram[max(0, c - near) : c + near + 1].sum(axis=0))
        out[c] = int(np.searchsorted(upto, part * upto[-1], side="right")) / STEPS if upto[-1] else 0.0
    return out


def blocks(part: pa.RecordBatch):
    """(first row, counts) of BLOCK texts at a time."""
    data, offsets = text_bytes(pc.utf8_lower(part.column("text")))
    for at in range(0, part.num_rows, BLOCK):
        own = offsets[at : at + BLOCK + 1]
        yield at, grams(data[own[0] : own[-1]], own - own[0])


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one (or zero)."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def packed(row: np.ndarray) -> bytes:
    """The features of a vector that are not zero: how far each is from the end (WIDTH and less), and its value."""
    at = np.flatnonzero(row)
    out = np.empty(len(at), ENTRY)
    out["left"], out["value"] = WIDTH - at, row[at]
    return out.tobytes()


def unpacked(vectors) -> np.ndarray:
    """Whole rows of packed vectors."""
    x = np.zeros((len(vectors), WIDTH), np.float32)
    for row, vector in zip(x, vectors, strict=True):
        entries = np.frombuffer(vector, ENTRY)
        row[WIDTH - entries["left"].astype(np.int64)] = entries["value"]
    return x


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k centroids of length one, from spread-out first rows (spherical k-means)."""
    picked = [0]
    while len(picked) < min(k, len(x)):
        near = (x @ x[picked].T).max(axis=1)
        picked.append(int(near.argmin()))
    centres = x[picked]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Centroids:
    """What a prediction needs: a few vectors per language."""

    languages: list[str]  # of each centroid
    vectors: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # cosine below which a text is rejected, by class of length

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        close = weighed(counts, self.idf) @ self.vectors.T
        best = close.argmax(axis=1)
        return best, np.clip(close[np.arange(len(best)), best], 0, 1)


def fit_centroids(labelled: DataFrame, *, per_language: int = 3, sample: int = 2000, reject: float = 0.005, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Centroids:
    """Centroids of the labelled rows (null text or lang: left out).

    Document frequencies cover all labelled rows, summed by feature in Spark; the driver gets one number per feature.
    Centroids are clustered from a bounded sample, the one place where rows are sampled: about
    `sample` rows in all (an equal share per language), picked by a hash of id and text, as hashed
    vectors.  reject: a text is rejected below MARGIN of the cosine that this part of the labelled rows of its length stay below
    (all labelled rows are scored; the driver gets their numbers by class of length and cosine).
    """
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    spark = labelled.sparkSession

    def frequencies(batches):
        seen, n = np.zeros(WIDTH, np.int64), {}
        for part in slices(batches, "text"):
            for _, counts in blocks(part):
                seen += (counts > 0).sum(axis=0)
            for lang, k in zip(*np.unique(np.array(part.column("lang").to_pylist(), object), return_counts=True), strict=True):
                n[lang] = n.get(lang, 0) + int(k)
        yield pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(WIDTH)] + [f"l{x}" for x in n]), pa.array([*seen.tolist(), *n.values()], pa.int64())], names=["what", "n"])

    found = {r["what"]: r["n"] for r in rows.mapInArrow(frequencies, "what string, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()}  # features and languages
    sizes = {k[1:]: n for k, n in sorted(found.items()) if k[0] == "l"}
    idf = np.log((1 + sum(sizes.values())) / (1 + np.array([found.get(f"f{i}", 0) for i in range(WIDTH)]))).astype(np.float32) + 1
    if not sizes:
        return Centroids([], np.zeros((0, WIDTH), np.float32), idf, np.zeros(LENGTHS))
    share = max(2, sample // len(sizes))
    wanted = spark.createDataFrame([(k, min(1.0, share / n)) for k, n in sizes.items()], "lang string, _share double")
    picked = rows.join(F.broadcast(wanted), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < F.ceil(F.col("_share") * 1_000_003)).select("lang", "text")

    def vectors(batches):
        for part in slices(batches, "text"):
            for at, counts in blocks(part):
                yield pa.RecordBatch.from_arrays([part.column("lang").slice(at, len(counts)), pa.array([packed(x) for x in np.log1p(counts)], pa.binary())], names=["lang", "vector"])

    got = picked.mapInArrow(vectors, "lang string, vector binary").toPandas()  # about `sample` rows, four bytes for each trigram of a text (64 KB at most)
    if lost := sorted(set(sizes) - set(got["lang"])):  # where there are many languages a draw may miss one: its row of the least hash stands for it
        least = rows.join(F.broadcast(spark.createDataFrame([(k,) for k in lost], "lang string")), "lang").groupBy("lang").agg(F.min_by("text", F.xxhash64("doc_id", "text")).alias("text"))
        got = pd.concat([got, least.select("lang", "text").mapInArrow(vectors, "lang string, vector binary").toPandas()])
    got = got.sort_values(["lang", "vector"])
    languages, centres = [], []
    for lang, part in got.groupby("lang", sort=True):
        x = unpacked(part["vector"])
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        made = clustered(x, per_language)
        languages += [str(lang)] * len(made)
        centres.append(made)
        del x  # before the next language's rows are made
    del got
    give_back()
    if not centres:
        return Centroids([], np.zeros((0, WIDTH), np.float32), idf, np.zeros(LENGTHS))
    model = Centroids(languages, np.concatenate(centres).astype(np.float32), idf, np.zeros(LENGTHS))

    def cosines(batches):
        seen = np.zeros(LENGTHS * STEPS, np.int64)
        for part in slices(batches, "text"):
            for at, counts in blocks(part):
                _, close = model.nearest(counts)
                lettered = np.array([any(map(str.isalpha, x)) for x in part.column("text").slice(at, len(counts)).to_pylist()], bool)
                cell = lengths(counts) * STEPS + np.minimum((close * STEPS).astype(np.int64), STEPS - 1)
                seen += np.bincount(cell[lettered], minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["cell", "n"])

    histogram = np.zeros(LENGTHS * STEPS, np.int64)
    for r in rows.select("text").mapInArrow(cosines, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most LENGTHS * STEPS rows
        histogram[r["cell"]] = r["n"]
    model.least = MARGIN * lines(histogram.reshape(LENGTHS, STEPS), reject)
    return model


def language_of(text: Column, model: Centroids) -> Column:
    """lang_pred, score and rejected of a text column as a struct; other columns of the row stay in the JVM."""

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
    def work(column: pa.Array) -> pa.Array:
        langs, scores, rejected = [], [], []
        for part in slices([pa.RecordBatch.from_arrays([column], names=["text"])], "text"):
            texts = part.column("text").to_pylist()
            first = len(langs)
            langs += [UNKNOWN] * len(texts)
            scores += [0.0] * len(texts)
            rejected += [True] * len(texts)
            for at, counts in blocks(part) if model.languages else ():
                best, close = model.nearest(counts)
                far = close < model.least[lengths(counts)]
                for i, (j, score, out) in enumerate(zip(best.tolist(), close.tolist(), far.tolist(), strict=True), at):
                    if any(map(str.isalpha, texts[i] or "")):
                        langs[first + i], scores[first + i], rejected[first + i] = model.languages[j], score, out
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "rejected"])

    return work(text)


def identify_language(docs: DataFrame, model: Centroids, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (cosine to the nearest centroid, 0 to 1), rejected.

    lang_pred is `und`, score 0 and rejected true if the text is null, has no letter, or no language was
    learned; else lang_pred is the nearest centroid's language, and rejected tells a text too far from every one.
    Ties go to the first language by name.  Null ids stay null; repeated rows repeat; an empty table gives an empty
    one; other columns are ignored.  Map-only; the model is a few vectors per language.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), language_of(F.col(text_col).cast("string"), model).alias("_l"))
    return rows.select("doc_id", "_l.*")
