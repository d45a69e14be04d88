"""Operator 11: what each filter removes in every order of the filters, and its Shapley share, from counts by failed set."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.llm._shared import settled

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
FULL = (1 << len(FILTERS)) - 1
#: A null id is larger than any other.
NULL_ID = 2**63 - 1
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_failures(text: Column) -> Column:
    """The bits of filters A to D that a text fails: few words, repeated words, capitals, marks."""
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    found = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(w: Column) -> Column:
        fails = {"A": w["n"] < 200, "B": 100 * w["distinct"].cast("long") < 50 * w["n"].cast("long"), "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}
        return sum((F.when(c, bit(k)).otherwise(0) for k, c in fails.items()), F.lit(0))

    return F.transform(F.array(found), bits)[0]


def polynomial(counts: dict[int, int]) -> list[int]:
    """Coefficients, by set of filters, of the multilinear polynomial that counts removed documents.

    counts: documents by the set of filters they fail.  A document that fails the set m adds 1 - prod(1 - x_i for i in m).
    """
    out = [0] * (FULL + 1)
    for m, n in counts.items():
        s = m
        while s:  # the non-empty subsets of m
            out[s] += n if s.bit_count() % 2 else -n
            s = (s - 1) & m
    return out


def at_corner(coefficients: list[int], on: int) -> int:
    """The polynomial where the filters in `on` are 1 and the others 0: documents that those remove."""
    return sum(a for s, a in enumerate(coefficients) if s & ~on == 0)


def shapley(coefficients: list[int], name: str) -> Fraction:
    """The partial derivative by a filter, integrated along the diagonal from 0 to 1."""
    return sum((Fraction(a, s.bit_count()) for s, a in enumerate(coefficients) if s & bit(name)), Fraction(0))


def audited(part: str, cells: list[tuple[int, bool, bool, int]]) -> list[tuple]:
    """The rows of one part; cells: (failed set, good, toxic, documents)."""
    sums: tuple[dict[int, int], ...] = ({}, {}, {})
    for mask, good, toxic, n in cells:
        for of, counted in zip(sums, (True, good, toxic), strict=True):
            if counted:
                of[mask] = of.get(mask, 0) + n
    total = sum(sums[0].values())
    every, good_ones, toxic_ones = (polynomial(s) for s in sums)
    gone, good_gone, toxic_gone = ([at_corner(p, on) for on in range(FULL + 1)] for p in (every, good_ones, toxic_ones))
    shares = {k: int(shapley(every, k) * len(ORDERS)) for k in FILTERS}
    rows = []
    for order in ORDERS:
        before = 0
        for step, k in enumerate(order, 1):
            after = before | bit(k)
            removed = gone[after] - gone[before]
            rows.append((part, order, step, total - gone[after], removed, gone[bit(k)] - removed, gone[FULL] - gone[FULL & ~bit(k)], good_gone[after] - good_gone[before], toxic_gone[after] - toxic_gone[before], shares[k]))
            before = after
    return rows


def audit_filters(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step.

    A null text is empty, a null part is the empty string; null and empty are one text and one part.  A null id is larger than
    any other and has no labels.  Rows that share an id are documents each; of equal texts those of the smallest id pass E.  A
    document is good or toxic if any label of its id says so.  No documents give no rows; other columns are of no account.
    Shuffled are a digest (SHA-256 stands for the text), an id, a part and five bits of each document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_failures(text).alias("fails"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"))
    facts = settled(facts, "facts")
    firsts = facts.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    told = told.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where(f"(good or toxic) and id < {NULL_ID}")
    # joined by digest and id together, so that no group of copies meets in one task
    rows = facts.join(firsts, ["digest", "id"], "left").join(told, "id", "left")
    no = F.lit(False)
    mask = F.col("fails") + F.when(F.col("first"), 0).otherwise(bit("E"))
    cells = rows.groupBy("part", mask.alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))  # at most 128 of each part

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            for part, cells in zip(frame["part"], frame["cells"], strict=True):
                yield pd.DataFrame(audited(part, [(c["mask"], c["good"], c["toxic"], c["n"]) for c in cells]), columns=names)

    return parts.mapInPandas(rows_of, SCHEMA)
