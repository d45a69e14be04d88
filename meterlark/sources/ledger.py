"""A legacy SQLite ledger as a Spark source, read by key ranges, and the rows of it worth importing."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meterlark.operators.merge import storable

TABLES = {
    "accounts": "id int, provider string, identity string, label string",
    "models": "id int, name string",
    "usage": "key long, acct int, ts long, model int, inp long, outp long, cr long, cc long, e5 long, e1 long",
    "meta": "k string, v string",
}


@dataclass
class Keys(InputPartition):
    low: int | None
    high: int | None


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, pieces: int):
        self.path, self.table, self.pieces = path, table, pieces

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        if self.table != "usage":
            return [Keys(None, None)]
        with self._connect() as con:
            lo, hi = con.execute("select min(key), max(key) from usage").fetchone()
        if lo is None:
            return [Keys(None, None)]
        step = (hi - lo) // self.pieces + 1
        return [Keys(lo + i * step, min(hi + 1, lo + (i + 1) * step)) for i in range(self.pieces) if lo + i * step <= hi]

    def read(self, partition) -> Iterator[tuple]:
        columns = ", ".join(c.split(" ")[0] for c in TABLES[self.table].split(", "))
        where, args = ("where key >= ? and key < ?", (partition.low, partition.high)) if partition.low is not None else ("", ())
        with self._connect() as con:
            yield from con.execute(f"select {columns} from {self.table} {where}", args)


class Ledger(DataSource):
    """format("usage_ledger").option("path", file).option("table", name).option("pieces", n): a file every executor sees."""

    @classmethod
    def name(cls):
        return "usage_ledger"

    def schema(self):
        return TABLES[self.options["table"]]

    def reader(self, schema):
        return _Reader(self.options["path"].removeprefix("file://"), self.options["table"], int(self.options.get("pieces", "8")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Plausible usage rows of known accounts and models: provider, identity, label and the columns of usage, tier 0."""
    spark.dataSource.register(Ledger)
    table = lambda name: spark.read.format("usage_ledger").option("path", path).option("table", name).load()
    rows = table("usage").join(table("models").withColumnRenamed("id", "model").withColumnRenamed("name", "_m"), "model").withColumn("model", F.col("_m")).drop("_m")
    rows = rows.join(table("accounts").withColumnRenamed("id", "acct"), "acct")
    return storable(rows.withColumn("tier", F.lit(0)))


def only_in_ledger(ledger: DataFrame, usage: DataFrame) -> DataFrame:
    """Rows that only the ledger has, counted by provider."""
    return ledger.join(usage.select("key"), "key", "left_anti").groupBy("provider").agg(F.count(F.lit(1)).alias("n")).orderBy("provider")
