"""Re-keying by shares: the whole result, and what of it is on disk at a time."""

from __future__ import annotations

import os
import threading
from pathlib import Path

import pytest
from comparing import by_duckdb, by_spark
from conftest import SMALL

from meterlark import catalog, catalog_kept
from meterlark.sources.shared import FREED, kept, new_folder


def on_disk(folders: list[str]) -> int:
    total = 0
    for folder in folders:
        for top, _, names in os.walk(folder):
            for name in names:
                try:
                    total += os.path.getsize(f"{top}/{name}")
                except OSError:  # gone meanwhile
                    pass
    return total


def test_rekeying_takes_a_few_times_the_input_of_disk(spark, monkeypatch):
    monkeypatch.setattr(catalog_kept, "SHARE_BYTES", 1 << 16, raising=False)
    folder = "/root/testdata/sf0.01"
    own = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders = [*own, spark.conf.get("spark.checkpoint.dir").removeprefix("file://")]
    before, most, ended = on_disk(folders), [0], threading.Event()

    def watch():
        while not ended.wait(0.05):
            most[0] = max(most[0], on_disk(folders) - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        catalog.QUERIES["rekeyed"](spark, folder).write.format("noop").mode("overwrite").save()
    finally:
        ended.set()
        watcher.join()
    most = max(most[0], on_disk(folders) - before)
    given = sum(Path(folder, f"{t}.parquet").stat().st_size for t in ("lineitem", "part"))
    assert most < 5 * given, f"{most / given:.1f} x input"


@pytest.mark.parametrize("bytes_each", (1 << 12, 1 << 40))
def test_rekeying_by_many_shares_equals_the_sql(spark, monkeypatch, bytes_each):
    monkeypatch.setattr(catalog_kept, "SHARE_BYTES", bytes_each)
    assert by_spark(catalog.QUERIES["rekeyed"](spark, SMALL)) == by_duckdb(catalog.SQL["rekeyed"], SMALL)


def test_shares_keep_every_row(spark):
    rows = spark.createDataFrame([(k, k % 3) for k in range(200)] + [(None, 1), (None, 1), (7, 1)], "key long, n int")
    before = spark.conf.get(FREED, None)
    for shares in (1, 7):
        found = kept(rows, "key", shares, new_folder(spark, "rows"))
        assert found.schema == rows.schema and found.exceptAll(rows).isEmpty() and rows.exceptAll(found).isEmpty()
        assert found.count() == 203
    assert spark.conf.get(FREED, None) == before
    assert kept(rows.limit(0), "key", 3, new_folder(spark, "rows")).isEmpty()
