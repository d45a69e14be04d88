"""Each operator's query on small tables and hard rows against plain Python; every case the docstrings define."""

from __future__ import annotations

import brute
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from samples import HARD, frame

from meterlark.llm import entries
from meterlark.llm.decontaminate import decontaminate
from meterlark.llm.near_dedup import near_duplicates
from meterlark.llm.packing import pack
from meterlark.llm.pii import find_pii
from meterlark.llm.quality import judge_quality
from meterlark.llm.secrets import scan_secrets
from meterlark.llm.substrings import find_repeats
from meterlark.llm.token_counts import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ITEMS = [(1, " ".join(["bench%d mark" % i for i in range(30)])), (2, "short item here"), (3, None), (4, ""), (10, "tail of three"), (None, "spaces and lines")]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def wanted(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def small():
    t = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(*(t.column(c).to_pylist() for c in t.column_names), strict=True))


@pytest.fixture(scope="module")
def hard(spark):
    return frame(spark, extra=True)


def test_token_counts(spark, small, hard):
    columns = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert rows_of(entries.op1_token_counts(spark, SMALL), *columns) == wanted(brute.token_counts(small, PATH))
    assert rows_of(count_tokens(hard, PATH), *columns) == wanted(brute.token_counts(HARD, PATH))


def test_substring_dedup(spark, small, hard):
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert rows_of(entries.op2_substring_dedup(spark, SMALL), *columns) == wanted(brute.substrings(small))
    found = find_repeats(hard).withColumn("kept_sha256", entries.hashed("kept_text"))
    assert rows_of(found, *columns) == wanted(brute.substrings(HARD))


def test_near_duplicates(spark, small, hard):
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows_of(entries.op3_near_dedup(spark, SMALL), *columns) == wanted(brute.near(small))
    assert rows_of(near_duplicates(hard), *columns) == wanted(brute.near(HARD))


def test_decontamination(spark, small, hard):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    t = pq.read_table(f"{SMALL}/benchmark.parquet")
    items = list(zip(t.column("item_id").to_pylist(), t.column("text").to_pylist(), strict=True))
    assert rows_of(entries.op5_decontamination(spark, SMALL), *columns) == wanted(brute.contamination(small, items))
    bench = spark.createDataFrame([(i, x, 1) for i, x in ITEMS], "item_id long, text string, doc_id long")
    found = decontaminate(hard, bench).withColumn("items_sha256", entries.hashed("items"))
    assert rows_of(found, *columns) == wanted(brute.contamination(HARD, [("" if i is None else i, x) for i, x in ITEMS]))


def test_personal_data(spark, small, hard):
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert rows_of(entries.op6_personal_data(spark, SMALL), *columns) == wanted(brute.personal(small))
    assert rows_of(find_pii(hard).withColumn("base_sha256", entries.hashed("base")), *columns) == wanted(brute.personal(HARD))


def test_quality(spark, small, hard):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(entries.op7_quality_rules(spark, SMALL), *columns) == wanted(brute.quality_base(small))
    found = judge_quality(hard)
    assert rows_of(found, *columns) == wanted(brute.quality_base(HARD))
    assert not found.where("kept and base_failed").count()


def test_secrets(spark, small, hard):
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    assert rows_of(entries.op10_secret_scans(spark, SMALL), *columns) == wanted(brute.secrets(small))
    assert rows_of(scan_secrets(hard).withColumn("base_sha256", entries.hashed("base")), *columns) == wanted(brute.secrets(HARD))


def test_packing(spark, small, hard):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sequences, tokens = brute.packed_rightly(small, rows_of(entries.op9_packing(spark, SMALL), *columns), PATH)
    assert tokens > 0.97 * 2048 * sequences  # little padding
    brute.packed_rightly(HARD, rows_of(pack(hard, PATH), *columns), PATH)


def test_url_filters_and_decontamination_equal_sql(spark):
    from comparing import by_duckdb, by_spark

    for name, sql in entries.SQL.items():
        assert by_spark(entries.QUERIES[name](spark, SMALL)) == by_duckdb(sql, SMALL), name
