"""Null ids, repeated rows and empty tables; what each method adds beyond the fixed rules; the pipeline stage by stage."""

from __future__ import annotations

import zlib

import brute
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from samples import BASE, HARD, frame

import corpus_pipeline
from meterlark.llm import entries, pii, secrets
from meterlark.llm._coder import coder
from meterlark.llm.components import components
from meterlark.llm.decontaminate import decontaminate
from meterlark.llm.language import fit_centroids, identify_language
from meterlark.llm.near_dedup import near_duplicates
from meterlark.llm.packing import pack, patterns
from meterlark.llm.pii import find_pii
from meterlark.llm.quality import clean_lines, judge_quality
from meterlark.llm.secrets import scan_secrets
from meterlark.llm.substrings import find_repeats
from meterlark.llm.token_counts import count_tokens
from meterlark.llm.url_lists import filter_urls, validity

PATH = public_tokenizers.path("byte_bpe_50k.json")
REPEATED = [(1, BASE), (1, BASE), (None, BASE), (None, "other words"), (3, None), (None, None), (4, ""), (5, "a b c")]


def operators(spark, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    return {
        "tokens": count_tokens(docs, PATH), "substrings": find_repeats(docs), "near": near_duplicates(docs), "decontaminate": decontaminate(docs, items), "pii": find_pii(docs), "quality": judge_quality(docs, cleaned=True),
        "language": identify_language(docs, fit_centroids(docs)), "secrets": scan_secrets(docs, redact=True), "packing": pack(docs, PATH),
    }


def test_nulls_and_repeats(spark):
    docs = frame(spark, REPEATED, extra=True)
    for name, out in operators(spark, docs).items():
        rows = out.collect()
        assert len(rows) == len(REPEATED), name
        assert sum(r["doc_id"] is None for r in rows) == 3, name
    near = near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near if r["doc_id"] in (1, 5)) == [(1, 1, True), (1, 1, True), (5, 5, True)]
    assert any(r["doc_id"] is None and r["component_id"] == 1 and not r["kept"] for r in near)
    removed = {(r["doc_id"], r["n_removed"]) for r in find_repeats(docs).collect()}
    assert (1, 0) in removed and (None, 60) in removed


def test_empty_tables(spark):
    docs = frame(spark, [], extra=True)
    for name, out in operators(spark, docs).items():
        assert out.count() == 0, name
    some = frame(spark, [(1, BASE)])
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:] for r in decontaminate(some, none).collect()] == [(60, 0, 0, "", False)]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (9, 9), (None, 4)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(chain).collect()} == {(i, 100) for i in range(100, 161)} | {(3, 3), (7, 3)}


@pytest.mark.parametrize("text", [t for _, t in HARD if t] + ["a\n\n  b", " x", "don't  stop's", "ﬁne ½ ①", "a b　 c", "\r\n\r\n x \t\t y "])
def test_ids_of_whole_texts(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    got = coder(PATH).ids(text)
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == want
    assert coder(PATH).count(text) == len(want)


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(frame(spark), path).collect()}
    assert got == {i: len(library.encode(t or "")) for i, t in HARD}


def test_patterns_use_every_piece():
    histogram = {2048: 3, 1500: 7, 548: 5, 400: 20, 1: 100}
    found = patterns(histogram, 2048)
    assert {n: sum(c * p.count(n) for p, c in found) for n in histogram} == histogram
    assert max(sum(p) for p, _ in found) <= 2048


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("please email bob.stone (at) mail.example.org soon", "email", "bob.stone (at) mail.example.org"), ("tel: (030) 123-4567 ok", "phone", "(030) 123-4567"), ("server 10[.]1[.]2[.]3 crashed", "ip", "10[.]1[.]2[.]3"),
    ("my visa 4012_8888_8888_1881 was charged", "card", "4012_8888_8888_1881"), ("there were 12 345 678 people in 2003", None, None), ("order no 123456789 shipped on 2020-01-02", None, None), ("section 4.2 of 1999 has 17 pages", None, None),
])
def test_the_field_adds_spans(text, kind, found):
    spans = [(k, text[a:b]) for k, a, b in pii.field_spans(pii.train(), text)]
    assert spans == ([(kind, found)] if kind else [])


def test_viterbi_is_the_best_labelling():
    from itertools import product

    field = pii.train()
    words = "call (030) 123-4567 at noon".split()
    score = field.scores(words)
    best = max(product(range(len(pii.LABELS)), repeat=len(words)), key=lambda y: sum(score[i, t] for i, t in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:], strict=False)))
    assert field.decode([words])[0] == list(best)


def test_clean_documents_gain_no_spans(spark):
    clean = [(i, f"On page {i} of 1998 the {i * 37} readers saw chapter {i}.2 and 12 plates, 3 to 7 of them in colour.") for i in range(50)]
    assert {r["spans"] for r in find_pii(frame(spark, clean)).collect()} == {""}
    assert {r["spans"] for r in scan_secrets(frame(spark, clean)).collect()} == {""}


@pytest.mark.parametrize(("text", "hit"), [
    ("key Zx9Qw7Lp3Vt8Rk2Nm5Yb1Hc6 end", True), ("id 123e4567-e89b-12d3-a456-426614174000 end", False), ("aaaaaaaaaaaaaaaaaaaaaaaaaaaa1", False), ("some-long-words-joined-by-marks-here", False), ("20240101_20240102_20240103", False),
])
def test_entropy(text, hit):
    assert bool(secrets.entropy_spans(text)) == hit


def test_sliding_entropy_equals_recounting():
    import math
    from collections import Counter

    text = "aab9Zx9Qw7Lp3Vt8Rk2Nm5aaaaaaaaaaaaaaaaaaaaaaab1Hc6"
    least, n = 3.5, 20
    entropy = lambda s: -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    covered = {k for i in range(len(text) - n + 1) if entropy(text[i : i + n]) >= least for k in range(i, i + n)}
    assert {k for a, b in secrets.high_entropy(text, least) for k in range(a, b)} == covered


def test_line_rules():
    text = "A good line of plain words.\nHome | About | Login | Help\nAll rights reserved by someone\nA good line of plain words.\nTHIS IS ALL SHOUTED NOW\nMenu\nAnother good line stands here, too."
    clean, stays, removed, repeated = clean_lines(text, 0.5, 10)
    assert clean == "A good line of plain words.\nAnother good line stands here, too." and removed == 5 and repeated == 1
    assert not stays  # too much went


def test_quality_follows_labels(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    n = {(r["quality"], r["kept"]): r["count"] for r in entries.op7_quality_rules(spark, SMALL).join(labels, "doc_id").where("quality is not null").groupBy("quality", "kept").count().collect()}
    good = n.get((1, True), 0) / max(1, n.get((1, True), 0) + n.get((1, False), 0))
    assert good >= 0.95 and n.get((0, True), 0) <= 0.1 * sum(v for k, v in n.items() if k[0] == 0)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    found = entries.op8_language_id(spark, SMALL).join(docs, "doc_id").collect()
    held = [r for r in found if r["held_out"] and r["lang"] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    odd = identify_language(frame(spark, [(1, None), (2, "123 ..."), (3, "")]), fit_centroids(spark.read.parquet(f"{SMALL}/documents.parquet")))
    assert {(r["lang_pred"], r["rejected"]) for r in odd.collect()} == {("und", True)}


def test_validity(spark):
    rows = [("l", "A.com", "add", 1), ("l", "a.com", "add", 2), ("l", "a.com", "remove", 5), ("l", "a.com", "remove", 6), ("l", "a.com", "add", 6), ("l", "b.org", "remove", 1), (None, "b.org", "add", 1)]
    entries_ = spark.createDataFrame(rows, "list string, domain string, action string, at int")
    assert sorted(map(tuple, validity(entries_).collect()), key=str) == [("l", "a.com", 1, 5), ("l", "a.com", 6, None)]
    captures = spark.createDataFrame([(1, "https://x.A.com:80/p", 4), (2, "http://a.com", 5), (3, "http://a.com.", 9), (4, None, 1), (5, "nonsense", 1), (None, "http://a.com", None), (1, "https://x.A.com:80/p", 4)], "page_id long, url string, fetched_at int")
    got = sorted(((r["page_id"], r["blocked"], r["matched"]) for r in filter_urls(captures, entries_).collect()), key=str)
    assert got == sorted([(1, True, "l:a.com"), (1, True, "l:a.com"), (2, False, ""), (3, True, "l:a.com"), (4, False, ""), (5, False, ""), (None, False, "")], key=str)


def test_pipeline_stages(spark):
    """Each stage on its own input, against plain Python; at the end every id of every document left is packed."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    texts = list(rows.items())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.settled(stage(spark, docs, SMALL), name)
        assert out.columns == columns, name
        left = dict(out.select("doc_id", "text").collect())
        before = dict(texts)
        if name == "near_dedup":
            assert set(left) == {i for i, _, _, kept in brute.near(texts, 80, 100) if kept}
        elif name == "decontamination":
            assert set(left) == {r[0] for r in brute.contamination(texts, items) if not r[5]}
        elif name == "language_id":
            assert set(before) - set(left) <= {i for i, t in texts} and all(any(map(str.isalpha, t)) for t in left.values())
            assert len(left) >= 0.95 * sum(any(map(str.isalpha, t or "")) for _, t in texts)
        else:
            assert set(left) == set(before) and all(brute.secrets([(1, t)])[0][1:4] == (0, 0, 0) or "[SECRET]" in t for t in left.values())
        docs, texts = out, list(left.items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    brute.packed_rightly(texts, [tuple(r) for r in pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()], PATH)


def test_struct_columns_leave_the_rest_alone(spark):
    docs = frame(spark, [(1, "plain words here for the test")]).withColumn("spans", F.lit("mine"))
    assert docs.withColumn("s", secrets.secrets_of(F.col("text"), redact=True)).select("spans", "s.spans", "s.redacted").first() == ("mine", "", "plain words here for the test")


def test_copies_in_a_large_node(spark):
    """A family of near copies above one block, with near misses beside it, equals plain union-find."""
    import random

    rng = random.Random(2)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(80)] = f"x{rng.randrange(5000)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows)).collect()}
    want = {i: c for i, _, c, _ in brute.near(rows)}
    assert got == want
