"""Long texts, hot rows and clashing columns for every operator and stage; methods held against plain forms of themselves."""

from __future__ import annotations

import os
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from samples import BASE, PASSAGE, frame

import corpus_pipeline
from meterlark.llm import _shared, _spans, decontaminate, language, packing, pii, url_lists
from meterlark.llm._coder import coder
from meterlark.llm.near_dedup import near_duplicates
from meterlark.llm.quality import judge_quality
from meterlark.llm.secrets import scan_secrets
from meterlark.llm.substrings import find_repeats
from meterlark.llm.token_counts import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ITEMS = [(1, PASSAGE), (2, "a short one")]


def long_texts():
    """One line of words, many lines, one line of numbers, a single word, digits, blanks, a short document."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    words = " ".join(word() for _ in range(60_000))
    return [
        (1, words), (2, "\n".join(f"line {i} has {i * 37} words of {word()}." for i in range(20_000))), (3, " ".join(str(rng.randrange(10**6)) for _ in range(40_000))), (4, "x" * 400_000), (5, "7" * 400_000), (6, " " * 200_000 + "\n" * 200_000),
        (7, words[: len(words) // 2] + " mail a.b@c.example and token=abcdef123456 " + PASSAGE), (8, BASE), (9, "Zx9Qw7Lp" * 50_000), (10, "a@" * 100_000 + "+1 " * 50_000), (11, None),
    ]


@pytest.fixture(scope="module")
def long_rows():
    return long_texts()


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_long_texts(spark, long_rows):
    docs, by_id = frame(spark, long_rows), dict(long_rows)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    wanted = lambda rows: sorted(map(tuple, rows), key=repr)
    assert as_rows(count_tokens(docs, PATH), "doc_id", "n_bytes", "n_tokens", "over_limit") == wanted(brute.token_counts(long_rows, PATH))
    found = find_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h"))
    assert as_rows(found, "doc_id", "n_words", "n_removed", "h") == wanted(brute.substrings(long_rows))
    assert as_rows(near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == wanted(brute.near(long_rows))
    judged = decontaminate.decontaminate(docs, items).withColumn("h", F.sha2("items", 256))
    assert as_rows(judged, "doc_id", "n_words", "n_hit", "n_items", "h", "contaminated") == wanted(brute.contamination(long_rows, ITEMS))
    assert as_rows(judge_quality(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == wanted(brute.quality_base(long_rows))
    assert as_rows(scan_secrets(docs).withColumn("h", F.sha2("base", 256)), "doc_id", "n_assign", "n_access", "n_hex", "h") == wanted(brute.secrets(long_rows))
    private = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert private[7]["n_email"] == 1 and private[11]["spans"] == "" and not any(private[i]["n_email"] for i in (1, 3, 4, 5, 6, 8, 10))
    for i in (2, 8):  # the plain pattern is quadratic in the others
        assert [(i, *(private[i][f"n_{k}"] for k in pii.KINDS))] == [r[:5] for r in brute.personal([(i, by_id[i])])]
    pieces = packing.pack(docs, PATH)
    brute.packed_rightly(long_rows, [tuple(r) for r in pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()], PATH)
    model = language.fit_centroids(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify_language(docs, model).collect() if r["doc_id"] in (5, 6, 11)} == {5: "und", 6: "und", 11: "und"}
    pages = spark.createDataFrame([(1, "http://" + "a." * 3000 + "com/", 3), (2, "http://x.a.com/" + "p" * 10**6, 3)], "page_id long, url string, fetched_at int")
    entries = spark.createDataFrame([("l", "a.com", "add", 1)], "list string, domain string, action string, at int")
    assert [r["blocked"] for r in url_lists.filter_urls(pages, entries).orderBy("page_id").collect()] == [True, True]


def test_hot_rows(spark):
    """A third of all rows are one row, or have neither id nor text."""
    rows = [(1, BASE)] * 400 + [(None, None)] * 400 + [(None, BASE)] * 100 + [(i, f"{BASE} tail {i}") for i in range(2, 302)]
    docs = frame(spark, rows)
    assert Counter(r["n_removed"] for r in find_repeats(docs).where("doc_id = 1 or doc_id is null").collect()) == {0: 800, 60: 100}
    near = near_duplicates(docs).groupBy("component_id", "kept").count().collect()
    assert {(r["component_id"], r["kept"]): r["count"] for r in near} == {(1, True): 400, (1, False): 400, (None, True): 400}
    pieces = packing.pack(docs, PATH)
    assert pieces.count() == len(rows) and pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert pieces.select("sequence_id", "offset").distinct().count() == len(rows)
    hit = decontaminate.decontaminate(docs, spark.createDataFrame([(1, BASE)], "item_id long, text string"))
    assert Counter(r["n_hit"] for r in hit.collect()) == {60: 800, 0: 400}


def test_the_windows_of_a_large_benchmark_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    docs = [(1, PASSAGE), (2, BASE), (None, f"before {PASSAGE} after"), (4, None)]
    found = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame([*ITEMS, (3, None)], "item_id long, text string")).withColumn("h", F.sha2("items", 256))
    assert as_rows(found, "doc_id", "n_words", "n_hit", "n_items", "h", "contaminated") == sorted(map(tuple, brute.contamination(docs, ITEMS)), key=repr)


def test_the_shuffled_join_with_a_benchmark_has_no_python(spark):
    plan = decontaminate.decontaminate(frame(spark, [(1, BASE)]), spark.createDataFrame(ITEMS, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def plain_packs(lengths, size):
    """Shortest pack first, piece by piece: the fills of all packs."""
    packs: list[int] = []
    for n in sorted(lengths, reverse=True):
        i = min(range(len(packs)), key=packs.__getitem__, default=None)
        if i is None or packs[i] + n > size:
            packs.append(n)
        else:
            packs[i] += n
    return sorted(packs)


def test_packs_equal_the_method_piece_by_piece():
    rng = random.Random(6)
    for size in (10, 64, 2048):
        for _ in range(60):
            lengths = [rng.randint(1, size) if rng.random() < 0.5 else rng.randint(1, max(1, size // 6)) for _ in range(rng.randint(0, 60))]
            made = packing.patterns(dict(Counter(lengths)), size)
            assert sorted(sum(p) for p, n in made for _ in range(n)) == plain_packs(lengths, size)
            assert Counter(x for p, n in made for _ in range(n) for x in p) == Counter(lengths)


def test_spans_in_one_pass():
    rng = random.Random(2)
    for _ in range(300):
        make = lambda n: [("k", a, a + rng.randint(1, 8)) for a in (rng.randrange(60) for _ in range(n))]
        some, known = make(rng.randint(0, 8)), make(rng.randint(0, 8))
        taken = {i for _, a, b in known for i in range(a, b)}
        assert sorted(_spans.free_of(some, known)) == sorted(s for s in some if not taken & set(range(s[1], s[2])))
        for (_, a, b), parts in _spans.uncovered(some, known):
            assert {i for _, x, y in parts for i in range(x, y)} == set(range(a, b)) - taken
            assert all(x < y for _, x, y in parts)


def obfuscated(rng):
    """Personal data in forms that the fixed patterns don't know."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.choice(pii.KINDS)
    if kind == "email":
        user, host, top = word(), word(), rng.choice(["com", "org", "net", "de"])
        shown = rng.choice(["{} (at) {}.{}", "{} [at] {}.{}", "{} [at] {} [dot] {}", "{} (at) {} (dot) {}"]).format(user, host, top)
    elif kind == "ip":
        shown = rng.choice(["[.]", "(.)", " . ", "[dot]"]).join(str(rng.randint(1, 255)) for _ in range(4))
    elif kind == "card":
        body = str(rng.randint(1, 9)) + digits(14)
        body += next(c for c in "0123456789" if pii.luhn(body + c))
        shown = rng.choice("_/.").join(body[i : i + 4] for i in range(0, 16, 4))
    else:
        shown = rng.choice([f"(0{digits(2)}) {digits(3)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0044 {digits(2)} {digits(4)} {digits(4)}", f"0{digits(2)}-{digits(7)}"])
    cue = rng.choice({"email": ["mail", "contact", "write to"], "ip": ["host", "server", "address"], "card": ["card", "visa", "paid with"], "phone": ["call", "tel.", "phone:"]}[kind])
    some = lambda: " ".join(word() for _ in range(rng.randint(0, 8)))
    return kind, shown, f"{some()} {cue} {shown} {some()}".strip()


def test_the_field_finds_obfuscated_data_and_little_else(spark):
    rng = random.Random(5)
    planted = [obfuscated(rng) for _ in range(400)]
    plain = [f"On {rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2020)} they counted {rng.randint(2, 10**6)} and {rng.randint(2, 99)} of {rng.randint(100, 999)} in room {rng.randint(1, 400)}." for _ in range(400)]
    rows = [(i, text) for i, text in enumerate([t for _, _, t in planted] + plain)]
    found = {r["doc_id"]: r for r in pii.find_pii(frame(spark, rows)).collect()}
    spans = lambda i: {(k, rows[i][1][int(a) : int(b)]) for k, a, b in (s.split(":") for s in found[i]["spans"].split(",") if s)}
    base = lambda i: set(found[i]["base"].split(",")) - {""}
    caught = sum((kind, shown) in spans(i) for i, (kind, shown, _) in enumerate(planted))
    added = sum(found[i]["n_spans"] - len(base(i)) for i in range(len(planted)))
    assert caught >= 0.9 * len(planted) and caught >= 0.9 * added
    assert sum(len(base(i)) for i in range(len(planted))) <= 0.1 * len(planted)  # the fixed patterns alone find few of them
    assert sum(found[i]["n_spans"] > 0 for i in range(len(planted), len(rows))) <= 4


def test_the_field_learns_from_a_table(spark):
    """Another labelled table makes another field: here numbers after `ring` are phones."""
    lines = [line for n in range(12) for line in ([("ring", ""), (f"55{n}-0{n}42", "phone"), ("now", "")], [("page", ""), (f"55{n}-0{n}42", ""), ("is", ""), ("out", "")])]
    table = spark.createDataFrame([(i, j, w, k) for i, line in enumerate(lines) for j, (w, k) in enumerate(line)] + [(None, 0, "x", ""), (99, 0, None, "")], "line long, place long, word string, kind string")
    assert len(pii.lines_of(table)) == len(lines) and len(pii.lines_of(table, most=5)) == 5
    found = pii.find_pii(frame(spark, [(1, "please ring 555-0999 now"), (2, "see page 555-0999 is out")]), labelled=table)
    assert {r["doc_id"]: r["spans"] for r in found.collect()} == {1: "phone:12:20", 2: ""}


def test_long_lines_are_decoded_as_short_ones():
    field = pii.train()
    words = ("we met at noon and " * 30 + "call (030) 123-4567 or mail joe (at) mail.example.org at once " + "the cat sat on it " * 30).split()
    whole = field._best([words])[0]
    assert field.decode([words, words[:7], words])[0] == whole and field.decode([words[:7]])[0] == field._best([words[:7]])[0]


def test_languages_equal_plain_cosines(spark):
    """Predictions against trigram counts and cosines told with dictionaries."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit_centroids(docs)

    def plain(text):
        data = text.lower().encode()
        kept = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for i, c in enumerate(data) if not (c in b" \t\n\x0b\x0c\r" and i and data[i - 1] in b" \t\n\x0b\x0c\r"))
        shift = 33 - language.WIDTH.bit_length()
        n = Counter((((kept[i] << 16 | kept[i + 1] << 8 | kept[i + 2]) * 0x9E3779B1) % 2**32) >> shift for i in range(len(kept) - 2))
        x = {f: float(np.log1p(np.float32(c)) * model.idf[f]) for f, c in n.items()}
        size = sum(v * v for v in x.values()) ** 0.5 or 1.0
        cosines = [sum(v * float(centre[f]) for f, v in x.items()) / size for centre in model.vectors]
        best = max(range(len(cosines)), key=lambda j: cosines[j])
        return model.languages[best], cosines

    found = {r["doc_id"]: r for r in language.identify_language(docs, model).collect()}
    for r in docs.where("text is not null").limit(60).collect():
        if any(map(str.isalpha, r["text"])):
            lang, cosines = plain(r["text"])
            assert abs(found[r["doc_id"]]["score"] - max(0.0, min(1.0, max(cosines)))) < 1e-4
            assert found[r["doc_id"]]["lang_pred"] == lang or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-5


CLASHING = ("_id", "_n", "_key", "_shared", "_h", "_k", "id", "n", "f", "equal", "unknown", "component_id", "n_shingles", "kept", "rejected", "redacted", "spans", "contaminated", "items", "key", "node", "a", "b", "length", "start", "_row", "_salt", "lang_pred")


def clashing(spark, rows):
    docs = frame(spark, rows)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(1))
    return docs


def test_stages_on_odd_tables(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    english = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en' and length(text) between 200 and 2000").limit(6).collect()]
    rows = [(1, english[0]), (1, english[0]), (2, None), (None, None), (None, english[1]), (3, ""), (4, english[2] + " " + PASSAGE), (5, english[3] + " password=abcdef12 end"), (None, english[4])]
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = clashing(spark, rows)
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        left[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
        empty = stage(spark, clashing(spark, []), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0, name
    ordered = lambda some: sorted(some, key=repr)
    assert left["language_id"] == ordered(r for r in rows if r[1])
    assert left["near_dedup"] == ordered(rows[1:])
    assert left["decontamination"] == ordered(r for r in rows if r[0] != 4)
    assert left["secret_scan"] == ordered((i, t if i != 5 else english[3] + " [SECRET] end") for i, t in rows)
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, clashing(spark, rows), "").select("doc_id", "start").count() >= len(rows) and pack(spark, clashing(spark, []), "").count() == 0
    slim = frame(spark, rows).select("doc_id", "text")
    assert corpus_pipeline.secret_scan(spark, slim, "").columns == ["doc_id", "text"]


def test_the_near_dedup_stage_takes_copies_from_four_fifths_on(spark):
    from test_whole_job import families

    rows = families(5, 10, 110, 40, 4)
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert left == {i for i, _, _, kept in brute.near(rows, 80, 100) if kept} != {i for i, _, _, kept in brute.near(rows) if kept}


def test_urls_with_address_literals_and_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://[2001:DB8::1]:8080/x", 2), (2, "http://[2001/x", 2), (3, "http://u@a.com", 2)], "page_id long, url string, fetched_at int")
    entries = spark.createDataFrame([("l", "[2001:db8::1]", "add", 1)], "list string, domain string, action string, at int")
    assert [(r["host"], r["blocked"]) for r in url_lists.filter_urls(captures, entries).orderBy("page_id").collect()] == [("[2001:db8::1]", True), (None, False), ("a.com", False)]
    assert url_lists.filter_urls(captures.where("page_id < 0"), entries).count() == 0
    assert {r["n_entries"] for r in url_lists.filter_urls(captures, entries.where("at < 0")).collect()} == {0}


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _shared.shared_folder(Unset)


def test_working_tables_go(spark):
    folder = _shared.shared_folder(spark).removeprefix("file:") + "/meterlark"
    tables = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = tables()
    with _shared.scratch(spark):
        out = near_duplicates(frame(spark, [(1, BASE), (2, BASE + " x"), (3, "other words")]))
        inside = {t.rsplit("-", 1)[0] for t in tables() - before}
        assert inside <= {"sketches", "sets", "roots"}
        assert out.count() == 3
    assert tables() == before


def test_pre_tokens_are_looked_up_and_only_the_rest_is_merged(monkeypatch):
    made = coder(PATH)
    merged = []
    monkeypatch.setattr(made, "merged", lambda token, real=made.merged: merged.append(token) or real(token))
    assert made.count("Hello, the world. don't zqxjv the-the") == len(__import__("tokenizers").Tokenizer.from_file(PATH).encode("Hello, the world. don't zqxjv the-the", add_special_tokens=False).ids)
    assert merged == [" zqxjv"]


def test_remembered_chunks_are_bounded(monkeypatch):
    from meterlark.llm import _coder

    monkeypatch.setattr(_coder, "REMEMBERED", 20_000)
    made = coder(PATH)
    text = " ".join(f"w{i}x" for i in range(5000))
    assert made.ids(text) == coder(PATH).ids(text)
    assert len(made.spaced) + len(made.spaced.older) < 250
