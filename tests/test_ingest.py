"""Transcripts and rollouts to usage rows: line rules, folds, any cut into passes, streams against batches."""

from __future__ import annotations

import json
import re
import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from comparing import plain
from pyspark.sql import functions as F

from meterlark.functions.keys import ledger_key_of
from meterlark.sources import rollouts, transcripts
from meterlark.sources.ledger import only_in_ledger, read_ledger
from meterlark.streaming import ingest, states
from meterlark.streaming.lines import register


def line_a(i, *, ts="2026-06-01T00:00:00.000Z", out=5, model="claude-x-1", message="", **more):
    usage = {"input_tokens": 10, "output_tokens": out, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 4} | more.pop("usage", {})
    return json.dumps({"type": "assistant", "requestId": f"r{i}", "uuid": f"u{i}", "timestamp": ts, "message": {"id": f"m{i}" if message == "" else message, "model": model, "usage": usage}} | more)


def frame(spark, lines, path="/x/projects/a.jsonl"):
    return spark.createDataFrame([(path, i, v) for i, v in enumerate(lines)], "path string, line_no long, value string")


def by_key(df):
    return {r["key"]: r for r in df.collect()}


def test_line_rules(spark):
    cases = {
        "plain": (line_a(1), ("m1", 10, 5, 3, 4, None, None, 0)),
        "buckets": (line_a(2, usage={"cache_creation": {"ephemeral_5m_input_tokens": 6, "ephemeral_1h_input_tokens": 1}, "cache_creation_input_tokens": 0}), ("m2", 10, 5, 3, 7, 6, 1, 0)),
        "odd numbers": (line_a(3, usage={"input_tokens": True, "output_tokens": 5.0, "cache_read_input_tokens": "9", "speed": "fast"}), ("m3", 1, 0, 0, 4, None, None, 1)),
    }
    lines = [v[0] for v in cases.values()] + [line_a(4, model="<synthetic>"), '{"type": "assistant", "usage": broken', line_a(5, type="user"), line_a(6, model=[1]), ""]
    found = by_key(transcripts.parse(frame(spark, lines)))
    assert len(found) == 3
    odd = by_key(transcripts.parse(frame(spark, [line_a(7, message=True, requestId=12), line_a(8, message=0), line_a(9, requestId=None)])))
    assert set(odd) == {ledger_key_of(x) for x in ("c\x1f12\x1fTrue", "u\x1fu8", "c\x1f\x1fm9")}
    for _, (message, *counts) in cases.values():
        r = found[ledger_key_of(f"c\x1fr{message[1:]}\x1f{message}")]
        assert [r[c] for c in transcripts.COUNTS] == counts
    assert [tuple(r) for r in transcripts.stats(frame(spark, lines)).collect()] == [("/x/projects/a.jsonl", 8, 7, 2, 3, 0)]


def test_fold_takes_the_first_timed_line_and_later_maxima(spark):
    lines = [line_a(1, ts=None, out=99), line_a(1, out=5), line_a(1, out=7, ts="2026-06-02T00:00:00Z"), line_a(2, ts="bad", out=1)]
    rows = transcripts.folded(transcripts.parse(frame(spark, lines))).collect()
    assert [(r["ts"], r["outp"]) for r in rows] == [(1780272000000, 7)]
    known = spark.createDataFrame([(ledger_key_of("c\x1fr2\x1fm2"),)], "key long")
    assert {r["outp"] for r in transcripts.folded(transcripts.parse(frame(spark, lines)), known).collect()} == {7, 1}


def plain_timestamp(text):
    """Epoch ms by the standard library; 24:00 is the next midnight, no offset is UTC, half to even."""
    if not text:
        return None
    text, ahead = re.subn(r"(?<=[T ])24:00(:00(?:[.,]0+)?)?(?=$|Z|[+-])", "00:00", text)
    try:
        at = datetime.fromisoformat(text) + timedelta(days=ahead)
    except (ValueError, OverflowError):
        return None
    micros = (at if at.tzinfo else at.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)
    whole, rest = divmod(micros // timedelta(microseconds=1), 1000)
    return whole + (rest > 500 or (rest == 500 and whole % 2))


def test_times_of_random_shapes(spark):
    from meterlark.functions.timestamps import timestamp_ms

    rng = random.Random(3)

    def one():
        y, mo, d, w, k = rng.choice([1969, 1999, 2000, 2024, 2026, rng.randint(1, 9990)]), rng.randint(0, 13), rng.randint(0, 32), rng.randint(0, 54), rng.randint(0, 8)
        day = rng.choice([f"{y:04}-{mo:02}-{d:02}", f"{y:04}{mo:02}{d:02}", f"{y:04}-W{w:02}-{k}", f"{y:04}-W{w:02}", f"{y:04}W{w:02}{k}", f"{y:04}-{mo:02}{d:02}"])
        h, mi, sec, f = rng.choice([0, 5, 23, 25]), rng.choice([0, 30, 59, 60]), rng.choice([0, 1, 59, 60]), rng.choice(["", ".5", ",25", ".0005", ".0015", ".1234567"])
        time = rng.choice([f"{h:02}", f"{h:02}:{mi:02}", f"{h:02}:{mi:02}:{sec:02}{f}", f"{h:02}{mi:02}{sec:02}{f}", f"{h:02}:{mi:02}{sec:02}", "24:00", "24:00:00"])
        return day + rng.choice(["", rng.choice("T x") + time + rng.choice(["", "Z", "+01:00", "-0530", "+02", "+24:00", "z"]), "T"])

    texts = [one() for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select(timestamp_ms(F.col("t")).alias("ms"), "i").orderBy("i").select("ms").collect()]
    want = [plain_timestamp(t) for t in texts]
    assert [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w] == [] and sum(w is not None for w in want) > 500


@pytest.mark.parametrize(("text", "ms"), [
    ("2026-06-01T00:00:00.000Z", 1780272000000), ("2026-W23-1", 1780272000000), ("20260601T000000+0100", 1780268400000), ("2026-06-01 00:00", 1780272000000), ("2026-05-31T24:00:00Z", 1780272000000),
    ("2026-06-01T00:00:00.0005Z", 1780272000000), ("2026-06-01T00:00:00.0015Z", 1780272000002), ("nonsense", None), ("", None), (None, None),
])
def test_timestamps(spark, text, ms):
    from meterlark.functions.timestamps import timestamp_ms

    assert plain_timestamp(text) == ms
    assert spark.createDataFrame([(text,)], "t string").select(timestamp_ms(F.col("t"))).first()[0] == ms


def count_b(total, last, ts):
    named = lambda x: None if x is None else dict(zip(rollouts.TRIPLE, x, strict=True))
    info = {k: v for k, v in (("total_token_usage", named(total)), ("last_token_usage", named(last))) if v is not None}
    return json.dumps({"type": "event_msg", "timestamp": f"2026-06-01T00:{ts // 60:02d}:{ts % 60:02d}.000Z", "payload": {"type": "token_count", "info": info}})


ROLLOUT = [
    json.dumps({"type": "session_meta", "timestamp": "2026-06-01T00:00:00Z", "payload": {}}),
    count_b((100, 40, 10), (100, 40, 10), 5), json.dumps({"type": "turn_context", "timestamp": "2026-06-01T00:00:06Z", "payload": {"model": "gpt-z"}}),
    count_b((100, 40, 10), (100, 40, 10), 7), count_b((150, 60, 15), (50, 20, 5), 8), count_b((20, 5, 3), (20, 5, 3), 9), count_b(None, (7, 9, 2), 10),
]


def test_counter_advance(spark):
    path = "/x/sessions/rollout-2026-01-01-00000000-0000-0000-0000-00000000000a.jsonl"
    rows = rollouts.usage_rows(rollouts.parse(frame(spark, ROLLOUT, path)))
    got = sorted((r["ts"] % 100_000 // 1000, r["inp"], r["outp"], r["cr"], r["model"]) for r in rows.collect())
    assert got == [(5, 60, 10, 40, "gpt-z"), (8, 30, 5, 20, "gpt-z"), (9, 15, 3, 5, "gpt-z"), (10, 0, 2, 7, "gpt-z")]


def test_keys_tell_truth_values(spark):
    line = count_b((True, 0, 9), (True, False, 9), 5)
    path = "/x/sessions/s.jsonl"
    row = rollouts.usage_rows(rollouts.parse(frame(spark, ["{}", line], path))).first()
    assert row["key"] == ledger_key_of("x\x1fs\x1f2026-06-01T00:00:05.000Z\x1fTrue,0,9\x1fTrue,False,9") and (row["inp"], row["outp"]) == (1, 9)


def test_children_do_not_repeat_their_parents(spark):
    ids = [f"00000000-0000-0000-0000-00000000000{x}" for x in "ab"]
    meta = json.dumps({"type": "session_meta", "timestamp": "2026-06-01T00:01:00Z", "payload": {"forked_from_id": ids[0]}})
    child = [meta, *ROLLOUT[1:5], count_b((300, 60, 30), (150, 0, 15), 90)]
    lines = frame(spark, ROLLOUT, f"/x/sessions/r-{ids[0]}.jsonl").union(frame(spark, child, f"/x/sessions/r-{ids[1]}.jsonl"))
    parsed = rollouts.parse(lines)
    own = [r for r in rollouts.usage_rows(parsed).collect() if ids[1] in r["path"]]
    assert [(r["inp"], r["outp"]) for r in own] == [(150, 15)]
    assert rollouts.dropped_keys(parsed).count() == 2


def test_stream_equals_batch_whatever_the_cuts(spark, tmp_path):
    rng = random.Random(5)
    root, log, check = tmp_path / "projects", str(tmp_path / "log"), str(tmp_path / "check")
    root.mkdir()
    lines = [line_a(rng.randrange(12), out=rng.randrange(50), ts=rng.choice(["2026-06-01T00:00:00Z", "2026-06-02T10:00:00Z"])) for _ in range(40)]
    text = "\n".join(lines) + "\n" + '{"unfinished": '
    at = 0
    for cut in [*sorted(rng.sample(range(len(text)), 3)), len(text)]:
        with open(root / ".hidden.jsonl", "a") as f:
            f.write(text[at:cut])
        at = cut
        query = ingest.follow(spark, [str(root)], log, check, provider="a")
        assert query.awaitTermination(120)
        time.sleep(0.01)
    register(spark)
    accounts = spark.createDataFrame([(str(tmp_path), 1), (str(root), 2)], "root string, acct int")
    live = ingest.usage_of(spark.read.parquet(log), accounts, "a")
    batch = transcripts.folded(transcripts.parse(spark.read.format("appended_lines").option("path", str(root)).load()))
    columns = ["key", "ts", "model", "inp", "outp", "cr", "cc", "tier"]
    assert sorted(map(tuple, live.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
    assert {r["acct"] for r in live.collect()} == {2}
    assert spark.read.parquet(log).count() == 40

    from meterlark.operators import rollup

    work = ingest.on_batch(str(tmp_path / "log2"), accounts, "a", str(tmp_path / "rollup"))
    whole = spark.read.parquet(log).drop("day")
    for number, part in ((0, "line_no % 2 = 0"), (1, "line_no % 2 = 1"), (1, "line_no % 2 = 1")):  # the last one is run twice
        work(whole.where(part), number)
    kept = spark.read.parquet(str(tmp_path / "rollup")).select(*rollup.KEYS, *rollup.SUMS)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rollup.built(live).select(*rollup.KEYS, *rollup.SUMS).collect()))


def test_states_equal_windows(spark, tmp_path):
    path = "/x/sessions/s.jsonl"
    parsed = rollouts.parse(frame(spark, ROLLOUT, path))
    counts = parsed.where("counts and ts is not null").select("path", "line_no", "ts", "total", "last")
    for r in (counts.orderBy("line_no").collect()):
        spark.createDataFrame([r], counts.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(counts.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = states.advanced(stream).writeStream.format("memory").queryName("advanced_counts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert query.awaitTermination(180)
    got = sorted((r["line_no"], list(r["usage"])) for r in spark.table("advanced_counts").collect())
    assert got == sorted((r["line_no"], list(r["usage"])) for r in rollouts.advanced(parsed).collect())


def test_streamed_limit_events_equal_a_history(spark, tmp_path):
    from meterlark.operators import limit_events

    rng = random.Random(4)
    t0, rows = 1_705_752_000_000, []
    for i in range(120):
        at = t0 + i * 1_700_000
        rows.append(("a", "claude", at, "w", "L", rng.choice([0.2, 0.85, 1.0]), (at // 18_000_000 + 1) * 18_000_000 + rng.randrange(700), 300.0))
    schema = "identity string, provider string, at long, kind string, label string, utilization double, resets_at long, minutes double"
    for part in (rows[:50], rows[50:51], rows[51:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = states.limit_events(stream).writeStream.format("memory").queryName("streamed_events").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert query.awaitTermination(240)
    got = sorted((r["event"], r["resets_at"], r["at"]) for r in spark.table("streamed_events").collect())
    assert got == sorted((r["event"], r["resets_at"], r["at"]) for r in limit_events.detect(spark.createDataFrame(rows, schema)).collect())


def test_ledger(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "ledger.db")
    with sqlite3.connect(path) as con:
        con.executescript("create table accounts(id, provider, identity, label); create table models(id, name); create table usage(key, acct, ts, model, inp, outp, cr, cc, e5, e1); create table meta(k, v)")
        con.execute("insert into accounts values (1, 'claude', 'i1', 'one')")
        con.execute("insert into models values (1, 'm')")
        con.executemany("insert into usage values (?, ?, ?, ?, 1, 1, 1, 1, null, null)", [(5, 1, 10, 1), (-7, 1, 11, 1), (2**60, 1, 12, 1), (9, 2, 1, 1), (10, 1, 1, 7), (11, 1, -5, 1)])
    rows = read_ledger(spark, path)
    assert sorted(r["key"] for r in rows.collect()) == [-7, 5, 2**60]
    assert [plain(tuple(r)) for r in only_in_ledger(rows, spark.createDataFrame([(5,)], "key long")).collect()] == [["claude", 2]]


def test_a_file_rewritten_in_place_is_read_anew(spark, tmp_path):
    root, log, check = tmp_path / "projects", str(tmp_path / "log"), str(tmp_path / "check")
    root.mkdir()
    path = root / "a.jsonl"
    expected = set()
    for numbers in (range(3), range(3, 9), range(9, 15), range(15, 21)):  # the second is longer than the first, the others as long as it
        text = "".join(line_a(100 + i) + "\n" for i in numbers)
        with open(path, "r+" if path.exists() else "w") as f:  # the inode stays
            f.write(text)
        expected |= {ledger_key_of(f"c\x1fr{100 + i}\x1fm{100 + i}") for i in numbers}
        assert ingest.follow(spark, [str(root)], log, check, provider="a").awaitTermination(120)
        assert {r["key"] for r in spark.read.parquet(log).select("key").collect()} == expected
    with open(path, "a") as f:
        f.write(line_a(200) + "\n")
    assert ingest.follow(spark, [str(root)], log, check, provider="a").awaitTermination(120)
    assert spark.read.parquet(log).count() == len(expected) + 1


def test_batch_lines_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """Long files are cut at line ends; what order and first lines mean stays the same."""
    from meterlark.streaming import lines as source

    folder = tmp_path / "projects" / "x"
    folder.mkdir(parents=True)
    made = [line_a(i) for i in range(200)]
    (folder / "a.jsonl").write_bytes("\n".join(made).encode() + b"\r\nbad \xff bytes\nunfinished")
    (folder / "notes.txt").write_text("no\n")
    cut = source.pieces(str(folder / "a.jsonl"), 0, 1000)
    assert len(cut) == 1
    monkeypatch.setattr(source, "SPAN", 1000)
    size = (folder / "a.jsonl").stat().st_size
    told = [row for p in source.pieces(str(folder / "a.jsonl"), 0, source.last_line_end(str(folder / "a.jsonl"), size)) for row in source.lines_of(p)]
    assert [v for _, _, v in told] == [*made, "bad \ufffd bytes"]
    found = transcripts.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["value"] for r in found] == [*made, "bad \ufffd bytes"] and found[0]["line_no"] == 0
    assert [r["value"] for r in found] == [v for _, _, v in told]
    other = transcripts.read_lines(spark, f"file:{tmp_path}").collect()
    assert len(other) == len(found)
