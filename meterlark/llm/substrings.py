"""Operator 2: substring dedup, by fixed-block anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.llm._keys import bits, cuts, packed, planes, unbits, unpacked, unplaned
from meterlark.llm._shared import flat, give_back, partitions, text_bytes
from meterlark.llm._words import Words, spans_of

U64 = np.uint64
#: Bits of a block's hash that are shipped; a chance match only costs a look at the whole window.
BLOCK_BITS = 46
#: Bytes of text for each partition (there are spark.sql.shuffle.partitions at least), chunks of documents for each partition, and
#: partitions for each range of hashes: a chunk sends one message to each range, so that messages are as many as the partitions
#: squared, as blocks of a shuffle are.
PARTITION_BYTES, PER_PARTITION, PER_RANGE = 64 << 20, 4, 4
#: A null id stands last.
LAST = np.iinfo(np.int64).max

BLOCKS = "bucket int, chunk int, n int, keys binary, flags binary, more binary"


class Chunk:
    """The words of a chunk's documents and their block and window hashes; the same whenever it is made."""

    def __init__(self, table: pa.Table, window: int):
        self.ids = flat(table.column("doc_id")).fill_null(LAST).to_numpy(zero_copy_only=False)
        self.words = Words(*text_bytes(table.column("text")))
        self.window, self.block = window, (window + 1) // 2
        self.doc = self.ids[self.words.doc] if len(self.words.doc) else np.zeros(0, np.int64)
        self.hashes = self.words.hashes()

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct rolling block hashes ascending; in several documents here; at a fixed place of one; each place's index or -1)."""
        fits = np.flatnonzero(self.words.fits(self.block))
        h = self.words.windows(self.hashes, self.block)[fits] >> U64(64 - BLOCK_BITS)
        order = np.argsort(h, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else np.zeros(0, np.int64)
        doc = self.doc[fits][order]
        fixed = ((fits - self.words.first[self.words.doc[fits]]) % self.block == 0)[order]
        many = np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge) if len(edge) else np.zeros(0, bool)
        anchor = np.logical_or.reduceat(fixed, edge) if len(edge) else np.zeros(0, bool)
        index = np.full(len(self.doc), -1, np.int64)
        index[fits[order]] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(h))))
        return h[order][edge], many, anchor, index

    def shared(self, many: np.ndarray, anchored: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Places of windows all of whose blocks are in several documents, one of them at a fixed place of some document."""
        span = self.window - self.block + 1
        known = index >= 0
        a, b = np.zeros(len(index) + span, np.int64), np.zeros(len(index) + span, np.int64)
        a[1 : len(index) + 1][known], b[1 : len(index) + 1][known] = many[index[known]], anchored[index[known]]
        a, b = np.cumsum(a), np.cumsum(b)
        n = len(index)
        return np.flatnonzero(self.words.fits(self.window) & (a[span : n + span] - a[:n] == span) & (b[span : n + span] - b[:n] > 0))

    def keyed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows at these places: (distinct keys ascending, their second hashes, the least document here, each place's index)."""
        h = self.words.windows(self.hashes, self.window)[at]
        g = self.words.windows(self.hashes, self.window, seed=0xA24BAED4963EE407)[at] >> U64(32)
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.zeros(0, np.int64)
        least = np.minimum.reduceat(self.doc[at][order], edge) if len(edge) else np.zeros(0, np.int64)
        index = np.zeros(len(at), np.int64)
        index[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(h))))
        return h[edge], g[edge], least, index


def _answers(rows: list[dict], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The reducers' two flags for each of a chunk's distinct keys, in order."""
    first, second = [np.zeros(0, bool)], [np.zeros(0, bool)]
    for r in sorted(rows, key=lambda r: r["bucket"]):
        first.append(unbits(r["flags"], r["n"]))
        second.append(unbits(r["more"], r["n"]))
    a, b = np.concatenate(first), np.concatenate(second)
    if len(a) != size:
        raise RuntimeError(f"a chunk of documents changed between passes: {len(a)} and {size} keys")
    return a, b


def _rows(table: pa.Table, kind: int) -> list[dict]:
    return [r for r in table.to_pylist() if r["kind"] == kind]


def _frame(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    give_back()
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


NAMES = ["bucket", "chunk", "n", "keys", "flags", "more"]
TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def find_repeats(docs: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, removed (spans of words, end exclusive), kept_text.

    Removed is each word in a window of `window` words whose words also start a window in a document of a smaller id; windows are
    judged on the input.  The spans are maximal.  kept_text: the other words, joined by one space.

    A window of 13 words holds one of the blocks of 7 words that lie end to end from a document's start.  So (1) each
    chunk of documents sends the distinct hashes of its rolling blocks, once each, marked where a fixed block of its own
    has that hash; a reducer per range of hashes answers which are in several documents and which hit a fixed
    block.  (2) Hits are extended: windows made of shared blocks with an anchor among them are sent as 96-bit
    keys with the least document of the chunk; the answer is whether a smaller document has the window.  (3) Each chunk joins its hit windows
    to maximal repeats.  A passage that any number of documents share is one key per chunk, never a list of pairs.

    Null text: no words.  Null ids stand after all others, alike among themselves.  Rows of one id are one document to the rule
    (they don't remove from each other) and are each returned; equal rows are worked off once.  Texts without words join no chunk.
    Ties: of documents that share a window the smallest id keeps it.  A document is worked off within one chunk, whatever
    its length.  Empty table: no rows.  Other columns are ignored.

    Windows are told apart by 96 bits of hashes, not by their words: at 10^13 windows one chance match is expected in
    about a thousand runs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    by_id = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    most, size = by_id.agg(F.max("n"), F.sum("bytes")).first()
    parts_n = max(partitions(spark), -(-(size or 0) // PARTITION_BYTES))
    chunks, ranges = PER_PARTITION * parts_n, max(1, parts_n // PER_RANGE)
    worded = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if (most or 0) > 1:
        worded = worded.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times"))
    else:
        worded = worded.withColumn("times", F.lit(1).cast("long"))
    keyed = worded.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(parts_n, "chunk")
    parts = keyed.groupBy("chunk")

    def send_blocks(key, table):
        keys, many, anchor, _ = Chunk(table, window).blocks()
        at, rows = cuts(keys, ranges, BLOCK_BITS), []
        for b in np.flatnonzero(np.diff(at)):
            own = slice(at[b], at[b + 1])
            rows.append((int(b), key[0].as_py(), int(at[b + 1] - at[b]), packed(keys[own]), bits(many[own]), bits(anchor[own])))
        return _frame(rows, NAMES, TYPES)

    def judge_blocks(key, table):
        rows = table.to_pylist()
        keys = np.concatenate([unpacked(r["keys"]) for r in rows])
        many = np.concatenate([unbits(r["flags"], r["n"]) for r in rows])
        anchor = np.concatenate([unbits(r["more"], r["n"]) for r in rows])
        order = np.argsort(keys, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        size = np.diff(np.append(edge, len(keys)))
        several, hit = np.empty(len(keys), bool), np.empty(len(keys), bool)
        several[order] = np.repeat((size > 1) | np.logical_or.reduceat(many[order], edge), size)
        hit[order] = np.repeat(np.logical_or.reduceat(anchor[order], edge), size)
        out, at = [], 0
        for r in rows:
            own = slice(at, at + r["n"])
            out.append((r["bucket"], r["chunk"], r["n"], b"", bits(several[own]), bits(hit[own])))
            at += r["n"]
        return _frame(out, NAMES, TYPES)

    blocks = parts.applyInArrow(send_blocks, BLOCKS).groupBy("bucket").applyInArrow(judge_blocks, BLOCKS).withColumn("kind", F.lit(0))

    def send_windows(key, docs_, answers):
        if not docs_.num_rows:
            return _frame([], NAMES, TYPES)
        chunk = Chunk(docs_, window)
        keys, _, _, index = chunk.blocks()
        found, second, least, _ = chunk.keyed(chunk.shared(*_answers(_rows(answers, 0), len(keys)), index))
        at, rows = cuts(found, ranges, 64), []
        for b in np.flatnonzero(np.diff(at)):
            own = slice(at[b], at[b + 1])
            rows.append((int(b), key[0].as_py(), int(at[b + 1] - at[b]), packed(found[own]), second[own].astype("<u4").tobytes(), planes(least[own].view(U64))))
        return _frame(rows, NAMES, TYPES)

    def judge_windows(key, table):
        rows = table.to_pylist()
        h = np.concatenate([unpacked(r["keys"]) for r in rows])
        g = np.concatenate([np.frombuffer(r["flags"], "<u4") for r in rows])
        doc = np.concatenate([unplaned(r["more"]).view(np.int64) for r in rows])
        order = np.lexsort((g, h))
        edge = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]))
        least = np.empty(len(h), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], edge), np.diff(np.append(edge, len(h))))
        out, at = [], 0
        for r in rows:
            own = slice(at, at + r["n"])
            out.append((r["bucket"], r["chunk"], r["n"], b"", bits(least[own] < doc[own]), bits(np.zeros(r["n"], bool))))
            at += r["n"]
        return _frame(out, NAMES, TYPES)

    by_chunk = blocks.groupBy("chunk")
    windows = parts.cogroup(by_chunk).applyInArrow(send_windows, BLOCKS).groupBy("bucket").applyInArrow(judge_windows, BLOCKS).withColumn("kind", F.lit(1))

    def remove(key, docs_, answers):
        chunk = Chunk(docs_, window)
        words, n = chunk.words, len(chunk.words.start)
        keys, _, _, index = chunk.blocks()
        at = chunk.shared(*_answers(_rows(answers, 0), len(keys)), index)
        found, _, least, which = chunk.keyed(at)
        smaller, _ = _answers(_rows(answers, 1), len(found))
        hit = at[smaller[which] | (least[which] < chunk.doc[at])]
        edge = np.zeros(n + 1, np.int64)
        edge[hit] += 1
        np.add.at(edge, hit + window, -1)
        covered = np.cumsum(edge[:-1]) > 0
        lists: list[list[dict]] = [[] for _ in range(docs_.num_rows)]
        for d, a, b in zip(*(x.tolist() for x in spans_of(covered, words.first)), strict=True):
            lists[d].append({"start": a, "end": b})
        texts = []
        data, first = words.data, words.first
        for d in range(docs_.num_rows):
            keep = np.flatnonzero(~covered[first[d] : first[d + 1]]) + first[d]
            texts.append(b" ".join(data[a:b].tobytes() for a, b in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)).decode())
        gone = np.concatenate([[0], np.cumsum(covered)])
        return pa.Table.from_arrays(
            [docs_.column("doc_id"), docs_.column("times"), pa.array(words.count), pa.array(gone[first[1:]] - gone[first[:-1]], pa.int64()), pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(texts, pa.string())],
            names=["doc_id", "times", "n_words", "n_removed", "removed", "kept_text"],
        )

    columns = "n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"
    done = parts.cogroup(blocks.unionByName(windows).groupBy("chunk")).applyInArrow(remove, f"doc_id long, times long, {columns}")
    if (most or 0) > 1:
        done = done.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    zero = F.lit(0).cast("long")
    blank = rows.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    blank = blank.select("doc_id", zero.alias("n_words"), zero.alias("n_removed"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("removed"), F.lit("").alias("kept_text"))
    return done.drop("times").unionByName(blank)
