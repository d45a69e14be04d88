"""Operator 9: packing into sequences, by shortest-pack-first over the length histogram."""

from __future__ import annotations

import zlib
from bisect import insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlark.llm._coder import Coder, proven
from meterlark.llm._shared import give_back, partitions, settled, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, vocabulary: str, *, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids (with end_id after them) cut at multiples of size: full pieces and one tail."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = end_id.to_bytes(4, "little")
    sent = docs.sparkSession.sparkContext.broadcast(proven(vocabulary))  # about a megabyte, whatever the input

    def work(batches):
        ids_of = Coder(sent.value).merged_whole
        for part in slices(batches, "text"):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = memoryview(ids_of(text or "") + end)
                n = len(ids) // 4
                for start in range(0, n, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    for column, value in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        del ids_of
        give_back()

    return rows.mapInArrow(work, PIECES)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used, for counts of pieces by length.

    Lengths are placed longest first.  A length goes to the shortest open packs, those with the
    most room, then to the next, and opens new packs for what is left; packs that are
    alike are one pattern with a count, so work follows the lengths and not the pieces.
    """
    done: list[tuple[tuple[int, ...], int]] = []
    rooms: list[int] = []  # sorted; open[room] has patterns with a count
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(pattern: tuple[int, ...], count: int, room: int) -> None:
        if not room:
            done.append((pattern, count))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                each = size // length  # a new pack may take several of this length
                if left >= each:
                    put((length,) * each, left // each, size - each * length)
                if left % each:
                    put((length,) * (left % each), 1, size - (left % each) * length)
                break
            room = rooms[-1]
            pattern, count = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[-1]
            used = min(count, left)
            if count > used:
                put(pattern, count - used, room)
            put((*pattern, length), used, room - length)
            left -= used
    return done + [x for room in rooms for x in open_[room]]


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) for each place of each pattern."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in found:
        offset = 0
        for length in pattern:
            lo = taken.get(length, 0)
            out.append((length, lo, lo + count, sequence, offset))
            taken[length] = lo + count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, vocabulary: str, *, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every id of every document in one piece of one sequence of at most size ids.

    One row per piece: doc_id, start, length, ids_crc32 (little-endian 32-bit ids), doc_tokens,
    sequence_id, offset (gapless from 0 in a sequence).  Null text: empty, so the end id alone.  Null ids
    stay null; repeated rows are packed each; an empty table gives no pieces; other columns are ignored.

    The pieces (few numbers each) are written once to the shared folder.  The driver sees
    the histogram (at most size rows) and its patterns only.  Each piece is numbered as it is written, and ranks within a length are made by that number's salt:
    a length that holds any share of all pieces is numbered in as many tasks as there are partitions, and joined with its places
    by blocks of ranks, so that none of the steps has a length as a key of its own.
    """
    spark = docs.sparkSession
    pieces = settled(cut_pieces(docs, vocabulary, size=size, end_id=end_id, id_col=id_col, text_col=text_col).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    salted = pieces.withColumn("_salt", F.pmod("_row", F.lit(partitions(spark))))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `size` rows
    before = counts.select("length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    block = max(1, -(-sum(histogram.values()) // partitions(spark)))  # ranks of one length that are joined in one group
    places = spark.createDataFrame(slots(patterns(histogram, size)), "length long, _lo long, _hi long, _sequence long, offset long")
    places = places.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_hi") - 1) / block))))
    ranked = salted.withColumn("_in", F.row_number().over(W.partitionBy("length", "_salt").orderBy("_row")) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in")).withColumn("_block", F.floor(F.col("_rank") / block))
    return ranked.join(places, ["length", "_block"]).where("_rank >= _lo and _rank < _hi").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_sequence") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "offset"
    )
