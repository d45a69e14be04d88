"""Operator 1: token counts of whole texts, by the whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.llm._coder import Coder, proven
from meterlark.llm._shared import give_back, slices


def count_tokens(docs: DataFrame, vocabulary: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    vocabulary: a tokenizers .json file with a byte-level pre-tokeniser (shortcut) or a
    sentencepiece .model file (library alone).  The path must be readable on executors.
    Null text: empty, 0 tokens.  Null ids are returned as null.  Repeated rows give repeated
    results; an empty table gives an empty one; other columns are ignored, whatever their names.
    Long texts are worked off in pieces.  Map-only: no shuffle, memory bounded by a slice of text (one longer text
    is a slice) and the remembered chunks, which go when the task ends.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = vocabulary.endswith(".model")
    sent = None if pieces else docs.sparkSession.sparkContext.broadcast(proven(vocabulary))  # about a megabyte, whatever the input

    def work(batches):
        if pieces:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            count = lambda text: len(library.encode(text, num_threads=1))
        else:
            count = Coder(sent.value).count
        for part in slices(batches, "text"):
            texts = [x or "" for x in part.column("text").to_pylist()]
            n = [count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
        del count
        give_back()

    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
