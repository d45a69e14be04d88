"""Operator 5: benchmark decontamination, by a prefix-filtered join and exact containment; DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between words once A-Z are lower case; the second form is for texts as they are.
BETWEEN_LOWER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rarest words of a window that a text must hold at their places before the window is compared.
PREFIX = 2
#: Bytes of benchmark words, and of windows with their anchors, that are broadcast at most; more are joined by shuffle, in so many salts.
BROADCAST_BYTES, SALTS = 32 << 20, 32
WINDOW = 13


def split_words(text: Column, between: str = BETWEEN) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Windows of `window` words (a shorter item is one): win (words joined), words, item."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), split_words(lower_ascii(F.col(text_col).cast("string")), BETWEEN_LOWER).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - window + 1, F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, window))).alias("words")).select("item", F.array_join("words", " ").alias("win"), "words").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, prefix: int = PREFIX, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items (ids sorted as strings, comma-joined), contaminated.

    Words are runs of non-ASCII characters, digits and letters, A-Z as a-z.  A word inside any occurrence of a window of
    an item is hit; contaminated: n_hit > 0 and 20 * n_hit >= n_words.

    Words of the windows are counted over all documents; each window's `prefix` rarest words are joined with
    the documents' words; where all of them stand at their places and the window fits into the text
    (positions and length), the text itself is compared.  Of equally rare words the first by name and place is taken, which changes no result.

    What is broadcast is measured before: the bytes of the items' distinct words, and those of their windows for each anchor.  Beyond
    BROADCAST_BYTES words are counted before they meet the items' words, and the anchors are joined by word and salt.

    Null text: no words.  Null ids are kept, rows repeat, a null item id reads as the empty id; long texts are compared
    where candidates stand; empty tables give no rows, or no hits; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("_k", F.xxhash64("doc_id", "text"))
    wins = item_windows(items, window, item_id_col, item_text_col)
    spots = wins.select("win", F.size("words").alias("len"), F.posexplode("words").alias("off", "_w")).distinct().select("win", "len", "off", F.lower("_w").alias("word"))
    vocabulary = spots.select("word").distinct()
    few_words = (vocabulary.agg(F.sum(F.octet_length("word") + 32)).first()[0] or 0) <= BROADCAST_BYTES
    few_windows = prefix * (wins.select("win").distinct().agg(F.sum(F.octet_length("win") + 64)).first()[0] or 0) <= BROADCAST_BYTES

    # Rarity over all documents; a word that no document holds counts 0.
    counts = rows.select(F.explode(split_words(F.col("text"))).alias("_w")).select(F.lower("_w").alias("word"))
    if few_words:
        counts = counts.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = counts.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "word", "left_semi")
    ranked = spots.join(counts, "word", "left").groupBy("win", "len").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off"))), 1, prefix).alias("_p"))
    anchors = ranked.select("win", "len", F.size("_p").alias("need"), F.explode("_p").alias("_a")).select(F.col("_a.word").alias("word"), F.col("_a.off").alias("off"), "win", "len", "need")

    words = split_words(F.col("text"))
    placed = rows.select("_k", words.alias("_words")).select("_k", F.size("_words").alias("_n"), F.posexplode("_words").alias("_pos", "_w")).select("_k", "_n", "_pos", F.lower("_w").alias("word"))
    if few_windows:
        at = anchors.groupBy("word").agg(F.collect_list(F.struct("off", "win", "len", "need")).alias("at"))
        met = placed.join(F.broadcast(at), "word").select("_k", "_n", "_pos", F.explode("at").alias("_a")).select("_k", "_n", "_pos", "_a.*")
    else:
        salted = anchors.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = placed.withColumn("_salt", F.pmod(F.xxhash64("_k", "_pos"), F.lit(SALTS)).cast("int")).join(salted, ["word", "_salt"])
    met = met.select("_k", (F.col("_pos") - F.col("off")).alias("start"), "off", "win", "len", "need", "_n")
    met = met.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("_n")))
    candidates = met.select("_k", "start", "len", "win", "need", "off").distinct().groupBy("_k", "start", "len", "win", "need").count().where(F.col("count") >= F.col("need"))
    asked = candidates.groupBy("_k").agg(F.collect_list(F.struct("start", "len", "win")).alias("_asked"))

    compared = rows.join(asked, "_k", "left").select("doc_id", "_k", words.alias("_words"), "_asked")
    same = lambda c: lower_ascii(F.array_join(F.slice("_words", c["start"] + 1, c["len"]), " ")) == c["win"]
    compared = compared.select("doc_id", "_k", F.size("_words").cast("long").alias("n_words"), F.filter("_asked", same).alias("_hits"))
    judged = compared.select("doc_id", "_k", "n_words", F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("_hits", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))), F.lit(0)).cast("long").alias("n_hit"), F.array_distinct(F.transform("_hits", lambda c: c["win"])).alias("_wins"))
    judged = judged.withColumn("n_hit", F.when(F.size("_wins") > 0, F.col("n_hit")).otherwise(F.lit(0).cast("long")))
    return _with_items(judged, wins)


def _with_items(judged: DataFrame, wins: DataFrame) -> DataFrame:
    named = judged.where(F.size("_wins") > 0).select("_k", F.explode("_wins").alias("win")).join(wins.select("win", "item").distinct(), "win").groupBy("_k").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    out = judged.join(named, "_k", "left")
    return out.select("doc_id", "n_words", "n_hit", F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join("_items", ","), F.lit("")).alias("items"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
