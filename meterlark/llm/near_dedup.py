"""Operator 3: near-duplicates, by a chosen-path set similarity join over word shingles."""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.llm._shared import give_back, partitions, scratch, sent_if_few, settled, slices, text_bytes
from meterlark.llm._words import Words, ascii_lower, mixed
from meterlark.llm.components import components

U64, U32 = np.uint64, np.uint32
#: Minwise values of a set: those of the first half choose the paths down to the leaves, the others the paths below large leaves.
COORDINATES = 512
#: A tree's paths, and tokens of a path (fewer where low similarities need more trees than there are values).
PATHS, LEVELS = 2, 4
#: Greatest probability that a pair of the asked similarity meets in no node compared, and that one of the two looks at sketches drops it.
TREE_MISS, SKETCH_MISS = 1.5e-5, 1e-5
#: Values looked at first when two sketches are compared.
FIRST = 64
#: Members compared with each other at once; a node with more of them outside of its largest component branches on.
NODE = 512
#: A node branches on if its children have at most this part of its comparisons; else it is compared block by block.
LESS = 0.9
#: Shingles whose sets are held at once, about, as pairs of a block are confirmed.
TILE = 4_000_000
LAST = np.iinfo(np.int64).max
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 2**32, COORDINATES, np.uint32)
_MUL = _rng.integers(0, 2**31, COORDINATES, np.uint32) * U32(2) + U32(1)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes ascending within a text, index of the text, set size of each text) of distinct k-word shingles, A-Z as a-z.

    A text of fewer words is one shingle; one without words has none.
    """
    data, offsets = text_bytes(column)
    words = Words(ascii_lower(data), offsets)
    hashes = words.hashes()
    at = np.flatnonzero(words.fits(k))
    h, doc = words.windows(hashes, k)[at], words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    for size in range(1, k):
        own = short[words.count[short] == size]
        h = np.concatenate([h, words.windows(hashes, size, seed=0x9FB21C651E98DF25 + 2 * size)[words.first[own]]])
        doc = np.concatenate([doc, own])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    return h, doc, np.bincount(doc, minlength=len(offsets) - 1)


def sketches(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The least value of each of COORDINATES hash functions over each set (a row per set)."""
    h = (mixed(h) >> U64(32)).astype(U32)
    return np.stack([np.minimum.reduceat((h ^ x) * m, edge) for x, m in zip(_XOR, _MUL, strict=True)], axis=1)


def branches(least: float) -> int:
    """Children that a set follows from a large node: enough for pairs of that similarity to go on meeting."""
    return max(2, int(np.ceil(1.5 / least)))


def missed(least: float, trees: int, levels: int) -> float:
    """Probability that a pair of that similarity shares no leaf or, however deep large leaves branch, none of the nodes below."""
    going_on = 1.0
    for _ in range(200):
        going_on = 1 - (1 - least * going_on) ** branches(least)
    return (1 - least**levels * going_on) ** (PATHS * trees)


def shape(part: int, whole: int) -> tuple[int, int]:
    """(trees, levels): as few trees as keep TREE_MISS at similarity part / whole."""
    for levels in range(LEVELS, 0, -1):
        for trees in range(1, COORDINATES // 2 // (PATHS * levels) + 1):
            if missed(part / whole, trees, levels) <= TREE_MISS:
                return trees, levels
    raise ValueError(f"similarity {part}/{whole} is too low for {COORDINATES} minwise values")


def leaves(values: np.ndarray, trees: int, levels: int) -> np.ndarray:
    """Leaf keys of each set in each tree: a set follows PATHS tokens from the root and one from each node below."""
    out, coordinate = [], 0
    for tree in range(trees):
        nodes = [np.full(len(values), mixed(np.array([tree + 1], U64))[0], U64)] * PATHS
        for _ in range(levels):
            for i, node in enumerate(nodes):
                nodes[i] = mixed(node * U64(0x9E3779B97F4A7C15) + values[:, coordinate].astype(U64) + (U64(coordinate) << U64(32)))
                coordinate += 1
        out += nodes
    return np.stack(out, axis=1)


SKETCHED = "id long, n long, f1 long, f2 long, sketch binary, nodes array<long>"


def sketch(rows: DataFrame, k: int, trees: int, levels: int) -> DataFrame:
    """Set size, 128-bit set fingerprint, sketch (a byte per coordinate) and node keys of each row."""

    def work(batches):
        for part in slices(batches, "text"):
            h, doc, size = shingle_sets(part.column("text"), k)
            has = np.flatnonzero(size)
            f1, f2 = np.zeros(len(size), U64), np.zeros(len(size), U64)
            sketched, nodes = [b""] * len(size), [[]] * len(size)
            if len(has):
                edge = (np.cumsum(size) - size)[has]
                f1[has], f2[has] = np.add.reduceat(mixed(h), edge), np.add.reduceat(mixed(h ^ U64(0x5851F42D4C957F2D)), edge)
                values = sketches(h, edge)
                small, keys = ((values * U32(0x9E3779B1)) >> U32(24)).astype(np.uint8), leaves(values, trees, levels).view(np.int64).tolist()
                for i, row, own in zip(has.tolist(), small, keys, strict=True):
                    sketched[i], nodes[i] = row.tobytes(), own
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(sketched, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], names=["id", "n", "f1", "f2", "sketch", "nodes"])

    return rows.mapInArrow(work, SKETCHED)


def confirmed(pairs: DataFrame, rows: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """The pairs (a, b) whose full sets have whole * intersection >= part * union."""
    ids = settled(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = settled(rows.join(sent_if_few(ids), "id", "left_semi").dropDuplicates(["id", "text"]), "texts")
    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def work(batches):
        for batch in slices(batches, "text_a", "text_b"):
            (h, _, size), (g, _, other) = shingle_sets(batch.column("text_a"), k), shingle_sets(batch.column("text_b"), k)
            x, y, keep = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(other)]), []
            for i in range(batch.num_rows):
                both = len(np.intersect1d(h[x[i] : x[i + 1]], g[y[i] : y[i + 1]], assume_unique=True))
                keep.append(both > 0 and whole * both >= part * (int(size[i]) + int(other[i]) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(work, "a long, b long").distinct()


def confirmed_by_block(pairs: DataFrame, rows: DataFrame, sizes: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """The pairs (a, b, node, block) whose full sets have whole * intersection >= part * union, as (a, b).

    The pairs of a block share its members, so a text goes to a block once and not once for each of its pairs.  A block of more than
    TILE shingles is cut: members fall into parts by hash, and each two parts that have pairs are one tile.  In a tile texts come by id,
    each with the smaller ids it is to be compared with, whose sets are held.  sizes: id, n.
    """
    sides = pairs.select("node", "block", F.explode(F.array("a", "b")).alias("id")).distinct().join(sizes, "id")
    cuts = sides.groupBy("node", "block").agg(F.ceil(F.sum("n") / TILE).cast("long").alias("_parts"))
    own = lambda c: F.pmod(F.xxhash64(c), F.col("_parts"))
    tiles = pairs.join(cuts, ["node", "block"]).withColumn("tile", F.xxhash64("node", "block", F.least(own("a"), own("b")), F.greatest(own("a"), own("b"))))
    asked = tiles.select("tile", F.explode(F.array(F.struct(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("with")), F.struct(F.least("a", "b").alias("id"), F.lit(None).cast("long").alias("with")))).alias("x")).select("tile", "x.*")
    asked = settled(asked.groupBy("tile", "id").agg(F.collect_set("with").alias("earlier")), "asked")
    ids = settled(asked.select("id").distinct(), "ids")
    texts = settled(rows.join(sent_if_few(ids), "id", "left_semi").dropDuplicates(["id", "text"]), "texts")

    def work(batches):
        tile, held = None, {}
        for batch in slices(batches, "text"):
            h, _, size = shingle_sets(batch.column("text"), k)
            edge, a, b = np.concatenate([[0], np.cumsum(size)]), [], []
            for i, (this, own, earlier) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "id", "earlier")), strict=True)):
                if this != tile:
                    tile, held = this, {}
                mine = h[edge[i] : edge[i + 1]].copy()
                for other in earlier:
                    for theirs in held.get(other, ()):
                        both = len(np.intersect1d(mine, theirs, assume_unique=True))
                        if both and whole * both >= part * (len(mine) + len(theirs) - both):
                            a.append(other)
                            b.append(own)
                held.setdefault(own, []).append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        held.clear()
        give_back()

    placed = asked.join(texts, "id").repartition(partitions(pairs.sparkSession), "tile").sortWithinPartitions("tile", "id")
    return placed.select("tile", "id", "earlier", "text").mapInArrow(work, "a long, b long").distinct()


def needed(part: int, whole: int, coordinates: int) -> int:
    """Equal bytes of so many that a pair of similarity part / whole has, but for a chance of SKETCH_MISS."""
    same = Fraction(part, whole)
    same += (1 - same) / 256  # different values with equal bytes
    p, below, need = float(same), 0.0, 0
    while need < coordinates:
        below += comb(coordinates, need) * p**need * (1 - p) ** (coordinates - need)
        if below > SKETCH_MISS:
            break
        need += 1
    return need


def compared(members: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs (a, b, node, block) of a block's members of different components whose sketches and sizes allow the similarity.

    members: node, leaf, block, cross, hot, id, comp, n, sketch, nodes.  A pair that meets in several nodes comes from
    the first of them (leaf: the node's place among its members' nodes).  hot: of the node's largest component, whose members
    are not compared with each other; cross: only hot and other members are compared.  A block's rows come one after another
    within a partition and are compared when complete; a block has a bounded number of rows.
    """
    first, need = needed(part, whole, FIRST), needed(part, whole, COORDINATES)
    columns = ["node", "leaf", "block", "cross", "hot", "id", "comp", "n", "sketch", "nodes"]

    def pairs_of(rows: dict[str, list]) -> pa.RecordBatch:
        order = np.argsort(np.array(rows["hot"], bool), kind="stable")
        ids, comp, n = (np.array(rows[c], np.int64)[order] for c in ("id", "comp", "n"))
        seen = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(ids), COORDINATES)[order]
        quick = np.ascontiguousarray(seen[:, :FIRST])
        others, before = len(ids) - sum(rows["hot"]), np.array(rows["nodes"], np.int64)[order][:, : rows["leaf"][0]]
        a, b = [], []
        for i in range(others):
            at = others if rows["cross"][0] else i + 1
            near = (comp[at:] != comp[i]) & (whole * np.minimum(n[at:], n[i]) >= part * np.maximum(n[at:], n[i]))
            near = np.flatnonzero(near) + at
            near = near[(quick[near] == quick[i]).sum(axis=1) >= first]
            near = near[(seen[near] == seen[i]).sum(axis=1) >= need]
            near = near[~(before[near] == before[i]).any(axis=1)]
            a += [int(ids[i])] * len(near)
            b += ids[near].tolist()
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        node, block = (pa.array(np.full(len(a), rows[c][0], np.int64)) for c in ("node", "block"))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), node, block], names=["a", "b", "node", "block"])

    def work(batches):
        key, rows = None, {c: [] for c in columns}
        for batch in batches:
            got = batch.to_pydict()
            for i, this in enumerate(zip(got["node"], got["block"], strict=True)):
                if this != key and rows["id"]:
                    yield pairs_of(rows)
                    rows = {c: [] for c in columns}
                key = this
                for c in columns:
                    rows[c].append(got[c][i])
        if rows["id"]:
            yield pairs_of(rows)
        give_back()

    spark = members.sparkSession
    ordered = members.select(*columns).repartition(partitions(spark), "node", "block").sortWithinPartitions("node", "block")
    return ordered.mapInArrow(work, "a long, b long, node long, block long")


def unsettled(members: DataFrame, *more: str) -> DataFrame:
    """Nodes with more than one component: node (and more of its own), size, top (their largest component), its size, and work (comparisons)."""
    counts = members.groupBy("node", *more, "comp").agg(F.count(F.lit(1)).alias("_c"))
    nodes = counts.groupBy("node", *more).agg(F.sum("_c").alias("size"), F.max(F.struct("_c", "comp")).alias("_t"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    others = F.col("size") - F.col("top_size")
    return nodes.select("node", *more, "size", F.col("_t.comp").alias("top"), F.col("_t._c").alias("top_size")).withColumn("work", others.cast("double") * (F.col("top_size") + (others - 1) / 2))


def branched(members: DataFrame, children: int) -> DataFrame:
    """Members in so many children of their node, by values of the sketch that the node's key picks; the node becomes `parent`."""
    half = COORDINATES // 2
    at, step = F.pmod(F.xxhash64("node", F.lit(0)), F.lit(half)), 2 * F.pmod(F.xxhash64("node", F.lit(1)), F.lit(half // 2)) + 1
    byte = lambda j: F.substring(F.col("sketch"), (half + 1 + F.pmod(at + j * step, F.lit(half))).cast("int"), F.lit(1))
    keys = F.array(*[F.xxhash64("node", F.lit(j), byte(j)) for j in range(children)])
    return members.select(F.col("node").alias("parent"), F.explode(keys).alias("node"), "leaf", "id", "n", "comp")


def opened(members: DataFrame, firsts: DataFrame, children: int) -> tuple[DataFrame, DataFrame | None]:
    """Blocks to compare, and the leaves (id, n, leaf) that branched on (None: none did).

    Level by level, a node with more than NODE members outside of its largest component gives way to its children, as long as that makes
    fewer comparisons; every other node is compared whole.
    """
    blocks, gone = None, None
    while True:
        nodes = settled(unsettled(members), "unsettled")
        wide = nodes.where(f"size - top_size > {NODE}")
        split = None
        if not wide.isEmpty():
            below = settled(branched(members.join(wide.select("node"), "node", "left_semi").join(firsts.select("id", "n", "sketch"), ["id", "n"]), children), "branched")
            work = unsettled(below, "parent").groupBy("parent").agg(F.sum("work").alias("_work"))
            split = settled(wide.join(work.withColumnRenamed("parent", "node"), "node", "left").where(F.coalesce("_work", F.lit(0.0)) <= LESS * F.col("work")).select("node"), "split")
            if split.isEmpty():
                split = None
        ready = blocked(members, nodes if split is None else nodes.join(split, "node", "left_anti"))
        blocks = ready if blocks is None else blocks.unionByName(ready)
        if split is None:
            return blocks, gone
        if gone is None:
            gone = members.join(split, "node", "left_semi").select("id", "n", "leaf")
        members = below.join(split.withColumnRenamed("node", "parent"), "parent", "left_semi").drop("parent")


def apart(firsts: DataFrame, gone: DataFrame) -> DataFrame:
    """firsts with keys of their own in place of leaves that branched on: two members no longer count as compared there."""
    gone = gone.groupBy("id", "n").agg(F.collect_set("leaf").alias("_gone"))
    key = lambda node, i: F.when(F.array_contains("_gone", i), F.xxhash64("id", "n", i)).otherwise(node)
    out = firsts.join(gone, ["id", "n"], "left")
    return out.withColumn("nodes", F.when(F.col("_gone").isNull(), F.col("nodes")).otherwise(F.transform("nodes", key))).drop("_gone")


def blocked(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of the nodes by blocks: a small node is one block, a larger one is cut into blocks of about NODE members.

    Each block of other members meets each block of hot ones, and each other one.  A node whose largest component is nearly
    all of it sends every hot member once or a few times, however large it is.
    """
    rows = members.join(nodes, "node").withColumn("hot", F.col("comp") == F.col("top"))
    long = lambda c: F.ceil(c / NODE).cast("long")
    rows = rows.withColumn("_hots", long(F.col("top_size"))).withColumn("_others", long(F.col("size") - F.col("top_size")))
    rows = rows.withColumn("_all", F.col("_hots") + F.col("_others")).withColumn("_own", F.pmod(F.xxhash64("id"), F.when(F.col("hot"), F.col("_hots")).otherwise(F.col("_others"))))
    zero = F.lit(0).cast("long")
    upto = lambda c: F.sequence(zero, F.col(c) - 1)
    cell = lambda block, cross: F.struct(block.alias("block"), F.lit(cross).alias("cross"))
    hot = F.transform(upto("_others"), lambda i: cell(i * F.col("_all") + F.col("_own"), True))
    across = F.transform(upto("_hots"), lambda j: cell(F.col("_own") * F.col("_all") + j, True))
    among = F.transform(upto("_others"), lambda k: cell(F.least(F.col("_own"), k) * F.col("_all") + F.col("_hots") + F.greatest(F.col("_own"), k), False))
    cells = F.when(F.col("size") <= NODE, F.array(cell(zero, False))).when(F.col("hot"), hot).otherwise(F.concat(across, among))
    return rows.withColumn("_cell", F.explode(cells)).select("node", "leaf", "_cell.block", "_cell.cross", "hot", "id", "comp", "n")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, part: int = 85, whole: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Documents are sets of distinct `shingle`-word shingles; two are linked if whole * intersection >= part * union,
    confirmed on full sets.  kept: doc_id is its component's id.

    Documents of one set (128-bit fingerprint) become one before anything is joined.  Each of several independent trees
    (eight at similarity 0.85; see shape) has two paths of four minwise tokens.  (1) Each leaf's smallest id is compared with the
    leaf's other members, which makes large groups of copies one component in linear work.  (2) Leaves that still hold
    several components are compared exhaustively by sketch, members of the largest one only with the others.  A node with more than
    NODE others branches on first, each set following two or more further minwise tokens, level by level, as long as that lessens
    the comparisons; what no branching lessens (a large family of near misses) is compared block by block.  What a sketch allows
    is confirmed on full sets.  Texts to be confirmed are picked by a broadcast of their ids if a count shows that these are few, else by a join.
    A pair of the asked similarity is missed with a probability below TREE_MISS + 2 * SKETCH_MISS.
    Nothing is capped.

    A document without words or with null text has n_shingles 0 and is linked with nothing.  Rows of one id are one
    document, linked by any of its texts.  Null ids count as the largest id and are returned as null, component_id likewise.
    Empty tables give no rows; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession):
        every = settled(sketch(rows, shingle, *shape(part, whole)), "sketches", keep=True)
        sets = settled(every.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")), "sets", keep=True)
        firsts = every.where("n > 0").join(sets.select("f1", "f2", "n", F.col("rep").alias("id")), ["f1", "f2", "n", "id"], "left_semi").dropDuplicates(["f1", "f2", "n", "id"])
        firsts = settled(firsts.select("id", "n", "sketch", "nodes"), "firsts")
        members = firsts.select("id", "n", F.posexplode("nodes").alias("leaf", "node"))
        nodes = settled(members.groupBy("node").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1"), "nodes")
        shared = members.join(nodes, "node")
        stars = shared.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
        sizes = firsts.groupBy("id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        stars = stars.join(sizes.select(F.col("id").alias("a"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), "a").join(sizes.select(F.col("id").alias("b"), "lo", "hi"), "b").where(f"{whole} * _hi >= {part} * lo and {whole} * hi >= {part} * _lo").select("a", "b")
        links = settled(confirmed(settled(stars, "stars"), rows, shingle, part, whole), "links")

        # ids with several sets tie them together
        several = every.where("n > 0").groupBy("id").agg(F.min(F.struct("f1", "f2", "n")).alias("_x"), F.max(F.struct("f1", "f2", "n")).alias("_y")).where("_x != _y").select("id")
        tied = every.where("n > 0").join(several, "id", "left_semi").join(sets, ["f1", "f2", "n"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
        links = links.union(tied)
        roots = settled(components(links), "roots", keep=True)

        placed = settled(shared.select("node", "leaf", "id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").select("node", "leaf", "id", "n", F.coalesce("root", "id").alias("comp")), "members")
        blocks, gone = opened(placed, firsts, branches(part / whole))
        sketched = firsts if gone is None else apart(firsts, gone)
        found = compared(blocks.join(sketched.select("id", "n", "sketch", "nodes"), ["id", "n"]), part, whole)
        found = found if gone is None else found.groupBy("a", "b").agg(F.min(F.struct("node", "block")).alias("_b")).select("a", "b", "_b.*")
        found = settled(found.join(stars, ["a", "b"], "left_anti"), "pairs")
        if not found.isEmpty():
            roots = settled(components(links.union(confirmed_by_block(found, rows, sizes.select("id", F.col("hi").alias("n")), shingle, part, whole))), "roots", keep=True)

        judged = every.select("id", "n", "f1", "f2").join(sets, ["f1", "f2", "n"], "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        component = F.coalesce("root", "rep", "id")
        shown = lambda c: F.when(c != LAST, c)
        return judged.select(shown(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), shown(component).alias("component_id"), (component == F.col("id")).alias("kept"))
