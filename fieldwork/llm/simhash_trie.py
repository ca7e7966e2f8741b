"""SimHash near-duplicates: a self-join of the binary trie of fingerprints.

The trie is walked from its root by pairs of nodes: the children of a pair are paired, the bits in which their paths differ are
added up, and a pair that exceeds the budget is dropped.  The upper part of the walk is a Spark job, ``STEP`` bits a turn, over the
nodes of each depth with the number of fingerprints below; a pair with at most ``NODE`` fingerprints is set aside.  The
fingerprints of every node set aside travel as one array to its pairs, and a task walks each pair down to the leaves with numpy,
bit by bit, a bounded number of pairs at a time.  So neither memory nor a group depends on how alike
the fingerprints are, and every pair within the budget is met.

Fingerprints are compared once each, however many documents share them.  A task returns, instead of all links of its pair, a
spanning forest of them; classes are the connected components.

Defined results: null, empty or blank text: fingerprint zero, linked like any other.  Repeated rows and ids are
separate documents with equal classes where texts are equal.  A null doc_id takes part in links; a class's id is its
smallest non-null doc_id (null if it has none).  Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwork.llm.common import _LOWER, _SEP, ids_and_text, longs, on_workers, text_slices, word_spans, written
from fieldwork.llm.graph import connected_components

NODE = 16_384     # fingerprints of a pair of nodes that one task joins
STEP = 4          # bits a turn of the distributed walk
DEEPEST = 60      # below 2**(64 - DEEPEST) = 16 fingerprints are always few enough
PAIRS = 1 << 18   # pairs of nodes expanded at a time in a task
PIECE = 1 << 16   # shingles hashed at a time
_SPREAD = np.array([sum(1 << (8 * i) for i in range(8) if b >> i & 1) for b in range(256)], np.uint64)  # bit i of a byte to byte lane i


def _shingle_hashes(data: np.ndarray, offs: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every text's runs of ``k`` words (fewer: all its words), joined by one space, and the first hash of each text."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offs)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    lens = ends - starts
    blank = _SEP[data]
    follows = ends < len(data)
    follows[follows] = blank[ends[follows]]  # the byte behind the word is kept as its space
    kept = ~blank
    kept[ends[follows]] = True
    data[blank] = 0x20
    raw, h = data[kept].tobytes(), xxhash.xxh64_intdigest
    at = np.cumsum(lens + follows) - (lens + follows)  # where each word begins in the words joined by one space
    words = np.diff(first)
    runs = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    head = np.cumsum(runs) - runs
    total = int(runs.sum())
    out = np.empty(total, np.uint64)
    begin = np.arange(total) + np.repeat(first[:-1] - head, runs)  # first word of each run
    last = begin + np.repeat(np.minimum(words, k), runs) - 1
    begin, last = at[begin], at[last] + lens[last]
    for i in range(0, total, PIECE):
        out[i:i + PIECE] = [h(raw[a:b], seed) for a, b in zip(begin[i:i + PIECE].tolist(), last[i:i + PIECE].tolist())]
    return out, np.append(head, total)


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text the 64 bits set in over half of its hashes."""
    n = np.diff(first)
    pieces = -(-n // 255)  # 255 hashes at most are added up in byte lanes
    head = np.cumsum(pieces) - pieces
    begin = np.repeat(first[:-1], pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(head, pieces))
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n > 0)
    if not len(some):
        return out
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(_SPREAD[octets[:, byte]], begin)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), head[some], axis=0)
        bits = (2 * counts > n[some][:, None]).astype(np.uint64)
        out[some] |= (bits << (np.arange(8, dtype=np.uint64) + np.uint64(8 * byte))).sum(1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: 64-bit majority fingerprints of whole texts, as longs of the same bits."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column(1)):
                fp = _majority(*_shingle_hashes(data, offs, k, seed))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(longs(fp))], names=["doc_id", "fp"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


class Trie:
    """The binary trie, below ``depth`` shared bits, of sorted distinct fingerprints, a level at a time."""

    def __init__(self, fps: np.ndarray, depth: int):
        self.children = []  # of each level: (nodes, 2) numbers in the next level, -1 for none
        leaf = np.zeros(len(fps), np.int64)
        for bit in range(63 - depth, -1, -1):
            path = fps >> np.uint64(bit)
            new = np.ones(len(fps), bool)
            new[1:] = path[1:] != path[:-1]
            below = np.cumsum(new) - 1
            level = np.full((int(leaf[-1]) + 1, 2), -1, np.int64)
            level[leaf[new], (path[new] & np.uint64(1)).astype(np.int64)] = below[new]
            self.children.append(level)
            leaf = below


def walk(one: Trie, two: Trie, spent: int, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of leaves whose paths differ in at most ``budget`` bits, ``spent`` of them above; depth first in bounded pieces."""
    todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, spent, np.int8))]
    while todo:
        level, a, b, diff = todo.pop()
        if len(a) > PAIRS:
            todo += [(level, a[i:i + PAIRS], b[i:i + PAIRS], diff[i:i + PAIRS]) for i in range(0, len(a), PAIRS)]
            continue
        if level == len(one.children):
            if same:
                a, b = a[a != b], b[a != b]
            yield a, b
            continue
        ca, cb = one.children[level][a], two.children[level][b]
        parts = []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            keep = (ca[:, x] >= 0) & (cb[:, y] >= 0)
            if x != y:
                keep &= diff < budget
            if same and (x, y) == (1, 0):
                keep &= a != b  # of a node and itself, each pair of children once
            parts.append((ca[keep, x], cb[keep, y], diff[keep] + np.int8(x != y)))
        todo.append((level + 1, *[np.concatenate(p) for p in zip(*parts)]))


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of every link, and all that follow them, one label: the smallest reachable."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label[:] = label[label]


def node_pair_links(a: np.ndarray, b: np.ndarray | None, depth: int, spent: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between sorted ``a`` and sorted ``b`` (None: among ``a``), as two arrays of fingerprints."""
    one = Trie(a, depth)
    two, both, shift = (one, a, 0) if b is None else (Trie(b, depth), np.concatenate([a, b]), len(a))
    label = np.arange(len(both))
    for x, y in walk(one, two, spent, budget, b is None):
        _hook(label, x, y + shift)
    linked = np.flatnonzero(label != np.arange(len(both)))
    return both[linked], both[label[linked]]


def _node(fp: Column | str, depth: int) -> Column:
    """The node of ``depth`` bits above a fingerprint: a one bit, then the path from the root."""
    fp = F.col(fp) if isinstance(fp, str) else fp
    path = F.shiftrightunsigned(fp, 64 - depth) if depth else F.lit(0).cast("long")
    return path + F.lit(1 << depth).cast("long")


def frontier(fps: DataFrame, budget: int, node: int = NODE) -> list[tuple[int, DataFrame]]:
    """Pairs of nodes ``(a, b, spent)``, by depth, that cover every pair of fingerprints within the budget.

    Each has at most ``node`` fingerprints; the loop takes one turn per ``STEP`` bits and ends when no larger pair is left."""
    out = []
    root = fps.agg(F.lit(1).cast("long").alias("a"), F.lit(1).cast("long").alias("b"), F.lit(0).alias("spent"), F.count(F.lit(1)).alias("n"))
    pairs = written(root, "trie-pairs")  # one row: the root and itself
    for depth in range(0, DEEPEST + 1, STEP):
        done = (F.col("n") <= node) | F.lit(depth == DEEPEST)
        if depth == 0 or pairs.where(done).head(1):
            out.append((depth, pairs.where(done).select("a", "b", "spent")))
        wide = pairs.where(~done)
        if not wide.head(1):
            break
        below = fps.groupBy(_node("fp", depth + STEP).alias("child")).agg(F.count(F.lit(1)).alias("n"))
        below = written(below.withColumn("node", F.shiftright("child", STEP)), "trie-level")
        left = below.select(F.col("node").alias("a"), F.col("child").alias("ca"), F.col("n").alias("na"))
        right = below.select(F.col("node").alias("b"), F.col("child").alias("cb"), F.col("n").alias("nb"))
        spent = (F.col("spent") + F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(F.lit((1 << STEP) - 1)))).cast("int")
        grown = wide.drop("n").join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
        pairs = written(grown.select(F.col("ca").alias("a"), F.col("cb").alias("b"), spent.alias("spent"),
                                     F.when(F.col("ca") == F.col("cb"), F.col("na")).otherwise(F.col("na") + F.col("nb")).alias("n"))
                        .where(F.col("spent") <= budget), "trie-pairs")
    return out


def similar_fingerprints(fps: DataFrame, budget: int = 2, node: int = NODE) -> DataFrame:
    """Links ``(x, y)`` that connect exactly the distinct fingerprints ``fp`` within ``budget`` bits, directly or through others."""
    on_workers(fps.sparkSession)
    dealt = None
    for depth, pairs in frontier(fps, budget, node):
        ends = pairs.select("a", "b", "spent", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
        needed = ends.select("node").distinct()
        # at most NODE fingerprints below a node that was set aside
        lists = fps.withColumn("node", _node("fp", depth)).join(needed, "node").groupBy("node").agg(F.collect_list("fp").alias("fps"))
        one = ends.join(lists, "node").select(F.lit(depth).alias("depth"), "a", "b", "spent", "node", "fps")
        dealt = one if dealt is None else dealt.unionByName(one)

    def join(table: pa.Table) -> pa.Table:
        depth, spent, a = (table.column(c)[0].as_py() for c in ("depth", "spent", "a"))
        sides = {n: np.sort(fps.values.to_numpy().view(np.uint64)) for n, fps in zip(table.column("node").to_pylist(), table.column("fps"))}
        other = [fps for n, fps in sides.items() if n != a]
        x, y = node_pair_links(sides[a], other[0] if other else None, depth, spent, budget)
        return pa.table({"x": pa.array(longs(x)), "y": pa.array(longs(y))})

    return dealt.groupBy("a", "b").applyInArrow(join, "x long, y long")


def near_duplicates(docs: DataFrame, k: int = 3, budget: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
                    node: int = NODE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per document: 16 hexadecimal digits, and the smallest doc_id reachable by links."""
    marked = written(fingerprints(docs, k, seed, id_col, text_col), "fingerprints")
    # one row a fingerprint; the hot ones are reduced before the shuffle
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    labels = connected_components(similar_fingerprints(fps.select("fp"), budget, node), "x", "y")
    classed = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = classed.groupBy("component").agg(F.min("low").alias("component_id"))
    per_fp = classed.select("fp", "component").join(lowest, "component").select("fp", "component_id")
    # a fingerprint of very many documents is split by AQE, as only the documents' side is large
    return marked.join(per_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
