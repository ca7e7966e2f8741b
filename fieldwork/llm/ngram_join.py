"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents whose distinct word shingles have Jaccard similarity >= ``num/den``
are linked; the answer is one row per document with the smallest document of
its class of (transitively) linked documents.  The result is exact:

1. ``shingle_counts``: all shingles are counted into a table of fixed size.  It only orders the
   columns of the matrix (rare first); any order gives the same links.
2. ``signatures``: one row per document: size, digest of the set, and its rarest ``n - ceil(t n) + l(n)`` shingles with
   ``l(n) = 1 + 5 n // 100``.  Two documents with similarity >= t share at least ``l`` (of the smaller) of those.
   Equal sets collapse to their smallest document before anything else, map-side.
3. ``candidate_groups``: the columns of the incidence matrix are read as a stream, rows in order of set size.  A column of at most
   ``SMALL`` rows gives its pairs within the size bound ``t |y| <= |x|``, whose overlaps are added up.  A longer column lists no pairs; each of its
   rows has that one more overlap that a pair may have unseen.  Pairs whose overlaps, seen and unseen, are below
   ``l`` are discarded.  Rows with ``l`` unseen overlaps or more (members of large groups) are chained along their long columns, a
   chain ending where sizes stop fitting.  So every linked pair lies in one group.
4. ``linked_rows``: per group the product itself, in blocks of bounded size: overlap
   counts of a row block against the columns of a second block are accumulated by matrix
   products of 0/1 matrices over the n-grams that two rows share, pairs outside the size bounds are
   discarded, and each block pair yields only a spanning forest of its links.
   A group beyond ``block_shingles`` is cut into blocks and every pair of blocks becomes a task of its own.

Defined results: null or empty text, or text without words: empty set, linked
with nothing, its own class.  Fewer than ``k`` words: the whole sequence is the one
shingle.  Repeated rows of one doc_id are documents that share an id: one result row
each, the class of the id is that of any of them.  A null doc_id is kept with a null class.
Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwork.llm.common import (ids_and_text, list_array, longs, on_workers, own_runs, run_hashes, set_digest,
                                  shingle_sets, text_words, written)
from fieldwork.llm.graph import connected_components

COUNT_BITS = 20       # shingles are counted into 2**20 cells: 4 MB, whatever the input
CELL_ROWS = 64        # the table travels as 64 rows
SMALL = 12            # rows of a column whose pairs are listed
BLOCK_SHINGLES = 1_500_000  # shingles of one side of a block product


def _counter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for _, _, words, first, _ in text_words(batch.column(0), True):
                runs = run_hashes(words, k)[own_runs(first, len(words), k)]
                cells += np.bincount(longs(runs >> np.uint64(64 - COUNT_BITS)), minlength=len(cells))
        if cells.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(CELL_ROWS), pa.int32()),
                 pa.array([p.tobytes() for p in cells.reshape(CELL_ROWS, -1)], pa.binary())], names=["cell", "counts"])
    return run


def _add_cells(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(raw, np.int64) for raw in table.column("counts").to_pylist())
    return pa.table({"cell": table.column("cell").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents' shingles fall into each of the 2**20 cells (log2, one byte each).

    Each task sends one table of fixed size; 64 keys add them up.  1 MB reaches the driver and is sent
    to all tasks, at any input size."""
    rows = (docs.select("text").mapInArrow(_counter(k), "cell int, counts binary")
            .groupBy("cell").applyInArrow(_add_cells, "cell int, counts binary").collect())
    cells = np.zeros((CELL_ROWS, (1 << COUNT_BITS) // CELL_ROWS), np.int64)
    for r in rows:
        cells[r["cell"]] = np.frombuffer(r["counts"], np.int64)
    return np.log2(cells.ravel() + 1).round().astype(np.uint8)


def signatures(docs: DataFrame, k: int, num: int, den: int, order: np.ndarray) -> DataFrame:
    """``(doc_id, n_shingles, digest, rare)`` per document."""
    ranks = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            for i, j, words, first, _ in text_words(col, True):
                sizes, digests, rare = [], [], []
                for s in shingle_sets(words, first, k):
                    n = len(s)
                    sizes.append(n)
                    digests.append(set_digest(s))
                    if n:
                        p = min(n, n - -(-num * n // den) + _least_shared(n))
                        rank = ranks.value[longs(s >> np.uint64(64 - COUNT_BITS))].astype(np.uint64)
                        key = (rank << np.uint64(58)) | (s >> np.uint64(6))
                        rare.append(longs(s[np.argpartition(key, p - 1)[:p]] if p < n else s))
                    else:
                        rare.append(np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), list_array(rare)],
                    names=["doc_id", "n_shingles", "digest", "rare"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, rare array<long>")


def _least_shared(n):
    """How many of their rare shingles a linked pair shares whose smaller set has ``n``."""
    return 1 + 5 * n // 100


def _columns(num: int, den: int):
    """Rows sorted by (token, size): the pairs of small columns, the rows of long ones.

    Yields ``(a, b, shared, need)`` for pairs, and ``(row, token, -1, size)`` for a row of a long column.  Between batches only the
    unfinished column is kept while it is small."""
    def pairs(tok, size, doc):
        out = []
        for k in range(1, SMALL):
            same = np.flatnonzero((tok[k:] == tok[:-k]) & (den * size[:-k] >= num * size[k:])) if len(tok) > k else tok[:0]
            if len(same):
                x, y = doc[same], doc[same + k]
                out.append(np.stack([np.minimum(x, y), np.maximum(x, y), _least_shared(size[same])], 1))
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3   # rows of the unfinished column
        long = None                          # token of an unfinished long column
        for batch in _then_end(batches):
            end = batch is None
            new = [np.zeros(0, np.int64)] * 3 if end else [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            tok, size, doc = (np.concatenate([k, x]) for k, x in zip(kept, new))
            kept = [np.zeros(0, np.int64)] * 3
            if not len(tok):
                continue
            head = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            length = np.diff(np.append(head, len(tok)))
            if not end and length[-1] <= SMALL and tok[-1] != long:
                kept = [x[head[-1]:] for x in (tok, size, doc)]
                tok, size, doc = (x[:head[-1]] for x in (tok, size, doc))
                head, length = head[:-1], length[:-1]
                if not len(tok):
                    continue
            many = np.repeat(length > SMALL, length) | (tok == long if long is not None else False)
            rows = pairs(tok[~many], size[~many], doc[~many])
            out = [np.column_stack([doc[many], tok[many], np.full(int(many.sum()), -1), size[many]])]
            if len(rows):
                rows, n = np.unique(rows, axis=0, return_counts=True)
                out.append(np.column_stack([rows[:, :2], n, rows[:, 2]]))
            long = tok[-1] if many[-1] else None
            if len(rows := np.concatenate(out)):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=["a", "b", "shared", "need"])
    return run


def _chain(num: int, den: int):
    """Rows sorted by (token, size): link each row to the first of its run; a run ends where sizes stop fitting."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (token, size, first row of the run) of the last row seen
        for batch in batches:
            tok, size, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if not len(tok):
                continue
            new = np.empty(len(tok), bool)
            new[0] = last is None or tok[0] != last[0] or den * last[1] < num * size[0]
            new[1:] = (tok[1:] != tok[:-1]) | (den * size[:-1] < num * size[1:])
            at = np.maximum.accumulate(np.where(new, np.arange(len(tok)), -1))
            hubs = np.where(at >= 0, doc[np.maximum(at, 0)], last[2] if last else 0)
            last = (tok[-1], size[-1], hubs[-1])
            if (keep := hubs != doc).any():
                links = np.unique(np.stack([hubs[keep], doc[keep]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in links.T], names=["a", "b"])
    return run


def _then_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def candidate_groups(reps: DataFrame, num: int, den: int) -> DataFrame:
    """``(node, component)`` groups that hold all linked pairs of ``reps (rep, n, rare)``.

    One shuffle of (shingle, size, row); each column streams through sorted."""
    post = reps.select(F.explode("rare").alias("token"), F.col("n").alias("n"), F.col("rep").alias("rep"))
    seen = written(post.repartition("token").sortWithinPartitions("token", "n", "rep")
                   .mapInArrow(_columns(num, den), "a long, b long, shared long, need long"), "columns")
    longs = seen.where("shared < 0").select(F.col("a").alias("rep"), F.col("b").alias("token"), F.col("need").alias("n"))
    unseen = longs.groupBy("rep").agg(F.count(F.lit(1)).alias("g"))
    pairs = seen.where("shared > 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))
    ga, gb = (unseen.select(F.col("rep").alias(c), F.col("g").alias(f"g{c}")) for c in "ab")
    pairs = pairs.join(ga, "a", "left").join(gb, "b", "left").where(
        F.col("shared") + F.least(F.coalesce("ga", F.lit(0)), F.coalesce("gb", F.lit(0))) >= F.col("need")).select("a", "b")
    # the smallest partner of a row of n shingles has ceil(t n); with fewer unseen overlaps than such a pair needs, no chain is needed
    least = 1 + F.floor(5 * F.floor(F.col("n") * num / F.lit(den)) / 100)
    members = longs.join(unseen, "rep").where(F.col("g") >= least).select("token", "n", "rep")
    chains = members.repartition("token").sortWithinPartitions("token", "n", "rep").mapInArrow(_chain(num, den), "a long, b long")
    return connected_components(pairs.unionByName(chains))


def _components_of(docs: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], up: dict) -> list[tuple[int, int]]:
    forest = []

    def find(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                forest.append((min(x, y), max(x, y)))
    return forest


def block_links(docs: np.ndarray, sets: list[np.ndarray], n_left: int, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the first ``n_left`` rows and all rows given.

    Overlap counts = product of 0/1 incidence matrices; only n-grams held by two rows count, taken in column
    strips so that no matrix exceeds a few million cells."""
    sizes = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    if m < 2:
        return []
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), sizes)
    _, inv, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[inv] > 1
    row, inv = row[shared], inv[shared]
    names, col = np.unique(inv, return_inverse=True)
    by_col = np.argsort(col, kind="stable")
    row, col = row[by_col], col[by_col]
    order = np.argsort(sizes, kind="stable")  # rows by size: each row's partners are a range
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    row, osz, odoc = place[row], sizes[order], docs[order]
    oleft = (order < n_left)
    up: dict = {}
    out: list[tuple[int, int]] = []
    strip = 2048
    for r0 in range(0, m, 512):
        r1 = min(m, r0 + 512)
        hi = int(np.searchsorted(osz * num, den * osz[r1 - 1], side="right"))  # size bound: t |y| <= |x|
        if hi <= r0 + 1:
            continue
        inside = (row >= r0) & (row < hi)
        rr, cc = row[inside] - r0, col[inside]
        mine = np.zeros(len(names) + 1, bool)
        mine[cc[rr < r1 - r0]] = True
        sel = mine[cc]
        rr, cc = rr[sel], cc[sel]
        if not len(cc):
            continue
        dense, cc = np.unique(cc, return_inverse=True)
        overlap = np.zeros((r1 - r0, hi - r0), np.float32)
        for c0 in range(0, len(dense), strip):
            a, b = np.searchsorted(cc, [c0, c0 + strip])
            inc = np.zeros((hi - r0, min(strip, len(dense) - c0)), np.float32)
            inc[rr[a:b], cc[a:b] - c0] = 1
            overlap += inc[:r1 - r0] @ inc.T
        inter = overlap.astype(np.int64)
        union = osz[r0:r1, None] + osz[None, r0:hi] - inter
        hit = den * inter >= num * union
        hit &= np.arange(r0, r1)[:, None] < np.arange(r0, hi)[None, :]
        hit &= oleft[r0:r1, None] | oleft[None, r0:hi]
        x, y = np.nonzero(hit & (inter > 0))
        out += _components_of(odoc, [(odoc[x + r0], odoc[y + r0])], up)
    return out


def linked_rows(docs: DataFrame, groups: DataFrame, k: int, num: int, den: int,
                block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``(a, b)``: spanning links inside each candidate group ``(doc_id, n, component)``.

    Rows of a group are dealt to ``ceil(shingles / block_shingles)`` blocks by a hash of the document; a
    group of one block is one task, otherwise each pair of blocks is one."""
    size = groups.groupBy("component").agg(F.sum("n").alias("total"))
    blocks = (groups.join(size, "component")
              .withColumn("blocks", F.ceil(F.col("total") / F.lit(block_shingles)).cast("int"))
              .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    texts = docs.join(blocks.select("doc_id", "component", "blocks", "block"), "doc_id")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    texts = (texts.select("doc_id", "text", "component", "block", F.explode(pairs).alias("p"))
             .select("doc_id", "text", "component", "block", "p.i", "p.j"))

    def product(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        left = block == table.column("i")[0].as_py()
        table = table.take(pa.array(np.argsort(~left, kind="stable")))
        ids = table.column("doc_id").to_numpy()
        sets = [s for _, _, words, first, _ in text_words(table.column("text"), True)
                for s in shingle_sets(words, first, k)]
        forest = block_links(ids, sets, int(left.sum()), num, den)
        a, b = (np.array(x, np.int64) for x in (zip(*forest) if forest else ((), ())))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return texts.groupBy("component", "i", "j").applyInArrow(product, "a long, b long")


def jaccard_classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per document; see the module."""
    on_workers(docs.sparkSession)
    docs = ids_and_text(docs, id_col, text_col)
    order = shingle_counts(docs, k)
    sig = written(signatures(docs, k, num, den, order), "signatures")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    reps = written(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
                                              F.first("rare").alias("rare")), "classes")
    # equal texts under one id never differ; different texts under one id are linked by the id itself
    cand = written(candidate_groups(reps, num, den), "candidates")
    sized = reps.groupBy("rep").agg(F.max("n").alias("n"))
    groups = cand.join(sized, cand["node"] == sized["rep"]).select(F.col("node").alias("doc_id"), "component", "n")
    links = linked_rows(docs, groups, k, num, den, block_shingles)
    comps = connected_components(links)
    by_rep = reps.select("digest", "rep").join(comps, F.col("rep") == F.col("node"), "left") \
        .select("digest", F.coalesce("component", "rep").alias("component_id"))
    alone = sig.where("n_shingles = 0 or doc_id is null") \
        .select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (full.select("doc_id", "n_shingles", "digest").join(by_rep, "digest")
            .select("doc_id", "n_shingles", "component_id").unionByName(alone))
