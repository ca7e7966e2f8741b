"""Approximate nearest neighbours by balanced posting lists.

Vectors are normalised; nearness is the cosine, in double precision on the original vectors.

1. Vectors equal in every component are one entry with their ``k + 1`` smallest ids: no answer can use more of them.
2. Centroids are fitted by k-means on a sample of at most ``SAMPLE`` entries (those with the smallest hashed ids), with over-full
   clusters split until none holds more than twice its share; there are at most ``MAX_LISTS`` centroids (four times the root
   of the sample), so they and their neighbour graph are bounded.
3. Every entry is indexed: it goes to the posting lists of its nearest centroid and of the others within ``closure`` times that distance
   (boundary vectors are replicated, at most ``replicas`` lists).
4. Centroids are searched through an in-memory graph of their nearest neighbours, best first from a few entry points; a
   query probes the lists whose distance is within ``ratio`` times the nearest one's, ``probes`` at most, and in any case
   as many as hold ``k + 1`` entries (all lists of a small table).
5. Lists of near centroids stand on one shelf (large ones are dealt to pieces).  An entry goes once to each shelf that holds lists of it, and
   a query to each with lists it probes.  There the queries of a list meet its entries: products in single precision leave
   those that can be among the nearest, which are scored; the best ``k`` of a query's pieces remain.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows with a null id, and vectors of another
length than the most common one take no part.  Repeated rows of one id and vector are one.  Ties go to the smaller id.
Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwork.llm.common import list_array, mix, on_workers, written

SAMPLE = 20_000
MAX_LISTS = 1024  # not more than 4 * sqrt(SAMPLE) = 565 are fitted by default
PIECE = 1 << 17  # entries of one piece of a shelf of posting lists, and queries of one cut


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """``(vec_id, v)``: rows that take part, and the numpy type of a component.  A vector is the bytes of its components, so equal vectors are
    equal bytes; float components stay floats, half the bytes of the doubles they stand for, others are doubles."""
    kind = "float" if vectors.select(vectors[vec_col]).dtypes[0][1] == "array<float>" else "double"
    dtype = {"float": "<f4", "double": "<f8"}[kind]
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast(f"array<{kind}>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            offs = col.offsets.to_numpy().astype(np.int64)
            x = col.values.to_numpy(zero_copy_only=False).astype(dtype)[offs[0]:offs[-1]]  # null components are NaN
            offs = offs - offs[0]
            bad, some = (np.r_[0, np.cumsum(y)] for y in (~np.isfinite(x), x != 0))
            ok = col.is_valid().to_numpy(zero_copy_only=False) & (bad[offs[1:]] == bad[offs[:-1]]) & (some[offs[1:]] > some[offs[:-1]])
            x = x + x.dtype.type(0)  # -0.0 and 0.0 are one value
            v = pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer((offs * x.itemsize).astype(np.int32)), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), v], names=["vec_id", "v"]).filter(pa.array(ok))

    return rows.where("vec_id is not null and v is not null").mapInArrow(pack, "vec_id long, v binary"), dtype


def entries(rows: DataFrame, k: int) -> DataFrame:
    """``(ids, v)`` per distinct vector: its ``k + 1`` smallest ids.  Tasks keep only these before the one exchange by vector."""
    w = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("no", F.dense_rank().over(w)).where(F.col("no") <= k + 1).select("vec_id", "v")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = np.zeros(0, np.int64), pa.array([], pa.binary())  # the last vector's, which may go on in the next batch
        for last, batch in _with_last(batches):
            if batch is not None:
                ids, v = np.r_[ids, batch.column(0).to_numpy()], pa.concat_arrays([v, batch.column(1).cast(pa.binary())])
            if not len(ids):
                continue
            same = np.r_[False, pc.equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)]
            keep = np.flatnonzero(~(same & np.r_[False, ids[1:] == ids[:-1]]))  # each id of a vector once
            ids, v, same = ids[keep], v.take(pa.array(keep)), same[keep]
            first = np.flatnonzero(~same)
            end = len(ids) if last else first[-1]
            offs = np.r_[first[first < end], end]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids)), v.take(pa.array(offs[:-1]))],
                                             names=["ids", "v"])
            ids, v = ids[end:], v[end:]

    return few.repartition("v").sortWithinPartitions("v", "vec_id").mapInArrow(merged, "ids array<long>, v binary")


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    """Whether nothing follows, and a batch; after the last one, nothing."""
    for batch in batches:
        yield False, batch
    yield True, None


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two that makes their largest component about one: no overflow, and the same cosines to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def fit_centroids(x: np.ndarray, n_lists: int, rounds: int = 8) -> np.ndarray:
    """Balanced k-means on unit vectors: over-full clusters lend their centroid to a split, thin ones are dropped."""
    rng = np.random.Generator(np.random.PCG64(9))
    n_lists = max(1, min(n_lists, len(x)))
    c = x[rng.permutation(len(x))[:n_lists]]
    for step in range(rounds):
        near = (x @ c.T).argmax(1)
        count = np.bincount(near, minlength=len(c))
        new = []
        for i in np.flatnonzero(count):
            mine = x[near == i]
            mean = mine.mean(0)
            if count[i] > 2 * len(x) / n_lists and step < rounds - 1:
                far = mine[(mine @ mean).argmin()]
                side = mine @ far > mine @ (mean / (np.linalg.norm(mean) or 1.0))
                if side.any() and not side.all():
                    new += [mine[side].mean(0), mine[~side].mean(0)]
                    continue
            new.append(mean)
        c = np.array(new)
        size = np.linalg.norm(c, axis=1, keepdims=True)
        c = np.where(size > 1e-12, c / np.maximum(size, 1e-12), x[:1])
    return c


def centroid_graph(c: np.ndarray, degree: int = 16) -> np.ndarray:
    """Each centroid's nearest others, (n, degree)."""
    sims = c @ c.T
    np.fill_diagonal(sims, -2)
    degree = min(degree, len(c) - 1)
    return np.argsort(-sims, axis=1, kind="stable")[:, :degree]


def search_graph(q: np.ndarray, c: np.ndarray, graph: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for one query: centroids found and their cosines, nearest first."""
    import heapq
    entry = np.unique(np.linspace(0, len(c) - 1, min(len(c), 24)).astype(int))
    seen = np.zeros(len(c), bool)
    seen[entry] = True
    sims = c[entry] @ q
    queue = [(-s, i) for s, i in zip(sims.tolist(), entry.tolist())]
    best = [(s, i) for s, i in zip(sims.tolist(), entry.tolist())]
    heapq.heapify(queue)
    heapq.heapify(best)
    while len(best) > width:
        heapq.heappop(best)
    while queue:
        s, i = heapq.heappop(queue)
        if len(best) >= width and -s < best[0][0]:
            break
        new = graph[i][~seen[graph[i]]] if graph.shape[1] else graph[i]
        seen[new] = True
        for t, j in zip((c[new] @ q).tolist(), new.tolist()):
            if len(best) < width or t > best[0][0]:
                heapq.heappush(queue, (-t, j))
                heapq.heappush(best, (t, j))
                if len(best) > width:
                    heapq.heappop(best)
    best.sort(key=lambda x: (-x[0], x[1]))
    return np.array([i for _, i in best], np.int64), np.array([s for s, _ in best])


def _distance(sims: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * sims, 0.0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", probes: int = 96,
            ratio: float = 1.6, closure: float = 1.15, replicas: int = 6, sample: int = SAMPLE, max_lists: int = MAX_LISTS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each row whose id is divisible by ``every``, the ``k`` nearest other rows found."""
    spark = vectors.sparkSession
    on_workers(spark)
    rows, dtype = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.octet_length("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return none
    rows = rows.where(F.octet_length("v") == lengths[0]["d"])
    dims = lengths[0]["d"] // np.dtype(dtype).itemsize
    index = written(entries(rows, k), "ann-entries")
    picked = index.select("v", F.xxhash64(F.col("ids")[0]).alias("h")).orderBy("h").limit(sample)
    fitted = written(picked.select("v").repartition(1).mapInArrow(_fit(max_lists, dtype, dims), "centroid array<double>"), "ann-centroids")
    c = np.array([r["centroid"] for r in fitted.collect()], np.float64)  # at most 2 * max_lists
    shared = spark.sparkContext.broadcast((c, centroid_graph(c)))

    def lists_of(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the lists they belong to, by row and by distance."""
        sims = _unit(_matrix(v, dtype, dims)) @ shared.value[0].T
        some = np.sort(np.argpartition(-sims, replicas - 1, axis=1)[:, :replicas], axis=1) if sims.shape[1] > replicas \
            else np.tile(np.arange(sims.shape[1]), (len(sims), 1))
        top = np.take_along_axis(some, np.argsort(-np.take_along_axis(sims, some, 1), axis=1, kind="stable"), 1)
        dist = _distance(np.take_along_axis(sims, top, 1))
        row, col = np.nonzero(dist <= closure * dist[:, :1] + 1e-12)
        return row, top[row, col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(shared.value[0]), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                n += np.bincount(lists_of(batch.column(0).slice(a, 2048))[1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["list_no", "n"])

    sizes = np.zeros(len(c), np.int64)
    for r in index.select("v").mapInArrow(count, "list_no long, n long").groupBy("list_no").agg(F.sum("n").alias("n")).collect():  # one row a list
        sizes[r["list_no"]] = r["n"]
    shelf = shelves(c, sizes, max(4 * spark.sparkContext.defaultParallelism, -(-int(sizes.sum()) // PIECE)))
    pieces = np.maximum(1, -(-np.bincount(shelf, sizes).astype(np.int64) // PIECE))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents, graph = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = _unit(_matrix(part.column(1), dtype, dims))
                lists = []
                for r in range(len(x)):
                    if len(cents) > probes:
                        found, sims = search_graph(x[r], cents, graph, probes)
                    else:
                        found = np.argsort(-(cents @ x[r]), kind="stable")
                        sims = cents[found] @ x[r]
                    dist = _distance(sims)
                    held = np.cumsum(sizes[found]) - sizes[found]  # entries, with replicas, in the nearer lists
                    near = (dist <= ratio * dist[0] + 1e-12) | (held < replicas * (k + 1))
                    if held[-1] + sizes[found[-1]] < replicas * (k + 1) and len(found) < len(cents):
                        found, near = np.arange(len(cents)), np.ones(len(cents), bool)
                    lists.append(found[near])
                yield pa.RecordBatch.from_arrays([*part.columns, list_array(lists, pa.int32())], names=["query_id", "q", "lists"])

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct().select("vec_id", "v").repartition(4 * spark.sparkContext.defaultParallelism)
    asked = written(asked.mapInArrow(probe, "query_id long, q binary, lists array<int>"), "ann-asked")

    def count_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(pieces), np.int64)
        for batch in batches:
            n += np.bincount(_by_shelf(*_members(batch.column(0)), shelf)[1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["shelf", "n"])

    cuts = np.ones(len(pieces), np.int64)  # of a shelf's queries
    for r in asked.select("lists").mapInArrow(count_asks, "shelf long, n long").groupBy("shelf").agg(F.sum("n").alias("n")).collect():  # one row a shelf
        cuts[r["shelf"]] = max(1, -(-r["n"] // PIECE))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries go to a cut of theirs with every piece of the shelf."""
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                row, on, lists = _by_shelf(*_members(part.column(2)), shelf)
                cut = mix(part.column(0).to_numpy().view(np.uint64))[row] % cuts.astype(np.uint64)[on]
                each, piece = _copies(pieces[on])
                yield _dealt(on[each], piece, cut[each], lists, each, part, row, ["query_id", "q"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries go to a piece of theirs with every cut of the shelf's queries."""
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                row, on, lists = _by_shelf(*lists_of(part.column(1)), shelf)
                ids = part.column(0)
                first = ids.flatten().to_numpy()[np.cumsum(_lengths(ids)) - _lengths(ids)]
                piece = mix(first.view(np.uint64))[row] % pieces.astype(np.uint64)[on]
                each, cut = _copies(cuts[on])
                yield _dealt(on[each], piece[each], cut, lists, each, part, row, ["ids", "v"])

    place = ["shelf", "piece", "cut"]
    posts = index.select("ids", "v").mapInArrow(assign, "shelf int, piece int, cut int, lists array<int>, ids array<long>, v binary")
    asks = asked.select("query_id", "q", "lists").mapInArrow(deal, "shelf int, piece int, cut int, lists array<int>, query_id long, q binary")
    n = int((pieces * cuts).sum())
    posts, asks = posts.repartition(n, *place), asks.repartition(n, *place)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            best = _Best(left, right, k, dtype, dims)
            (asker, asked_of), (held, holds) = (_by_list(t.column("lists")) for t in (left, right))
            for no in np.intersect1d(asked_of, holds).tolist():
                a, e = (x[slice(*np.searchsorted(y, [no, no + 1]))] for x, y in ((asker, asked_of), (held, holds)))
                best.scan(a, e)
            out = best.found()
        return pa.table(dict(zip(("query_id", "vec_id", "score"), out, strict=True)))

    found = asks.groupBy(*place).cogroup(posts.groupBy(*place)).applyInArrow(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def shelves(c: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """The shelf of each list: ``n`` at most, of near centroids and about as many entries each.  What belongs to several lists of a
    shelf, an entry or a query, is sent to it once."""
    groups = [np.arange(len(c))]
    while len(groups) < min(n, len(c)):
        at = max((i for i, g in enumerate(groups) if len(g) > 1), key=lambda i: (sizes[groups[i]].sum(), len(groups[i])))
        g = groups.pop(at)
        x = c[g] - c[g].mean(0)
        g = g[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        held = np.cumsum(sizes[g])
        cut = min(max(int(np.searchsorted(held, held[-1] / 2)) + 1, 1), len(g) - 1)
        groups += [g[:cut], g[cut:]]
    out = np.zeros(len(c), np.int64)
    for i, g in enumerate(groups):
        out[g] = i
    return out


def _by_shelf(row: np.ndarray, lists: np.ndarray, shelf: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each row's shelves, and its lists there."""
    order = np.lexsort((shelf[lists], row))
    row, lists = row[order], lists[order]
    on = shelf[lists]
    new = np.flatnonzero(np.r_[len(row) > 0, (row[1:] != row[:-1]) | (on[1:] != on[:-1])])
    offs = np.r_[new, len(row)].astype(np.int32)
    return row[new], on[new], pa.ListArray.from_arrays(pa.array(offs), pa.array(lists, pa.int32()))


def _copies(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row ``n`` times, and the number of the copy."""
    each = np.repeat(np.arange(len(n)), n)
    return each, np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)


def _dealt(shelf: np.ndarray, piece: np.ndarray, cut: np.ndarray, lists: pa.Array, each: np.ndarray, part: pa.RecordBatch, row: np.ndarray,
           names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in (shelf, piece, cut)], lists.take(pa.array(each)),
                                       *[part.column(i).take(pa.array(row[each])) for i in range(2)]], names=["shelf", "piece", "cut", "lists", *names])


def _members(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their lists."""
    return np.repeat(np.arange(len(col)), _lengths(col)), col.flatten().to_numpy()


def _by_list(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their lists, by list."""
    row, lists = _members(_whole(col))
    order = np.argsort(lists, kind="stable")
    return row[order], lists[order]


def _whole(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _lengths(col: pa.Array) -> np.ndarray:
    return col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _matrix(col: pa.Array | pa.ChunkedArray, dtype: str, dims: int) -> np.ndarray:
    """Vectors as rows, in their own type."""
    col = _whole(col).cast(pa.binary())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int32)[col.offset:col.offset + len(col) + 1] if len(col) else [0, 0]
    return np.frombuffer(data or b"", np.uint8)[offs[0]:offs[-1]].view(dtype).reshape(-1, dims)


class _Best:
    """The ``k`` nearest ids of each query of a piece.

    A single-precision product of unit vectors leaves the entries that can be among the nearest: none whose cosine is within ``err``, more than
    such a product can be wrong, is left out.  Those are compared in double precision on the original vectors.
    """

    def __init__(self, asks: pa.Table, posts: pa.Table, k: int, dtype: str, dims: int) -> None:
        self.q, self.x, self.k = _matrix(asks.column("q"), dtype, dims), _matrix(posts.column("v"), dtype, dims), k
        self.qid = asks.column("query_id").to_numpy()
        ids = _whole(posts.column("ids"))
        self.n_ids, self.ids = _lengths(ids), ids.flatten().to_numpy()
        self.starts = np.cumsum(self.n_ids) - self.n_ids
        self.q32, self.x32 = _single(self.q), _single(self.x)
        self.err = (self.x.shape[1] + 16) * 2.0**-23
        self.score, self.near = np.full((len(self.q), k), -np.inf), np.zeros((len(self.q), k), np.int64)

    def scan(self, asks: np.ndarray, posts: np.ndarray) -> None:
        for i in range(0, len(posts), 4096):
            e = posts[i:i + 4096]
            right = self.x32[e].T
            for j in range(0, len(asks), 1024):
                a = asks[j:j + 1024]
                sims, m = self.q32[a] @ right, self.k + 1
                while len(a):
                    low = self.score[a, -1] - self.err
                    free = np.isinf(low)  # fewer than k are known
                    if m < len(e) and free.any():
                        low[free] = np.partition(sims[free], len(e) - m, axis=1)[:, len(e) - m] - 2 * self.err
                    row, col = np.divmod(np.flatnonzero(sims >= low[:, None].astype(np.float32)), len(e))  # faster than nonzero of two axes
                    self._take(a[row], e[col])
                    if m >= len(e):
                        break
                    m *= 8  # where ids repeat, more entries are needed
                    left = free & np.isinf(self.score[a, -1])
                    a, sims = a[left], sims[left]

    def _take(self, asks: np.ndarray, posts: np.ndarray) -> None:
        for i in range(0, len(asks), 1 << 15):
            a, e = asks[i:i + (1 << 15)], posts[i:i + (1 << 15)]
            q, x = _scaled(self.q[a].astype(np.float64)), _scaled(self.x[e].astype(np.float64))
            s = np.einsum("ij,ij->i", x, q) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", q, q)))
            n = self.n_ids[e]
            at = np.arange(int(n.sum())) + np.repeat(self.starts[e] - (np.cumsum(n) - n), n)
            row, ids, s = np.repeat(a, n), self.ids[at], np.repeat(s, n)
            other = ids != self.qid[row]
            mine = np.unique(a)
            known = np.isfinite(self.score[mine])
            row, ids, s = (np.concatenate(x) for x in ((row[other], np.repeat(mine, known.sum(1))), (ids[other], self.near[mine][known]),
                                                       (s[other], self.score[mine][known])))
            order = np.lexsort((-s, ids, row))
            row, ids, s = row[order], ids[order], s[order]
            once = np.r_[len(row) > 0, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])][:len(row)]
            row, ids, s = row[once], ids[once], s[once]
            order = np.lexsort((ids, -s, row))
            row, ids, s = row[order], ids[order], s[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, ids, s, place = (x[place < self.k] for x in (row, ids, s, place))
            self.score[row, place], self.near[row, place] = s, ids

    def found(self) -> list[np.ndarray]:
        row, place = np.nonzero(np.isfinite(self.score))
        return [self.qid[row], self.near[row, place], self.score[row, place]]


def _single(x: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    out = np.empty(x.shape, np.float32)
    for i in range(0, len(x), 8192):
        out[i:i + 8192] = _unit(x[i:i + 8192])
    return out


def _fit(max_lists: int, dtype: str, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [_matrix(b.column(0), dtype, dims) for b in batches]
        if sum(map(len, rows)):
            x = _unit(np.concatenate(rows))
            c = fit_centroids(x, min(max_lists, max(1, int(4 * len(x) ** 0.5))))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.float64()))], names=["centroid"])
    return run
