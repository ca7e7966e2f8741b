"""Centroid clustering over a zone map that follows a space-filling curve.

Vectors are turned into integers, sorted along a Hilbert curve (over the leading principal axes of a bounded sample: the
axes steer the order, never a result) and written as blocks of ``BLOCK`` vectors, each with its box of smallest and largest components.
In a round every block first asks its box: a centroid is a candidate only if, somewhere in the box, it is not farther than the
centroid whose farthest point of the box is nearest; the others cannot be nearest to any vector of the block.  The candidates are
then compared exactly with all its vectors at once.  Partial sums of each task are added up by Spark; centroids (``k`` rows), nothing else,
pass through the driver.

Arithmetic is exact: integers of up to 22 bits in doubles that hold every intermediate value, larger ones as Python
integers, sums in limbs of 40 bits.

Defined results: a vector that is null, has another number of components, or holds a null or non-finite one (after
scaling) takes no part and has no row.  Repeated rows are separate vectors.  A null id can be clustered, and starts a
centroid only if there are too few others; vectors with one id are ordered by their components.  Fewer vectors than ``k``: as many
centroids as vectors.  Equal distances: the smaller centroid number.  Distances and sums beyond a long are given as the largest
long.  Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwork.llm.common import on_workers, written

BLOCK = 256        # vectors of a block
SAMPLE = 4096      # the axes of the curve are taken from about so many vectors, twice as many at most
AXES, BITS = 8, 7  # the curve: 56 bits
SMALL = 1 << 22    # below, 64 components' sums of products are exact in doubles; narrower for more components
LIMB = 40
LARGEST = (1 << 63) - 1


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integers in [0, 2**bits); columns x bits may not exceed 63."""
    x = points.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):  # turn and mirror the sub-cubes, large ones first
        low = (1 << level) - 1
        for axis in range(len(x)):
            upper = (x[axis] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(upper, low, swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            key = key << 1 | (x[axis] >> level & 1)
    return key


class Curve:
    """Maps vectors to curve keys; fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray):
        x = np.clip(sample, -1e100, 1e100)
        self.mean = x.mean(0)
        scale = np.abs(x - self.mean).max() or 1.0
        axes = np.linalg.svd((x - self.mean) / scale, full_matrices=False)[2][:AXES]
        self.axes = axes / scale
        at = (x - self.mean) @ self.axes.T
        self.low, high = at.min(0), at.max(0)
        self.step = np.maximum((high - self.low) / (1 << BITS), 1e-300)

    def keys(self, x: np.ndarray) -> np.ndarray:
        at = (np.clip(x, -1e100, 1e100) - self.mean) @ self.axes.T
        return hilbert_keys(np.clip((at - self.low) / self.step, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _matrix(col: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of a column of equally long lists, as doubles (which hold these integers exactly)."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.astype(np.float64) * scale).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def box_candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids (numbers, ascending) that may be nearest, ties included, to some point of the box; exact for small integers."""
    far = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    best = centroids[np.argmin((far * far).sum(1))]
    gap = centroids - best
    # d(x, c) - d(x, best) is linear in x, so its minimum over the box is at a corner
    least = ((centroids * centroids - best * best) - 2 * gap * np.where(gap > 0, high, low)).sum(1)
    return np.flatnonzero(least <= 0)


def nearest_in_block(x: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of, and exact squared distance to, each vector's nearest centroid; ``centroids`` are doubles or Python integers."""
    narrow = SMALL >> max(0, (x.shape[1] - 1).bit_length() - 6)
    if centroids.dtype != object and max(np.abs(low).max(), np.abs(high).max(), np.abs(centroids).max()) <= narrow:
        some = box_candidates(low, high, centroids)
        c = centroids[some]
        d = (c * c).sum(1) - 2 * (x @ c.T)
        at = np.argmin(d, 1)
        return some[at], (d[np.arange(len(x)), at] + (x * x).sum(1)).astype(np.int64)
    wide, c = _integers(x), _integers(centroids)
    d = np.stack([((wide - one) ** 2).sum(1) for one in c], 1)
    at = np.array([min(range(len(c)), key=row.__getitem__) for row in d.tolist()], np.int64)
    return at, np.array([min(int(d[i, j]), LARGEST) for i, j in enumerate(at.tolist())], np.int64)


def blocks_of(vectors: DataFrame, scale: float, block: int) -> DataFrame | None:
    """Vectors sorted along the curve and written as blocks ``(ids, vectors, low, high)``; None if there are none."""
    spark = vectors.sparkSession
    total = vectors.count()
    if not total:
        return None
    share = max(1, min(1 << 30, int((SAMPLE / total) * (1 << 30))))  # of 2**30 hash values; about SAMPLE vectors at any size
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < share).limit(2 * SAMPLE).select("v").collect()
    sample = [r[0] for r in drawn or vectors.limit(SAMPLE).select("v").collect()]  # few different vectors: any
    curve = Curve(np.floor(np.array(sample, np.float64) * scale))
    on_workers(spark)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(curve.keys(_matrix(batch.column(1), scale)), pa.int64()), *batch.columns],
                                             names=["key", "vec_id", "v"])

    def zoned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), scale)
            cut = range(0, len(x), block)
            pieces = [x[a:a + block] for a in cut]
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column(0).slice(a, block).to_pylist() for a in cut], pa.list_(pa.int64())),
                pa.array([p.astype("<f8").tobytes() for p in pieces], pa.binary()),
                pa.array([p.min(0) for p in pieces], pa.list_(pa.float64())),
                pa.array([p.max(0) for p in pieces], pa.list_(pa.float64()))], names=["ids", "vectors", "low", "high"])

    # copies share a key: ids, and row numbers for equal ids, spread a group of any size over tasks
    order = ["key", "vec_id", "row"]
    ranged = (vectors.mapInArrow(keyed, "key long, vec_id long, v array<double>").withColumn("row", F.monotonically_increasing_id())
              .repartitionByRange(*order).sortWithinPartitions(*order))
    zones = ranged.select("vec_id", "v").mapInArrow(zoned, "ids array<long>, vectors binary, low array<double>, high array<double>")
    return written(zones, "zones")


def _assign(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    ids = batch.column("ids")
    for i, raw in enumerate(batch.column("vectors")):
        low = np.array(batch.column("low")[i].as_py())
        high = np.array(batch.column("high")[i].as_py())
        x = np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, len(low))
        yield (ids[i].values, x, *nearest_in_block(x, low, high, centroids))


def _limbs(total: int) -> list[int]:
    sign, rest, out = (-1 if total < 0 else 1), abs(total), []
    while rest or not out:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


def _sums(zones: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per centroid: how many vectors are nearest to it, and their exact componentwise sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x, at, _ in _assign(batch, centroids):
                small = np.abs(x).max() < 2 ** 40
                for c in np.unique(at).tolist():
                    mine = x[at == c]
                    part = mine.astype(np.int64).sum(0).tolist() if small else [int(v) for v in _integers(mine).sum(0)]
                    seen = total.setdefault(c, [0, [0] * x.shape[1]])
                    seen[0] += len(mine)
                    seen[1] = [a + b for a, b in zip(seen[1], part)]
        rows = []
        for c, (n, s) in total.items():
            limbs = [_limbs(v) for v in s]
            for j in range(max(map(len, limbs))):
                rows.append((c, j, n if j == 0 else 0, [v[j] if j < len(v) else 0 for v in limbs]))
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                          pa.array(cols[3], pa.list_(pa.int64()))], names=["cluster", "limb", "n", "s"])

    parts = zones.mapInArrow(run, "cluster int, limb int, n long, s array<long>")
    rows = (parts.select("cluster", "limb", "n", F.posexplode("s").alias("dim", "s")).groupBy("cluster", "limb", "dim")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())  # k x dims x limbs rows
    out: dict[int, tuple[int, list[int]]] = {}
    for c in {r["cluster"] for r in rows}:
        mine = [r for r in rows if r["cluster"] == c]
        total = [0] * (1 + max(r["dim"] for r in mine))
        for r in mine:
            total[r["dim"]] += int(r["s"]) << (LIMB * r["limb"])
        out[c] = (next(r["n"] for r in mine if r["limb"] == 0), total)
    return out


def _array(centroids: list[list[int]]) -> np.ndarray:
    """Doubles where these hold the integers and their products exactly, Python integers otherwise."""
    small = all(abs(v) <= SMALL for c in centroids for v in c)
    return np.array(centroids, np.float64 if small else object)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: str = "3:",
            id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` per vector of ``dims`` finite components.

    Components become ``floor(scale * x)``.  Centroids start as the ``k`` vectors whose SHA-256 of ``seed`` + id is smallest; each round
    assigns all vectors and moves every non-empty centroid to ``floor(sum / count)``; a last assignment follows."""
    spark = vectors.sparkSession
    v = vectors[vec_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v"))
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce((F.size("v") == dims) & fits, F.lit(False)))
    zones = blocks_of(rows, scale, block)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if zones is None:
        return spark.createDataFrame([], schema)
    first = rows.orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = [[int(c) for c in np.floor(np.array(r["v"], np.float64) * scale)] for r in first]
    for _ in range(rounds):
        for c, (n, total) in _sums(zones, _array(centroids)).items():
            centroids[c] = [t // n for t in total]
    final = _array(centroids)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, at, d in _assign(batch, final):
                yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(d, pa.int64())],
                                                 names=["vec_id", "cluster", "distance"])

    out = written(zones.mapInArrow(label, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r[0]: int(r[1]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows

    def per_cluster(values: list) -> F.Column:
        return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1)

    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return out.select("vec_id", "cluster", "distance",
                      per_cluster([min(inertia.get(c, 0), LARGEST) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
                      F.lit(min(sum(inertia.values()), LARGEST)).cast("long").alias("inertia"), per_cluster(digest).alias("centroid_sha256"))
