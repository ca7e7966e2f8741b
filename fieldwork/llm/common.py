"""Shared pieces of the training-data operators: vectorised word hashing and scratch tables.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``.
Words and word runs are identified by 64-bit hashes that are computed with
numpy over whole Arrow buffers, a bounded slice at a time, so memory does not
depend on the number of rows of a batch (a single very long text is its own
slice).  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.session import scratch_path, ship_package

SLICE_BYTES = 1 << 20
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_LOWER = _PLAIN.copy()
_LOWER[65:91] += 32  # A-Z
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_ROLL = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first_row, end_row, bytes, offsets)`` pieces of a string column, of about ``limit``
    bytes each (one row at least); null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(offs, np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and the first word of each text (n + 1 entries)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~_SEP[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[offs] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each word (A-Z lower-cased on request)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    at = pos + np.repeat(starts, lens)
    table = _BYTE[_LOWER] if lower else _BYTE
    vals = table[data[at]] * powers(int(_R), int(lens.max()))[pos]
    return mix(np.add.reduceat(vals, first) + lens.astype(np.uint64))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (across text borders too: the caller selects)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            out *= np.uint64(_ROLL)
            out += words[j:n - k + 1 + j]
        return mix(out)
    up, down = powers(_ROLL, n), powers(pow(_ROLL, -1, 2**64), n - k + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    return mix((total[k:] - total[:n - k + 1]) * down)


def text_words(col: pa.Array, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple]]:
    """``(first_row, end_row, word_hashes, first_word_of_row, (bytes, starts, ends))`` for slices of a column."""
    for i, j, data, offs in text_slices(col):
        starts, ends, first = word_spans(data, offs)
        yield i, j, word_hashes(data, starts, ends, lower), first, (data, starts, ends)


def own_runs(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which of the runs of ``k`` words of a slice lie inside one text."""
    ok = np.ones(max(0, n_words - k + 1), bool)
    cross = (first[1:, None] - np.arange(1, k)[None, :]).ravel()
    ok[cross[(cross >= 0) & (cross < len(ok))]] = False
    return ok


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per text: its distinct ``k``-word shingles as sorted hashes; a text of fewer words is one
    shingle (the whole sequence); without words, empty."""
    runs = run_hashes(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(runs[a:b - k + 1])
        elif b > a:
            yield run_hashes(words[a:b], b - a) + np.uint64(b - a)
        else:
            yield runs[:0]


def set_digest(s: np.ndarray) -> bytes:
    """128-bit digest of a sorted set of hashes."""
    a = np.bitwise_xor.reduce(mix(s + np.uint64(7))) if len(s) else np.uint64(0)
    b = np.add.reduce(mix(s ^ _R), dtype=np.uint64) if len(s) else np.uint64(0)
    return np.array([a, b + np.uint64(len(s))], np.uint64).tobytes()


def longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(parts: list[np.ndarray], kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column from one numpy array per row."""
    offs = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offs[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat, type=kind))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Make the package importable in Python workers."""
    ship_package(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared scratch folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns the operators read, under fixed names; other columns never clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def sha256_hex(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)
