"""Token ids in a binary file format: patched frame-of-reference blocks.

A file holds documents in ascending doc_id order; files of a store are in that order too.  Each row of a file
(a Parquet container, so any store Spark can write will do) is one document: its ids in blocks of ``BLOCK``.
Payload, little-endian: u32 ids, u32 block size, then an index of (u32 byte offset) per block; a block is
u32 minimum, u8 width, u8 unused, u16 exceptions, the ids minus the minimum bit-packed
at ``width`` into little-endian 64-bit words (low bits first), then the exceptions: u16 places and u32 full values less the minimum.  The width is the one that
holds the ``PERCENTILE`` of the block's values; larger values are exceptions.  A last short block is filled up with its last id.  Any block is read without the others.

Order: ``(doc_id, text hash)``, nulls first, so repeated rows and a doc_id with very many rows spread over files.
Null or empty text: the end id alone.  Empty table: an empty store.  Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwork.llm.common import on_workers
from fieldwork.llm.tokens import encoder

BLOCK = 128
PERCENTILE = 90.0
ROWS = 500  # documents decoded at a time
BYTE_VOCAB = "byte_bpe_50k.json"


def _widths(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.uint64(1) << np.arange(33, dtype=np.uint64), x.astype(np.uint64), side="right")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of 2 * width little-endian 64-bit words."""
    cols = np.ascontiguousarray(values.T).astype(np.uint64)
    out = np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[word] |= cols[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= cols[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    src = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, words.shape[0]), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[i] = src[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= src[word + 1] << np.uint64(64 - shift)
    out &= np.uint64((1 << width) - 1)
    return np.ascontiguousarray(out.T).astype(np.uint32)


def encode_many(docs: list[np.ndarray], percentile: float = PERCENTILE) -> list[bytes]:
    """The payload of each document; all blocks of the call are encoded together."""
    sizes = np.array([len(x) for x in docs], np.int64)
    blocks = -(-sizes // BLOCK)
    n = int(blocks.sum())
    first = np.cumsum(blocks) - blocks
    flat = np.concatenate([*docs, np.zeros(0, np.uint32)]).astype(np.uint32)
    last = np.array([x[-1] if len(x) else 0 for x in docs], np.uint32)
    v = np.repeat(last, blocks * BLOCK)  # the last block is filled up with the last id
    v[np.arange(len(flat)) + np.repeat(first * BLOCK - (np.cumsum(sizes) - sizes), sizes)] = flat
    v = v.reshape(n, BLOCK)
    low = v.min(1) if n else np.zeros(0, np.uint32)
    rest = v - low[:, None]
    rank = min(BLOCK - 1, int(BLOCK * percentile / 100))
    width = _widths(np.partition(rest, rank, axis=1)[:, rank]) if n else np.zeros(0, np.int64)
    over = rest.astype(np.uint64) >> width.astype(np.uint64)[:, None] != 0
    rows, places = np.nonzero(over)
    n_out = np.bincount(rows, minlength=n)
    size = 8 + BLOCK // 8 * width + 6 * n_out
    head = 8 + 4 * blocks
    ends = np.cumsum(size)
    in_doc = (ends - size) - np.repeat((ends - size)[np.minimum(first, max(n - 1, 0))] if n else first, blocks) \
        + np.repeat(head, blocks)  # byte offset of each block in its payload
    body = np.zeros(int(size.sum()), np.uint8)
    at = ends - size
    header = np.zeros((n, 8), np.uint8)
    header[:, :4] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    header[:, 4] = width
    header[:, 6:] = n_out.astype("<u2").view(np.uint8).reshape(n, 2)
    body[at[:, None] + np.arange(8)] = header
    small = np.where(over, 0, rest)
    for w in np.unique(width).tolist():
        if w:
            sel = np.flatnonzero(width == w)
            raw = _pack(small[sel], w).astype("<u8").view(np.uint8).reshape(len(sel), -1)
            body[at[sel][:, None] + 8 + np.arange(raw.shape[1])] = raw
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
    base = at[rows] + 8 + BLOCK // 8 * width[rows]
    body[(base + 2 * nth)[:, None] + np.arange(2)] = places.astype("<u2").view(np.uint8).reshape(-1, 2)
    body[(base + 2 * n_out[rows] + 4 * nth)[:, None] + np.arange(4)] = rest[rows, places].astype("<u4").view(np.uint8).reshape(-1, 4)
    raw, out = body.tobytes(), []
    for i, (k, f, m) in enumerate(zip(sizes.tolist(), first.tolist(), blocks.tolist())):
        index = in_doc[f:f + m].astype("<u4").tobytes()
        out.append(struct.pack("<II", k, BLOCK) + index + (raw[int(at[f]):int(ends[f + m - 1])] if m else b""))
    return out


def decode_many(payloads: list[bytes], only: int | None = None) -> list[np.ndarray]:
    """The ids of each payload; with ``only``, of that block of each, found by the index."""
    counts = np.array([struct.unpack_from("<I", p)[0] for p in payloads], np.int64)
    blocks = -(-counts // BLOCK)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    lens = np.array([len(p) for p in payloads], np.int64)
    base = np.cumsum(lens) - lens
    which = [range(m) if only is None else range(only, min(only + 1, m)) for m in blocks.tolist()]
    at = np.array([b + struct.unpack_from("<I", p, 8 + 4 * i)[0]
                   for b, p, r in zip(base.tolist(), payloads, which) for i in r], np.int64)
    n = len(at)
    header = data[at[:, None] + np.arange(8)] if n else np.zeros((0, 8), np.uint8)
    low = np.ascontiguousarray(header[:, :4]).view("<u4").ravel()
    width = header[:, 4].astype(np.int64)
    n_out = np.ascontiguousarray(header[:, 6:]).view("<u2").ravel().astype(np.int64)
    v = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            sel = np.flatnonzero(width == w)
            raw = data[at[sel][:, None] + 8 + np.arange(BLOCK // 8 * w)]
            v[sel] = _unpack(np.ascontiguousarray(raw).view("<u8").astype(np.uint64), w)
    rows = np.repeat(np.arange(n), n_out)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(n_out) - n_out, n_out)
    ex = at[rows] + 8 + BLOCK // 8 * width[rows]
    places = np.ascontiguousarray(data[(ex + 2 * nth)[:, None] + np.arange(2)]).view("<u2").ravel()
    v[rows, places] = np.ascontiguousarray(data[(ex + 2 * n_out[rows] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    v += low[:, None]
    flat, out, f = v.ravel(), [], 0
    for k, r in zip(counts.tolist(), which):
        size = min(k - r.start * BLOCK, len(r) * BLOCK) if len(r) else 0
        out.append(flat[f * BLOCK:f * BLOCK + size])
        f += len(r)
    return out


def write_store(docs: DataFrame, path: str, vocab: str = BYTE_VOCAB, end_id: int = 2, id_col: str = "doc_id",
                text_col: str = "text") -> None:
    """Tokenise and write: one range shuffle of the text by doc_id, then each task writes its range of documents."""
    on_workers(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, row, start = encoder(vocab), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            keys = batch.column(0)
            for a, b, coded in enc.encode_column(batch.column(1)):
                ids = [np.append(x, np.uint32(end_id)) for x in coded]
                sizes = np.array([len(x) for x in ids], np.int64)
                ends = start + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * (b - a), pa.int32()), pa.array(np.arange(row, row + b - a)), keys.slice(a, b - a),
                     pa.array(ends - sizes), pa.array(sizes), pa.array(encode_many(ids), pa.binary())],
                    names=["file_no", "row_no", "doc_id", "file_start", "n_tokens", "payload"])
                row, start = row + b - a, int(ends[-1])

    ordered.select("doc_id", "text").mapInArrow(
        run, "file_no int, row_no long, doc_id long, file_start long, n_tokens long, payload binary").write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``(file_no, row_no, doc_id, start, n_tokens, payload)``; ``start`` counts the ids of all documents before.

    Only the sizes of the files are added up outside their own file; that table, one row a file, is broadcast."""
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("file_no", F.coalesce(F.sum("n").over(
        Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return (rows.join(F.broadcast(before), "file_no").withColumn("start", F.col("before") + F.col("file_start"))
            .select("file_no", "row_no", "doc_id", "start", "n_tokens", "payload"))


def decoded(store: DataFrame, with_ids: bool = True) -> DataFrame:
    """Decode a store's documents: ``(doc_id, start, n_tokens, ids_crc32[, ids])``."""
    on_workers(store.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(2).to_pylist()
            for a in range(0, len(payloads), ROWS):
                b = min(a + ROWS, len(payloads))
                ids = decode_many(payloads[a:b])
                cols = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return store.select("doc_id", "start", "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
