"""Packing by power-of-two decomposition.

A document's ids (with its end id) are split into full sequences of ``seq_len`` and, for the rest, pieces whose
lengths are the powers of two of its binary form, longest first.  Every piece is a sequence of its own: no
sequence crosses documents, none is padded, and all sequences of a length form a bucket that a trainer draws whole batches from.
One pass without a shuffle.

Defined results: null or empty text: the end id alone, one piece of length 1.  Repeated rows are
separate documents.  Null doc_id stays null.  Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.llm.common import ids_and_text, on_workers
from fieldwork.llm.tokens import encoder

SEQ_LEN = 2048
WORD_VOCAB = "word_bpe_49k.json"


def decompose(n: int, seq_len: int = SEQ_LEN) -> list[int]:
    """Lengths of the pieces of ``n`` ids, in order."""
    rest = n % seq_len
    return [seq_len] * (n // seq_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, vocab: str = WORD_VOCAB, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, ids_crc32[, ids], sequence_id, offset)`` per piece.

    ``seq_len`` is a power of two.  ``sequence_id`` is unique and the same in every run over the same files; ``length`` is the bucket.
    ``ids_crc32`` is over little-endian unsigned 32-bit ids."""
    if seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, coded in enc.encode_column(batch.column(1)):
                rows: list[list] = [[], [], [], [], []]
                flat, ends = [], [0]
                for key, ids in zip(keys[a:b], coded):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    raw, at = ids.tobytes(), 0
                    for n in decompose(len(ids), seq_len):
                        rows[0].append(key)
                        rows[1].append(at)
                        rows[2].append(n)
                        rows[3].append(len(ids))
                        rows[4].append(zlib.crc32(raw[4 * at:4 * (at + n)]))
                        at += n
                        ends.append(ends[-1] + n)
                    flat.append(ids)
                cols = [pa.array(x, pa.int64()) for x in rows]
                names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        pa.default_memory_pool().release_unused()  # workers outlive the task

    schema = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return (ids_and_text(docs, id_col, text_col).mapInArrow(run, schema)
            .withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length, ready for fixed-shape batches."""
    packed.write.partitionBy("length").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_buckets`` wrote, ids included."""
    return spark.read.schema("doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids array<int>, "
                             "sequence_id long, offset long").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """The pieces without their ids; ``length`` and ``ids_crc32`` are taken from the ids, not from what was noted beside them."""
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            ends = ids.offsets.to_numpy().tolist()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy().astype("<u4"))).cast("B")
            out = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            out["length"] = pa.array(np.diff(ends).astype(np.int64))
            out["ids_crc32"] = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends, ends[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([out[c] for c in cols], names=cols)

    kept = packed.select("doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids")
    return kept.mapInArrow(run, ", ".join(f"{c} long" for c in cols))
