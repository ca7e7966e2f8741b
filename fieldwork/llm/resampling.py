"""Importance resampling towards a target distribution: array-scored weights, then a distributed quickselect.

Every text is read once: its word runs become bucket numbers, written as one array a document.  The buckets' counts over all
documents and over all target texts give a gain per bucket (an array of fixed length); a document's weight is the sum of
its buckets' gains, and its score adds seeded Gumbel noise, so that the highest scores are a draw without replacement.

The k-th highest key is found without sorting all rows.  Each round draws ``PIVOTS`` random keys from the interval that
is left, counts in one pass the rows above, at and below each of them, and keeps the one interval that holds the k-th key, which
is written anew, so the rounds' work shrinks geometrically.  Only the winners are then sorted (range partitioned) and ranked.

A key is (score descending, doc_id, n_features).  Defined results: a null or empty text has no features and weight 0.  A
null doc_id has no noise: its score is null and it is never drawn nor counted.  Repeated rows are separate documents
with equal scores; among equal keys any is ranked first, and exactly as many as are to be drawn are.  Empty tables: no rows, or, without
target texts, gains against an empty target.  Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwork.llm.common import _LOWER, ids_and_text, on_workers, text_slices, written
from fieldwork.operators.numbering import sequence_number

BUCKETS = 10_000
PIVOTS = 32
PIECE = 1 << 16  # words hashed at a time
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True  # after A-Z are lower-cased


def word_runs(data: np.ndarray, offs: np.ndarray, low: int, high: int, buckets: int) -> Iterator[tuple[np.ndarray, int]]:
    """Per text: the bucket of every run of ``low`` to ``high`` words, and its number of words."""
    data = _LOWER[data]
    if not len(data):
        yield from ((np.zeros(0, np.uint32), 0) for _ in offs[1:])
        return
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.concatenate([[False], letter[:-1]])
    after = np.concatenate([letter[1:], [False]])
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offs)
    raw, crc = data.tobytes(), zlib.crc32
    if high == 1:
        codes = np.empty(len(starts), np.uint32)
        for i in range(0, len(starts), PIECE):
            codes[i:i + PIECE] = [crc(raw[a:b]) for a, b in zip(starts[i:i + PIECE].tolist(), ends[i:i + PIECE].tolist())]
        codes %= np.uint32(buckets)
        yield from ((codes[a:b], b - a) for a, b in zip(first[:-1].tolist(), first[1:].tolist()))
        return
    words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        codes = [crc(b" ".join(words[i:i + n])) for n in range(low, high + 1) for i in range(a, b - n + 1)]
        yield np.array(codes, np.uint32) % np.uint32(buckets), b - a


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def featured(docs: DataFrame, low: int, high: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n_words, codes)``: the buckets of a document's features, two or four bytes each."""
    on_workers(docs.sparkSession)
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column(1)):
                rows = list(word_runs(data, offs, low, high, buckets))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([n for _, n in rows], pa.int64()),
                    pa.array([c.astype(kind).tobytes() for c, _ in rows], pa.binary())], names=["doc_id", "n_words", "codes"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, codes binary")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features lie in each bucket; a task sends one row a bucket at most, the driver gets one row a bucket."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("codes").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) per bucket, in doubles."""
    b, total, wanted = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (total + b) / ((s + 1.0) * (wanted + b))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``."""
    kind = _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.frombuffer(raw.as_buffer(), kind) for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(c) for c in codes], pa.int64()),
                pa.array([int(gain[c].sum()) for c in codes], pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)) of a uniform number drawn from SHA-256 of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


KEY = ("score", "doc_id", "n_features")


def _before(key: tuple) -> Column:
    """Rows that rank strictly before a key."""
    score, doc, n = (F.lit(x).cast("long") for x in key)
    s, d, f = (F.col(c) for c in KEY)
    return (s > score) | ((s == score) & ((d < doc) | ((d == doc) & (f < n))))


def _at(key: tuple) -> Column:
    return (F.col("score") == key[0]) & (F.col("doc_id") == key[1]) & (F.col("n_features") == key[2])


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS) -> tuple | None:
    """The key at rank ``k`` (from 1) of ``(score, doc_id, n_features)`` rows without nulls; None if there are fewer.

    Every round removes at least its pivots, so it ends; the expected number of rounds is logarithmic in the rows, to the base of about
    half of ``pivots``.  ``2 * pivots + 1`` counts a round reach the driver."""
    left, turn = keys, 0
    while k >= 1:
        turn += 1
        drawn = left.orderBy(F.xxhash64(F.lit(turn), *KEY), *KEY).limit(pivots).collect()
        if not drawn:
            return None
        marks = sorted({tuple(r[c] for c in KEY) for r in drawn}, key=lambda m: (-m[0], m[1], m[2]))
        counts = left.agg(*[F.count_if(_before(m)).alias(f"b{i}") for i, m in enumerate(marks)],
                          *[F.count_if(_at(m)).alias(f"e{i}") for i, m in enumerate(marks)], F.count(F.lit(1)).alias("n")).first()
        at = next((i for i in range(len(marks)) if k <= counts[f"b{i}"] + counts[f"e{i}"]), None)
        if at is not None and k > counts[f"b{at}"]:
            return marks[at]
        above = None if at == 0 else marks[at - 1 if at is not None else -1]  # the interval begins after this key
        inside = left
        if above is not None:
            inside = inside.where(~_before(above) & ~_at(above))
            i = marks.index(above)
            k -= counts[f"b{i}"] + counts[f"e{i}"]
        if at is not None:
            inside = inside.where(_before(marks[at]))
        left = written(inside, "quickselect")
    return None


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, low: int = 1, high: int = 1, buckets: int = BUCKETS,
             least_words: int = 20, seed: str = "2024:", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document; ``rank`` is null unless it was drawn.

    Of the N documents with an id and at least ``least_words`` words, ``floor(percent * N / 100)`` are drawn.
    ``target`` has a column ``text``."""
    features = written(featured(docs, low, high, buckets, id_col, text_col), "features")
    wanted = featured(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), low, high, buckets, "doc_id", "text")
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    scored = written(weighted(features, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    enters = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    keys = scored.where(enters).select(*KEY)
    k = keys.count() * percent // 100
    last = kth_key(keys, k)
    cols = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*cols, F.lit(None).cast("long").alias("rank"))
    wins = enters & (_before(last) | _at(last))
    winners = scored.where(wins).select(*cols, (-F.col("score")).alias("order"))
    ranked = sequence_number(winners, [], ["order", "doc_id", "n_features"], name="place")
    ranked = ranked.select(*cols, F.when(F.col("place") <= k, F.col("place")).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~F.coalesce(wins, F.lit(False))).select(*cols, F.lit(None).cast("long").alias("rank")))
