"""Language-model scoring by cross-entropy difference.

Two bigram models of the same form, one of the target texts and one of all documents (the background), share one
vocabulary: every word of the background (lower-cased A-Z), the end mark, and one unknown word for what only the target holds.
p(w | v) = L c(v w) / c(v) + (1 - L) (c(w) + 1) / (N + V), with texts framed by a start and an end mark.
A document's score is its loss per token under the target model less that under the background model: the lower, the more it
is like the target.

Target texts are given as a table, or as the ids of the documents that are targets; then ids travel instead of texts.

1. Documents are written in batches of about ``BATCH_BYTES``.  Words are counted in both corpora (one shuffle); of these counts only
   the totals N and V leave the cluster.
2. Every batch sends its distinct words and bigrams (64-bit keys, sorted), with counts, to the partition of each key; target texts
   do too.  Both tables grow with the input and are never gathered: each partition adds up the counts of its own keys in both
   corpora and answers every batch with the counts of the keys that it sent.
3. Each batch meets its answers and adds up the losses of its documents.

A batch sends a key once, so a frequent key has at most one entry a batch.  The number of partitions follows the number of tokens
(``PART_KEYS`` entries a partition at most, on average), so no partition grows with the input.
Defined results: null or empty text: one token (the end mark).  Without target texts the target model is uniform over the
vocabulary.  Repeated rows are scored alike and count as often as they occur.  Other columns are not read.  With ``size`` the
vocabulary is the ``size`` most frequent background words (ties by hash), all others being the unknown word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.llm.common import _ROLL, ids_and_text, longs, mix, on_workers, text_slices, text_words, word_spans, written

WEIGHT = 0.7
BATCH_BYTES = 8 << 20
PART_KEYS = 4_000_000
UNKNOWN, START, END = mix(np.arange(1, 4, dtype=np.uint64))
_BATCHES = "batch long, n_docs long, ids binary, nulls binary, sizes binary, offsets binary, data binary"
_KEYS = "part int, batch long, keys binary, b binary, t binary"


def _shrunk(x: np.ndarray) -> bytes:
    """Eight-byte numbers as compressed byte planes, behind how many they are."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()
    return np.int64(len(x)).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _full(raw: bytes, kind: type = np.int64) -> np.ndarray:
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view(kind)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their ids, many documents a row; the last column is the text, a column before it the id."""
    no = 0
    for batch in batches:
        ids = batch.column(0) if batch.num_columns > 1 else pa.nulls(batch.num_rows, pa.int64())
        for a, b, data, offs in text_slices(batch.column(batch.num_columns - 1), BATCH_BYTES):
            own = ids.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 32) + no], pa.int64()), pa.array([b - a], pa.int64()),
                 *[pa.array([x], pa.binary()) for x in (
                     _shrunk(own.fill_null(0).to_numpy(zero_copy_only=False)), _shrunk(own.is_null().to_numpy(zero_copy_only=False).astype(np.int64)),
                     _shrunk(np.diff(word_spans(data, offs)[2])), _shrunk(np.ascontiguousarray(offs)), np.int64(len(data)).tobytes() + pa.compress(data.tobytes(), codec="zstd", asbytes=True))]],
                names=["batch", "n_docs", "ids", "nulls", "sizes", "offsets", "data"])
            no += 1


def _texts(offsets: bytes, data: bytes) -> pa.Array:
    offs = _full(offsets)
    raw = pa.decompress(data[8:], int(np.frombuffer(data[:8], np.int64)[0]), codec="zstd")
    return pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(raw)])


def word_counts(batches: DataFrame) -> DataFrame:
    """``(word, n)``: occurrences of each word hash in a table of batches."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for offs, data in zip(batch.column(0), batch.column(1)):
                parts = [w for _, _, w, _, _ in text_words(_texts(offs.as_py(), data.as_py()), True)]
                word, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(longs(word)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return batches.select("offsets", "data").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keys(texts: pa.Array, vocab: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """The sorted distinct keys of a batch's words and bigrams, with counts; then of each token its row and which of the keys are
    its bigram, its word and the word before it."""
    rows, prevs, curs = [], [], []
    for i, _, words, first, _ in text_words(texts, True):
        if vocab is not None:
            words = np.where(np.isin(words, vocab), words, UNKNOWN)
        n = len(first) - 1
        row = np.repeat(np.arange(n), np.diff(first) + 1)
        cur = np.full(len(row), END, np.uint64)
        inner = np.ones(len(row), bool)
        inner[first[1:] + np.arange(n)] = False  # place of each end mark
        cur[inner] = words
        prev = np.empty(len(row), np.uint64)
        prev[1:] = cur[:-1]
        prev[first[:-1] + np.arange(n)] = START
        rows.append(row + i)
        prevs.append(prev)
        curs.append(cur)
    row, prev, cur = (np.concatenate(x) for x in (rows, prevs, curs))
    keys, at, counts = np.unique(np.concatenate([mix(prev * np.uint64(_ROLL) + cur), cur, np.full(len(texts), START, np.uint64)]),
                                 return_inverse=True, return_counts=True)
    pair, word = at[:len(row)], at[len(row):2 * len(row)]
    before = np.empty(len(row), np.int64)
    before[1:] = word[:-1]
    before[np.flatnonzero(np.diff(row, prepend=-1))] = at[-1]
    return keys, counts.astype(np.int64), row, pair, word, before


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(_full(x.as_py()).sum()) for x in batch.column(0)], pa.int64()), batch.column(1)],
                                         names=["n_words", "n_docs"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, batch, at, n_words)`` of every document with an id."""
    for batch in batches:
        for no, ids, nulls, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            at = np.flatnonzero(_full(nulls) == 0)
            yield pa.RecordBatch.from_arrays([pa.array(_full(ids)[at]), pa.array(np.full(len(at), no, np.int64)), pa.array(at), pa.array(_full(sizes)[at])],
                                             names=["doc_id", "batch", "at", "n_words"])


def part_count(spark: SparkSession, tokens: int) -> int:
    """How many parts the keys of ``tokens`` tokens (two keys each at most) are dealt to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * tokens // PART_KEYS))


def _messages(batch: int | None, texts: pa.Array, vocab: np.ndarray | None, parts: int, target: np.ndarray | None) -> pa.Table:
    """A batch's keys with their counts in both corpora, one row a part; ``target``: which of its texts are targets."""
    keys, counts, row, pair, word, _ = _keys(texts, vocab)
    own = None
    if target is not None:
        flag = np.zeros(len(texts), bool)
        flag[target] = True
        sel = flag[row]
        own = np.bincount(np.concatenate([pair[sel], word[sel]]), minlength=len(keys))
        own[np.searchsorted(keys, START)] += len(target)
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(longs(part), prepend=-1))
    spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]))
    b, t = (counts, own) if batch is not None else (None, counts)
    return pa.table([pa.array(part[cuts].astype(np.int32)), pa.array([batch] * len(cuts), pa.int64()),
                     pa.array([_shrunk(np.diff(keys[x:y], prepend=np.uint64(0))) for x, y in spans], pa.binary()),
                     *[pa.array([None if n is None else _shrunk(n[x:y]) for x, y in spans], pa.binary()) for n in (b, t)]],
                    names=["part", "batch", "keys", "b", "t"])


def _answers(table: pa.Table) -> pa.Table:
    """The counts in both corpora of all keys of a part, to each batch for the keys that it sent."""
    rows = table.to_pylist()
    keys = [np.cumsum(_full(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    at = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
    total = {k: np.zeros(len(every), np.int64) for k in "tb"}
    for r, where in zip(rows, at):
        for k in "tb":
            if r[k] is not None:
                total[k][where] += _full(r[k])  # a batch holds a key once
    held = [(r, where) for r, where in zip(rows, at) if r["batch"] is not None]
    return pa.table([pa.array([r["batch"] for r, _ in held], pa.int64()), pa.array([r["part"] for r, _ in held], pa.int32()),
                     *[pa.array([_shrunk(total[k][w]) for _, w in held], pa.binary()) for k in "tb"]], names=["batch", "part", "t", "b"])


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None,
          weight: float = WEIGHT) -> DataFrame:
    """``(doc_id, n_tokens, ce_target, ce_background, ce_difference)`` of every row of ``docs``.

    ``target`` has the target texts in the same text column, or, without that column, the ids of the rows of ``docs`` that are targets."""
    spark = docs.sparkSession
    on_workers(spark)
    docs = written(ids_and_text(docs, id_col, text_col).mapInArrow(_batches, _BATCHES), "documents-batches")
    seen = word_counts(docs)
    words, distinct = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    vocab = None if size is None else seen.orderBy(F.desc("n"), "word").limit(size).toArrow().column("word").to_numpy().view(np.uint64)
    kinds = 2 + (distinct if vocab is None else len(vocab))
    texts = flags = None
    if text_col in target.columns:
        texts = written(target.select(target[text_col].cast("string").alias("text")).mapInArrow(_batches, _BATCHES), "target-batches")
        own = texts.select("sizes", "n_docs").mapInArrow(_sums, "n_words long, n_docs long")
    else:
        ids = target.select(target[id_col].cast("long").alias("doc_id"))
        rows = docs.select("batch", "ids", "nulls", "sizes").mapInArrow(_rows, "doc_id long, batch long, at long, n_words long")
        flags = written(rows.join(ids, "doc_id", "left_semi").groupBy("batch").agg(
            F.sort_array(F.collect_list("at")).alias("at"), F.sum("n_words").alias("n_words"), F.count("*").alias("n_docs")), "target-rows")
        own = flags
    n_target = sum(own.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_docs")]).first())
    n_background = words + docs.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    parts = part_count(spark, n_background + n_target)

    def send(with_batch: bool):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for no, offs, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    yield from _messages(no if with_batch else None, _texts(offs.as_py(), data.as_py()), vocab, parts, None).to_batches()
        return run

    def send_marked(own: pa.Table, marks: pa.Table) -> pa.Table:
        own = own.to_pylist()[0]
        at = np.array(marks.column("at")[0].as_py() if marks.num_rows else [], np.int64)
        return _messages(own["batch"], _texts(own["offsets"], own["data"]), vocab, parts, at)

    def judge(own: pa.Table, answers: pa.Table) -> pa.Table:
        own = own.to_pylist()[0]
        keys, _, row, pair, word, before = _keys(_texts(own["offsets"], own["data"]), vocab)
        ids, null = _full(own["ids"]), _full(own["nulls"]).astype(bool)
        got = sorted(answers.to_pylist(), key=lambda r: r["part"])
        tokens = np.bincount(row, minlength=len(ids))
        ce = {}
        for k, n_words in (("t", n_target), ("b", n_background)):
            n = np.concatenate([_full(r[k]) for r in got])
            if len(n) != len(keys):
                raise RuntimeError(f"{len(n)} answers for {len(keys)} keys")
            p = weight * n[pair] / np.maximum(n[before], 1) + (1 - weight) * (n[word] + 1) / (n_words + kinds)
            ce[k] = np.bincount(row, -np.log(p), minlength=len(ids)) / tokens
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null), "n_tokens": pa.array(tokens), "ce_target": pa.array(ce["t"]),
                         "ce_background": pa.array(ce["b"]), "ce_difference": pa.array(ce["t"] - ce["b"])})

    by_batch = docs.groupBy("batch")
    if flags is not None:
        wire = by_batch.cogroup(flags.select("batch", "at").groupBy("batch")).applyInArrow(send_marked, _KEYS)
    else:
        wire = docs.select("batch", "offsets", "data").mapInArrow(send(True), _KEYS).unionByName(
            texts.select("batch", "offsets", "data").mapInArrow(send(False), _KEYS))
    answers = wire.groupBy("part").applyInArrow(_answers, "batch long, part int, t binary, b binary")
    return by_batch.cogroup(answers.groupBy("batch")).applyInArrow(
        judge, "doc_id long, n_tokens long, ce_target double, ce_background double, ce_difference double")
