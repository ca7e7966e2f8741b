"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text (followed by two blanks) are hashed to ``BUCKETS`` columns; a value is the
n-gram's share of the text times its inverse document frequency.  Document frequencies are counted over all training
texts.  The weights are trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on
at most ``ROWS_PER_LANG`` different rows of each language and ``MAX_ROWS`` in all (those whose hashes are smallest; sparse rows
of bounded size, gathered in one task); the ``MAX_LANGS`` most frequent languages are learned; a part of them is held back to fit one softmax temperature.
Predicting reads whole texts; the model (BUCKETS x languages) is in every task.

Defined results: null text or text without any letter: ``und`` with score 0.  No training rows: ``und`` with score 0
for all.  Null languages are not learned from.  Repeated rows are predicted alike.  Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwork.llm.common import on_workers, written

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ROWS_PER_LANG = 2_000
MAX_ROWS = 40_000        # of all languages together
MAX_LANGS = 200
CALIBRATION = 5          # one in five of the sampled rows fits the temperature
SCALE = 20.0             # of the TF-IDF values
SLICE_CHARS = 1 << 18
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams (3 rows: one per n, a column per character) and each text's first character (n + 1 entries)."""
    low = [t.lower() for t in texts]
    first = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) + 2 for t in low], out=first[1:])
    c = np.frombuffer("".join(t + "  " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((3, len(c)), np.uint32)
    h = c * _A
    out[0] = h
    h[:-1] += c[1:] * _B
    out[1] = h ^ (h >> np.uint32(15))
    h[:-2] += c[2:] * _C
    out[2] = (h ^ (h >> np.uint32(13))) * _A
    out[0] *= _B
    out[1] *= _C
    return (out >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), first


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    a, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > a and (total + n > SLICE_CHARS or i - a >= 256):
            yield a, i, [x or "" for x in texts[a:i]]
            a, total = i, 0
        total += n
    if a < len(texts):
        yield a, len(texts), [x or "" for x in texts[a:]]


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training texts each bucket occurs, and how many texts there are (256 KB to the driver)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, _, texts in _slices(batch.column(0).to_pylist()):
                grams, first = gram_buckets(texts)
                seen = np.zeros((len(texts), BUCKETS), bool)
                row = np.repeat(np.arange(len(texts)), np.diff(first))
                real = np.ones(len(row), bool)
                real[first[1:] - 1] = real[first[1:] - 2] = False
                for g in grams:
                    seen[row[real], g[real]] = True
                total += np.count_nonzero(seen, axis=0)
                n += len(texts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "df"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("df").to_pylist())
        return pa.table({"n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "df": pa.array([total.tobytes()], pa.binary())})

    # tables of fixed size are added in two steps, so that no task gets more than a few hundred of them
    parts = train.select("text").mapInArrow(run, "n long, df binary").withColumn("k", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.groupBy("k").applyInArrow(add, "n long, df binary")
    rows = some.collect()
    return sum((np.frombuffer(r["df"], np.int64) for r in rows), np.zeros(BUCKETS, np.int64)), sum(r["n"] for r in rows)


def _sampled(train: DataFrame, rows_per_lang: int) -> DataFrame:
    """``(lang, text, h)`` of the sampled training rows: at most ``rows_per_lang`` of a language, ``MAX_ROWS`` in all.

    Languages are counted first; a row then takes part by its hash, at a rate that leaves some more than are wanted, so that a
    language of any size sends no more than these to its task."""
    rows = train.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(3)).alias("h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    most = max(1, min(rows_per_lang, MAX_ROWS // max(1, len(counts))))
    rate = [(r["lang"], min(1 << 30, int((2 * most + 100) / r["n"] * (1 << 30)) + 1)) for r in counts]
    rates = train.sparkSession.createDataFrame(rate, "lang string, rate long")
    some = rows.join(F.broadcast(rates), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("rate"))  # MAX_LANGS rows at most
    some = some.groupBy("lang", "h").agg(F.min("text").alias("text"))  # repeated rows count once, and are reduced before the shuffle
    w = Window.partitionBy("lang").orderBy("h")
    return written(some.withColumn("no", F.row_number().over(w)).where(F.col("no") <= most).select("lang", "text", "h"), "lang-rows")


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_class: int, epochs: int = 3, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Multinomial FTRL-proximal with elastic net; rows are (columns, values).  Returns (BUCKETS + 1, n_class); the last row is the bias."""
    z, n = np.zeros((BUCKETS + 1, n_class)), np.zeros((BUCKETS + 1, n_class))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) > l1, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    order = np.arange(len(rows))
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(epochs):
        rng.shuffle(order)
        for r in order:
            at, x = rows[r]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[r]] -= 1
            g = x[:, None] * p[None, :]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    return weights(np.arange(BUCKETS + 1))


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The softmax temperature with the least log loss (golden search on its logarithm)."""
    if not len(y):
        return 1.0

    def loss(t):
        s = scores / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    a, b, g = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> dict:
    """Fit on ``(doc_id, text, lang)``: ``{langs, table, bias, temperature}``; the table holds weight times IDF."""
    on_workers(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    df, n_docs = document_frequencies(rows)
    idf = np.log((1 + n_docs) / (1 + df)) + 1.0

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b, part in _slices(texts):
                grams, first = gram_buckets(part)
                at, value = [], []
                for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
                    k, c = np.unique(grams[:, s:e - 2], return_counts=True)
                    at.append(k)
                    value.append((c / max(1, 3 * (e - 2 - s)) * idf[k] * SCALE).astype(np.float32))
                offs = np.concatenate([[0], np.cumsum([len(k) for k in at])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(at).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(value)))], names=["lang", "h", "at", "value"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables).sort_by([("h", "ascending"), ("lang", "ascending")])
        names = t.column("lang").to_pylist()
        langs = sorted(set(names))
        y = np.array([langs.index(x) for x in names])
        rows = [(np.append(a.values.to_numpy(), BUCKETS), np.append(v.values.to_numpy().astype(np.float64), 1.0))
                for a, v in zip(t.column("at"), t.column("value"))]
        held = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
        fit_on = [r for r, h in zip(rows, held) if not h]
        w = ftrl(fit_on, y[~held], len(langs))
        scores = np.array([x @ w[at] for (at, x), h in zip(rows, held) if h]).reshape(-1, len(langs))
        model = {"langs": langs, "w": w, "temperature": temperature(scores, y[held])}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    feats = _sampled(rows, rows_per_lang).select("lang", "text", "h").mapInArrow(sparse, "lang string, h long, at array<int>, value array<float>")
    got = feats.coalesce(1).mapInArrow(fit, "model binary").collect()  # at most MAX_ROWS sparse rows
    if not got:
        return {"langs": [], "table": np.zeros((BUCKETS, 0), np.float32), "bias": np.zeros(0), "temperature": 1.0}
    m = pickle.loads(got[0]["model"])
    return {"langs": m["langs"], "table": (m["w"][:-1] * idf[:, None] * SCALE).astype(np.float32), "bias": m["w"][-1],
            "temperature": m["temperature"]}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table, bias = np.ascontiguousarray(m["table"]), m["bias"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b, part in _slices(texts):
                langs, scores = ["und"] * (b - a), np.zeros(b - a)
                if m["langs"]:
                    grams, first = gram_buckets(part)
                    sizes = np.diff(first) - 2
                    each = table[grams[0]] + table[grams[1]] + table[grams[2]]
                    each[first[1:] - 1] = each[first[1:] - 2] = 0
                    s = np.add.reduceat(each, first[:-1], axis=0, dtype=np.float64) / np.maximum(3 * sizes, 1)[:, None]
                    s = (s + bias) / m["temperature"]
                    p = np.exp(s - s.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    for r, t in enumerate(part):
                        if any(map(str.isalpha, t)):
                            langs[r], scores[r] = m["langs"][best[r]], float(p[r, best[r]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores)],
                                                 names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")
