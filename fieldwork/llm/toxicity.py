"""Toxicity by a classifier chain.

Linear models predict the categories one after the other; each later model also sees the earlier categories'
probabilities.  In training those are out-of-fold predictions, so that a later model meets the errors it will meet on
new documents.  Categories are derived from the label table, in chain order: ``unsafe`` (toxic or of low
quality), ``toxic``, ``toxic_prose`` (toxic and not of low quality).

Features: hashes of the words' beginnings (4 to 10 bytes) and of whole words, A-Z lower-cased, that differ
most between the classes by the G test; each gives two values: its presence and the logarithm of its rate per word.
Training uses at most ``MAX_ROWS`` labelled rows (those whose hashed doc_id is smallest), gathered as sparse rows of
at most ``2 * MAX_FEATURES`` values in one task, so its size is bounded whatever the input; scoring runs
over all rows and whole texts with the model (some hundred KB) in every task.

The threshold is the one with the best F1 of ``toxic`` on out-of-fold predictions.

Defined results: null or empty texts have no features and get the base rate.  Null or contradictory labels of a
document: nulls are left out, the largest value counts.  Without labelled rows of both kinds every
probability is 0 and nothing is rejected.  Repeated rows are scored alike.  Other columns pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwork.llm.common import _BYTE, _LOWER, _R, list_array, longs, mix, on_workers, powers, text_slices, word_spans, written

CHAIN = ("unsafe", "toxic", "toxic_prose")
MAX_ROWS = 16_000
MAX_FEATURES = 768
FOLDS = 5
HEADS = (4, 5, 6, 7, 8, 10)
MIN_SUPPORT = 5
MIN_G = 25.0


def token_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(word, hash)`` arrays for each kind of feature of the words given."""
    if not len(starts):
        return
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    vals = _BYTE[_LOWER][data[pos + np.repeat(starts, lens)]] * powers(int(_R), int(lens.max()))[pos]
    total = np.zeros(len(vals) + 1, np.uint64)
    np.cumsum(vals, out=total[1:])
    for h in HEADS:
        sel = np.flatnonzero(lens > h)
        yield sel, mix(total[first[sel] + h] - total[first[sel]] + np.uint64(h << 32))
    yield np.arange(len(starts)), mix(total[first + lens] - total[first] + np.uint64(1 << 62))


def _doc_features(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first_row, end_row, words per row, row of each feature, feature)`` for slices of a column."""
    for i, j, data, offs in text_slices(col):
        starts, ends, first = word_spans(data, offs)
        of = np.repeat(np.arange(j - i), np.diff(first))
        rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for sel, h in token_features(data, starts, ends):
            rows.append(of[sel])
            hashes.append(h)
        yield i, j, np.diff(first), np.concatenate(rows), np.concatenate(hashes)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``(doc_id, text, y, fold)`` of ``max_rows`` labelled rows at most: those with the smallest hashed ids, texts in order of their hash."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    y = labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(
        F.max(labels["toxic"].cast("int")).alias("toxic"), F.min(labels["quality"].cast("int")).alias("quality"))
    y = y.where("doc_id is not null and toxic is not null").join(own.distinct(), "doc_id", "left_semi")
    low = F.coalesce(F.col("quality") == 0, F.lit(False))
    tox = F.col("toxic") > 0
    y = y.select("doc_id", F.xxhash64("doc_id").alias("h"),
                 F.array(*[c.cast("int") for c in (tox | low, tox, tox & ~low)]).alias("y"))
    picked = written(y.orderBy("h", "doc_id").limit(max_rows).select("doc_id", "h", "y", F.pmod(F.shiftright("h", 7), F.lit(FOLDS)).cast("int").alias("fold")), "toxic-rows")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id")  # at most max_rows ids
    # an id may have any number of rows: the limit is on rows
    return written(rows.orderBy("h", "doc_id", F.xxhash64("text")).limit(max_rows).select("doc_id", "text", "y", "fold"), "toxic-sample")


def select_features(sample: DataFrame, max_features: int) -> np.ndarray:
    """Sorted hashes of the features that separate the categories best (G test, one per category, the largest counts)."""
    n_cat = len(CHAIN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), np.int64).reshape(-1, n_cat)
            for i, j, _, row, feat in _doc_features(batch.column(0)):
                order = np.lexsort((row, feat))
                f, r = feat[order], row[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1])
                f, r = f[new], r[new]
                head = np.flatnonzero(np.diff(longs(f), prepend=longs(~f[:1])) != 0)
                if len(head):
                    sums = np.add.reduceat(np.column_stack([np.ones(len(r), np.int64), y[i:j][r]]), head, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(longs(f[head])), *[pa.array(np.ascontiguousarray(c)) for c in sums.T]],
                                                     names=["feature", "n", *[f"n{c}" for c in range(n_cat)]])

    rows = sample.select("text", "y").mapInArrow(count, "feature long, n long, " + ", ".join(f"n{c} long" for c in range(n_cat)))
    by = rows.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(f"n{c}").alias(f"n{c}") for c in range(n_cat)]) \
        .where(F.col("n") >= MIN_SUPPORT)
    size = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("y")[c]).alias(f"n{c}") for c in range(n_cat)]).first()
    if not size["n"]:
        return np.zeros(0, np.uint64)

    def g(c: int):
        def term(o, e):
            return F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
        n, k1, a, b = float(size["n"]), float(size[f"n{c}"] or 0), F.col(f"n{c}"), F.col("n")
        k0 = n - k1
        return 2 * (term(a, b * k1 / n) + term(b - a, b * k0 / n) + term(F.lit(k1) - a, (n - b) * k1 / n)
                    + term(F.lit(k0) - b + a, (n - b) * k0 / n))

    best = by.select("feature", F.greatest(*[g(c) for c in range(n_cat)]).alias("g")).where(F.col("g") >= MIN_G) \
        .orderBy(F.desc("g"), "feature").limit(max_features).collect()
    return np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))


def feature_rows(col: pa.Array, features: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first_row, end_row, row, input, value)``: the model's inputs of each row, by row."""
    seen = np.zeros(1 << 20, bool)
    seen[longs(features >> np.uint64(44))] = True
    for i, j, n_words, row, feat in _doc_features(col):
        near = seen[longs(feat >> np.uint64(44))]
        row, feat = row[near], feat[near]
        at = np.minimum(np.searchsorted(features, feat), max(len(features) - 1, 0))
        hit = features[at] == feat if len(features) else np.zeros(0, bool)
        key, count = np.unique(row[hit] * (len(features) + 1) + at[hit], return_counts=True)
        row, at = np.divmod(key, len(features) + 1)
        rate = np.log1p(100.0 * count / n_words[row])
        row, at = np.concatenate([row, row]), np.concatenate([2 * at, 2 * at + 1])  # presence and rate
        value = np.concatenate([np.ones(len(rate)), rate])
        order = np.argsort(row, kind="stable")
        yield i, j, row[order], at[order], value[order]


def _fit(x: np.ndarray, y: np.ndarray, use: np.ndarray, l2: float = 3.0, steps: int = 120) -> np.ndarray:
    """L2-regularised logistic regression by accelerated gradient descent; the last weight is the bias.
    ``use`` is 1 for the rows to fit on and 0 for the others, so that no part of ``x`` is copied."""
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):  # largest eigenvalue of x'x
        v = x.T @ ((x @ v) * use)
        top = float(np.linalg.norm(v))
        v /= top or 1.0
    n = float(use.sum())
    step = 1.0 / ((top + n) / 4 + l2)  # the bias column adds its length at most
    rate = float((y * use).sum()) / n
    w, old = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32)
    w[-1] = old[-1] = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    grad = np.empty_like(w)
    for t in range(steps):
        z = w + (w - old) * np.float32(t / (t + 3))
        miss = (_prob(x, z) - y) * use
        grad[:-1] = x.T @ miss + np.float32(l2) * z[:-1]
        grad[-1] = miss.sum()
        old, w = w, z - np.float32(step) * grad
    return w


def _prob(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> dict:
    """Weights of each link and the rejecting threshold of ``toxic``.  ``x`` has a spare last column for each category,
    which takes that category's out-of-fold probabilities."""
    weights, threshold, base = [], 2.0, x.shape[1] - y.shape[1]
    for c in range(y.shape[1]):
        xc, yc = x[:, :base + c], y[:, c].astype(np.float32)
        if yc.min() == yc.max():
            w = np.zeros(xc.shape[1] + 1, np.float32)
            w[-1] = 30.0 if yc.max() else -30.0
            oof = np.full(len(x), float(yc.max()), np.float32)
        else:
            oof = np.zeros(len(x), np.float32)
            for f in np.unique(fold):
                out = fold == f
                oof[out] = _prob(xc, _fit(xc, yc, (~out).astype(np.float32)))[out] if 0 < yc[~out].sum() < (~out).sum() else yc.mean()
            w = _fit(xc, yc, np.ones(len(x), np.float32))
            if CHAIN[c] == "toxic":
                order = np.argsort(-oof, kind="stable")
                hits = np.cumsum(yc[order])
                f1 = 2 * hits / (np.arange(1, len(x) + 1) + yc.sum())
                k = int(np.argmax(f1))
                low = oof[order[k]]
                nxt = oof[order[k + 1]] if k + 1 < len(x) else 0.0
                threshold = float((low + nxt) / 2)
        weights.append(w)
        x[:, base + c] = oof
    return {"weights": weights, "threshold": threshold}


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> dict:
    """The fitted chain: features, weights, threshold."""
    on_workers(docs.sparkSession)
    sample = labelled_sample(docs, labels, max_rows)
    features = select_features(sample, max_features)
    empty = {"features": features, "weights": [], "threshold": 2.0}
    if not len(features):
        return empty

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, at, value in feature_rows(batch.column(1), features):
                cut = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(at.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(value.astype(np.float32)))],
                    names=["doc_id", "y", "fold", "at", "value"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if tables:
            t = pa.Table.from_batches(tables).sort_by("doc_id")
            x = np.zeros((t.num_rows, 2 * len(features) + len(CHAIN)), np.float32)
            y, fold = np.array(t.column("y").to_pylist()), t.column("fold").to_numpy()
            for a in range(0, t.num_rows, 1000):
                at, value = (t.column(c).slice(a, 1000).combine_chunks() for c in ("at", "value"))
                row = np.repeat(np.arange(a, a + len(at)), at.value_lengths().to_numpy())
                x[row, at.flatten().to_numpy()] = value.flatten().to_numpy()
            del t, at, value, row, tables
            model = fit_chain(x, y, fold)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = sample.select("doc_id", "text", "y", "fold").mapInArrow(
        sparse, "doc_id long, y array<int>, fold int, at array<int>, value array<float>")
    got = rows.coalesce(1).mapInArrow(fit, "model binary").collect()  # at most max_rows sparse rows
    return empty | pickle.loads(got[0]["model"]) if got else empty


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``(p array<double>, rejected boolean, doc struct)``: chain probabilities of every row, all its columns passing through.

    Only the text goes to Python, and the verdict comes back; the rows stay where they are."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        features, weights = m["features"], m["weights"]
        nf = 2 * len(features)
        for text in texts:
            found = [np.zeros((0, len(CHAIN)))]
            for i, j, row, at, value in feature_rows(text, features):
                probs: list[np.ndarray] = []
                for w in weights:
                    z = np.bincount(row, value * w[:nf][at], minlength=j - i) + w[-1]
                    for p, extra in zip(probs, w[nf:-1]):
                        z = z + p * extra
                    probs.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                found.append(np.column_stack(probs) if probs else np.zeros((j - i, len(CHAIN))))
            p = np.concatenate(found)
            yield pa.StructArray.from_arrays([list_array(list(p), pa.float64()), pa.array(p[:, CHAIN.index("toxic")] >= m["threshold"])],
                                             names=["p", "rejected"])

    verdict = F.arrow_udf(run, "struct<p: array<double>, rejected: boolean>", F.ArrowUDFType.SCALAR_ITER)
    judged = docs.select(verdict(docs[text_col].cast("string")).alias("verdict"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    return judged.select("verdict.p", "verdict.rejected", "doc")


def clean_of_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the chain does not reject, with their columns."""
    return score(docs, train(docs, labels, **how)).where("not rejected").select("doc.*")
