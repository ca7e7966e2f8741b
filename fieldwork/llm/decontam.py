"""Benchmark decontamination: size-partitioned MinHash containment search.

Which documents contain at least ``num/den`` of the distinct word shingles of a test item, wherever in the document it stands?

1. Items are partitioned by their number of words: an item of ``k`` words or more has shingles of ``k`` words, a shorter one its whole
   sequence as one shingle of that width, so each width is searched on its own.
2. An item's sketch is its ``n - ceil(num n / den) + 1`` smallest shingle hashes (a bottom-k MinHash whose size
   follows the item's).  A document that holds ``num/den`` of the item holds one of them, whatever its own length.
3. One pass over the documents tests all shingles against a bit table of the sketches (bounded size; a false hit only costs a
   row).  Documents without a hit emit nothing; the others emit their hits in a second bit table of all item shingles.
4. Hits join the items' shingles by hash (a shuffle, no broadcast of the items); counting distinct shared
   shingles per (document, item) is the exact verification.

Defined results: null or empty texts and items without words match nothing.  Repeated rows of a document or item are
one document or item (an id with several texts holds the shingles of all of them).
Empty tables: no rows.  Null ids match nothing.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwork.llm.common import ids_and_text, longs, on_workers, own_runs, run_hashes, text_words, written

K, NUM, DEN = 5, 8, 10
MAX_BITS = 26   # of a bit table: 8 MB at most; beyond that false hits grow, results stay exact


def _widths(n_words: np.ndarray, k: int) -> np.ndarray:
    return np.minimum(n_words, k)


def item_shingles(items: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """``(item_id, width, hash, n, sketch)``: all distinct shingles of each item, those of its sketch marked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[list] = [[], [], []]
            for i, j, words, first, _ in text_words(batch.column(1), True):
                for r in range(i, j):
                    w = words[first[r - i]:first[r - i + 1]]
                    if not len(w) or ids[r] is None:
                        continue
                    width = min(len(w), k)
                    s = np.unique(run_hashes(w, width) + np.uint64(width))
                    out[0] += [ids[r]] * len(s)
                    out[1] += [width] * len(s)
                    out[2].append(longs(s))
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(np.concatenate(out[2]))],
                    names=["item_id", "width", "hash"])

    rows = items.mapInArrow(run, "item_id long, width int, hash long").distinct()
    sizes = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"),
                                        F.array_sort(F.collect_list("hash")).alias("all"))  # bounded by one item
    need = F.col("n") - F.ceil(F.col("n") * num / F.lit(float(den))) + 1
    sizes = sizes.select("item_id", "n", F.element_at("all", need.cast("int")).alias("edge"))
    return rows.join(sizes, "item_id").select("item_id", "width", "hash", "n", (F.col("hash") <= F.col("edge")).alias("sketch"))


def _bit_table(marks: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits set at the top bits of the hashes: set per byte group on the executors, at most 8 MB here."""
    cell = F.shiftrightunsigned(F.col("hash"), 64 - bits)
    rows = (marks.select((F.shiftright(cell, 15)).alias("page"), cell.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
            .groupBy("page").agg(F.collect_set("bit").alias("bits")).toLocalIterator())
    table = np.zeros(1 << bits, bool)
    for r in rows:
        table[(r["page"] << 15) + np.array(r["bits"], np.int64)] = True
    return np.packbits(table)


def contaminated(docs: DataFrame, items: DataFrame, k: int = K, num: int = NUM, den: int = DEN,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` for every document and item with containment >= num/den."""
    spark = docs.sparkSession
    on_workers(spark)
    items = items.select(items[item_col].cast("long").alias("item_id"), items[item_text_col].cast("string").alias("text"))
    grams = written(item_shingles(items, k, num, den), "item-shingles")
    shape = grams.agg(F.count(F.lit(1)).alias("n"), F.collect_set("width").alias("widths")).first()
    bits = int(min(MAX_BITS, max(17, int(shape["n"] * 64).bit_length())))
    widths = sorted(shape["widths"])
    tables = spark.sparkContext.broadcast((_bit_table(grams.where("sketch"), bits), _bit_table(grams, bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, every = (np.unpackbits(t).view(bool) for t in tables.value)
        for batch in batches:
            ids = batch.column(0)
            for i, j, words, first, _ in text_words(batch.column(1), True):
                row, found = [], []
                for width in widths:
                    runs = run_hashes(words, width) + np.uint64(width)
                    cell = longs(runs >> np.uint64(64 - bits))
                    ok = own_runs(first, len(words), width) if len(words) >= width else np.zeros(0, bool)
                    hit = np.flatnonzero(every[cell] & ok)
                    of = np.searchsorted(first, hit, side="right") - 1
                    near = np.zeros(len(first), bool)
                    near[of[sketch[cell[hit]]]] = True
                    hit, of = hit[near[of]], of[near[of]]
                    row.append(of)
                    found.append(runs[hit])
                row, found = np.concatenate(row + [np.zeros(0, np.int64)]), np.concatenate(found + [np.zeros(0, np.uint64)])
                if len(row):
                    yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(row)), pa.array(longs(found))],
                                                     names=["doc_id", "hash"])

    hits = ids_and_text(docs, id_col, text_col).where("doc_id is not null").mapInArrow(run, "doc_id long, hash long").distinct()
    return (hits.join(grams, "hash").groupBy("doc_id", "item_id")
            .agg(F.count(F.lit(1)).alias("n_shared"), F.first("n").alias("n_item"), F.max("sketch").alias("near"))
            .where(F.col("near") & (F.col("n_shared") * den >= F.col("n_item") * num))
            .select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents (all columns) that contain no item.

    Rows are judged by id and text: a null id is judged like any other, and different texts under one id are judged one by one."""
    rows = docs.select(F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string")).alias("key"),
                       docs[text_col].cast("string").alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    bad = contaminated(rows.select("key", "text"), items, id_col="key", **how).select(F.col("doc_id").alias("key")).distinct()
    return rows.join(bad, "key", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
