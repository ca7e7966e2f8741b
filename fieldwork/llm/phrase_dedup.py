"""Substring dedup with repeated-phrase automata.

A word is removed when it is covered by a window of ``window`` consecutive words whose word sequence
also starts in a document with a smaller doc_id, judged on the input.  The result is exact:

1. ``phrase_index``: every window names one phrase of ``phrase`` words inside it, the one with the smallest hash
   (leftmost on ties), so equal windows name equal phrases at equal places.
2. ``recurring_phrases``: of documents with equal word sequences only the smallest takes part further on (the others lose
   all their windows to it); phrases that occur in two of the remaining documents are confirmed as recurring, and ``phrase_texts``
   fetches the words of each from one document that holds it.
3. ``passages``: all documents that hold recurring phrases are streamed through Aho-Corasick automata (pyahocorasick).  A shard is a
   bounded number of bytes of documents; its automaton is compiled from the texts of the phrases that recur in any of them, so
   all shards together cost one pass over the text.  The places that the automaton finds are the occurrences; a passage is all
   consecutive windows that name one of them.
4. ``repeats``: passages are dealt out by phrase, in doc_id order, as hashes of their windows; a window seen before in a smaller document is a
   repeat.  Between batches a task keeps only the windows of the phrase it is in.  The windows of a phrase of more than ``HOT`` documents
   are rows of their own: the smallest document of each window is a pre-aggregated minimum, and the rest are marked by a join over ``SALTS`` parts of each window.
5. ``remove_repeats`` cuts the covered words out of each text.

Defined results: null text: no words, nothing removed, kept text empty (null stays null where the
text is untouched).  Repeated rows of one doc_id never remove from each other: only a
smaller doc_id does.  A null doc_id is neither smaller nor larger than any other: the
row is kept whole and removes nothing.  Texts below ``window`` words are kept whole.  Empty table: no rows.
All other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwork.llm.common import list_array, longs, mix, on_workers, own_runs, run_hashes, text_words, written
from fieldwork.llm.decontam import _bit_table

WINDOW = 50
PHRASE = 16
HOT = 2_000  # documents; a phrase of more is dealt out by window instead of by phrase
SALTS = 64   # parts of a window of such a phrase; there are over HOT rows to each of its distinct windows
MAX_BITS = 26  # of the table of recurring phrases that tasks look into: 8 MB
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


def named_phrases(words: np.ndarray, first: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside one text: its start, the start of the phrase it names, and that phrase's hash."""
    z = np.zeros(0, np.int64)
    if len(words) < window:
        return z, z, z.view(np.uint64)
    grams = run_hashes(words, phrase)
    key = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    span, low = window - phrase + 1, key
    reach = 1
    while reach * 2 <= span:  # sliding minimum by doubling
        low = np.minimum(low[:len(low) - reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[:len(low) - (span - reach)], low[span - reach:])
    starts = np.flatnonzero(own_runs(first, len(words), window))
    at = longs(low[starts] & _LOW)
    return starts, at, grams[at]


def phrase_index(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """``(doc_id, h, n_words, digest, phrases)`` per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words, first, _ in text_words(batch.column(2), False):
                starts, at, grams = named_phrases(words, first, window, phrase)
                cut = np.searchsorted(starts, first)
                mixed = mix(words + np.uint64(11))
                place = mix(np.arange(len(words), dtype=np.uint64))  # the digest depends on the words' order
                digests, found = [], []
                for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    order = place[:b - a]
                    digests.append(np.array([np.add.reduce(words[a:b] * (order | np.uint64(1)), dtype=np.uint64),
                                             np.add.reduce(mix(mixed[a:b] ^ order), dtype=np.uint64) + np.uint64(b - a)],
                                            np.uint64).tobytes())
                    found.append(longs(np.unique(grams[cut[r]:cut[r + 1]])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(first), pa.int64()),
                     pa.array(digests, pa.binary()), list_array(found, pa.int64())],
                    names=["doc_id", "h", "n_words", "digest", "phrases"])

    return docs.mapInArrow(run, "doc_id long, h long, n_words long, digest binary, phrases array<long>")


def recurring_phrases(first_docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, h, phrase)`` of all documents, and ``(phrase, is_hot)`` of the phrases that two of them hold."""
    occ = first_docs.select("doc_id", "h", F.explode("phrases").alias("phrase"))
    again = occ.groupBy("phrase").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")) \
        .where("lo < hi").select("phrase", (F.col("n") > hot).alias("is_hot"))
    return occ, written(again, "recurring")


def phrase_texts(docs: DataFrame, again: DataFrame, window: int, phrase: int) -> DataFrame:
    """``(phrase, is_hot, words)``: the words of each recurring phrase, joined by one space.

    Documents are read without a shuffle; a table of bits of fixed size tells the tasks which phrases may recur."""
    n = again.count()
    bits = int(min(MAX_BITS, max(17, (16 * n).bit_length())))
    shared = docs.sparkSession.sparkContext.broadcast(_bit_table(again.select(F.col("phrase").alias("hash")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for _, _, words, first, (data, ws, we) in text_words(batch.column(0), False):
                _, at, grams = named_phrases(words, first, window, phrase)
                at, keep = np.unique(at, return_index=True)
                grams = grams[keep]
                hit = np.flatnonzero(known[longs(grams >> np.uint64(64 - bits))])
                hit = hit[np.unique(grams[hit], return_index=True)[1]]
                raw = data.tobytes()
                texts = [b" ".join(raw[ws[a]:we[a + phrase - 1]].split()).decode() for a in at[hit].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(longs(grams[hit])), pa.array(texts, pa.string())], names=["phrase", "words"])

    texts = docs.where("doc_id is not null").select("text").mapInArrow(run, "phrase long, words string")
    return texts.groupBy("phrase").agg(F.min("words").alias("words")).join(again, "phrase")


def _occurrences(texts: list[str], phrases: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and first word of every place where one of the phrases stands in the texts (words joined by one space)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(f" {p} ", len(p) + 1)
    automaton.make_automaton()
    rows, starts = [], []
    for r, text in enumerate(texts):
        letter = [end - n for end, n in automaton.iter(f" {text} ")]  # the place in the text of each hit's first letter
        if letter:
            rows.append(np.full(len(letter), r))
            spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 0x20)
            starts.append(np.searchsorted(spaces, letter))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *starts])


def passages(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """``(phrase, is_hot, doc_id, h, start, windows)``: the hashes of all consecutive windows, from word ``start`` on, that name
    one occurrence of a recurring phrase.  ``docs``: ``doc_id, h, text, held`` (structs of a phrase, whether it is hot, and its words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = batch.column(0), batch.column(1)
            for i, j, words, first, (data, ws, we) in text_words(batch.column(2), False):
                held = batch.column(3).slice(i, j - i).flatten()
                phrases, is_hot = held.field(0).to_numpy().view(np.uint64), held.field(1).to_numpy(zero_copy_only=False)
                raw, cuts = data.tobytes(), first.tolist()
                texts = [b" ".join(raw[ws[a]:we[b - 1]].split()).decode() if b > a else "" for a, b in zip(cuts, cuts[1:])]
                row, word = _occurrences(texts, set(held.field(2).to_pylist()))
                found = np.zeros(len(words) + 1, bool)
                found[first[row] + word] = True
                starts, at, grams = named_phrases(words, first, window, phrase)
                new = np.flatnonzero(np.diff(at, prepend=-1))  # windows of one text that name one place are consecutive
                end = np.append(new[1:], len(at))
                keep = found[at[new]]
                new, end = new[keep], end[keep]
                phrases, where = np.unique(phrases, return_index=True)
                place = np.minimum(np.searchsorted(phrases, grams[new]), max(len(phrases) - 1, 0))
                mine = phrases[place] == grams[new] if len(phrases) else np.zeros(0, bool)  # a phrase inside another one's place
                new, end, place = new[mine], end[mine], place[mine]
                if not len(new):
                    continue
                of = np.searchsorted(first, starts[new], side="right") - 1
                hashes = longs(run_hashes(words, window))
                take = pa.array(i + of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(longs(grams[new])), pa.array(is_hot[where][place]), ids.take(take), hs.take(take), pa.array(starts[new] - first[of]),
                     list_array([hashes[starts[a]:starts[b - 1] + 1] for a, b in zip(new.tolist(), end.tolist())], pa.int64())],
                    names=["phrase", "is_hot", "doc_id", "h", "start", "windows"])

    return docs.select("doc_id", "h", "text", "held").mapInArrow(
        run, "phrase long, is_hot boolean, doc_id long, h long, start long, windows array<long>")


def _repeats(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen, owner = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                key, doc, h, start = (batch.column(c).to_numpy() for c in range(4))
                sizes = batch.column(4).value_lengths().to_numpy()
                hashes = batch.column(4).flatten().to_numpy().view(np.uint64)
                row = np.repeat(np.arange(len(key)), sizes)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                carried = key[0] == current
                pool = np.concatenate([seen, hashes]) if carried else hashes
                docs = np.concatenate([owner, doc[row]]) if carried else doc[row]
                uniq, firsts, inv = np.unique(pool, return_index=True, return_inverse=True)
                least = docs[firsts]  # rows come in (phrase, doc_id) order: the first is the smallest
                mine = inv[len(pool) - len(hashes):]
                gone = least[mine] < doc[row]
                last = key[row] == key[-1]
                keep = np.zeros(len(uniq), bool)
                if carried and key[-1] == current:
                    keep[inv[:len(seen)]] = True
                keep[mine[last]] = True
                current, seen, owner = key[-1], uniq[keep], least[keep]
                if gone.any():
                    r, o = row[gone], offset[gone]
                    head = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(o, prepend=-2) != 1))
                    tail = np.append(head[1:], len(r)) - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[r[head]]), pa.array(h[r[head]]), pa.array(start[r[head]] + o[head]),
                         pa.array(start[r[head]] + o[tail] + window)], names=["doc_id", "h", "lo", "hi"])
    return run


def repeats(found: DataFrame, window: int) -> DataFrame:
    """``(doc_id, h, lo, hi)``: word ranges that windows of a smaller document cover."""
    dealt = found.select("phrase", "doc_id", "h", "start", "windows")
    return (dealt.repartition("phrase").sortWithinPartitions("phrase", "doc_id", "start")
            .mapInArrow(_repeats(window), "doc_id long, h long, lo long, hi long"))


def hot_repeats(found: DataFrame, window: int) -> DataFrame:
    """``repeats`` of the phrases of very many documents, dealt out by window, each window in ``SALTS`` parts."""
    rows = found.select("doc_id", "h", "start", F.posexplode("windows").alias("k", "w")).select(
        "w", "doc_id", "h", (F.col("start") + F.col("k")).alias("lo"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    owner = rows.groupBy("w").agg(F.min("doc_id").alias("owner"))
    owner = owner.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(owner, ["w", "salt"]).where("owner < doc_id").select("doc_id", "h", "lo", (F.col("lo") + window).alias("hi"))


def _cut(verbatim: bool):
    """Columns: 0 text, 1 whole, 2 ranges, the rest passes through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, whole, ranges = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            for i, j, words, first, (data, ws, we) in text_words(col, False):
                raw = data.tobytes()
                kept, n_words, n_removed = [], [], []
                for r in range(i, j):
                    a, b = int(first[r - i]), int(first[r - i + 1])
                    gone = np.zeros(b - a + 1, np.int64)
                    if whole[r]:
                        gone[:] = 1
                    elif ranges[r].is_valid:
                        for x in ranges[r].as_py():
                            gone[x["lo"]] += 1
                            gone[x["hi"]] -= 1
                        gone = np.cumsum(gone)
                    gone = gone[:b - a] > 0
                    n_words.append(b - a)
                    n_removed.append(int(gone.sum()))
                    if verbatim and not n_removed[-1]:
                        kept.append(col[r].as_py())
                        continue
                    # kept stretches, each normalised to single spaces
                    edges = np.flatnonzero(np.diff(np.concatenate([[1], gone.view(np.int8), [1]])))
                    parts = [b" ".join(raw[ws[a + s]:we[a + e - 1]].split()) for s, e in zip(edges[::2], edges[1::2])]
                    kept.append(b" ".join(parts).decode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
                    + [batch.column(c).slice(i, j - i) for c in range(3, batch.num_columns)],
                    names=["text", "n_words", "n_removed"] + [f"c{c}" for c in range(3, batch.num_columns)])
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, verbatim: bool = False, hot: int = HOT,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(text, n_words, n_removed, rest)``: the kept text, counts, and a struct of the other input columns.

    Kept words are joined by one space; with ``verbatim`` a text that loses nothing stays as it is."""
    on_workers(docs.sparkSession)
    ids, texts = docs[id_col].cast("long"), docs[text_col].cast("string")
    keyed = docs.select(ids.alias("doc_id"), F.xxhash64(texts).alias("h"), texts.alias("text"))
    index = written(phrase_index(keyed, window, phrase), "phrases")
    long_enough = index.where(F.col("n_words") >= window).where("doc_id is not null")
    classes = long_enough.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("least"))
    firsts = long_enough.join(classes, "digest").where((F.col("doc_id") == F.col("least.doc_id")) & (F.col("h") == F.col("least.h"))) \
        .dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "phrases")
    firsts = written(firsts, "first-docs")
    occ, again = recurring_phrases(firsts, hot)
    spelt = written(phrase_texts(keyed, again, window, phrase), "phrase-texts")
    lists = occ.join(spelt, "phrase").groupBy("doc_id", "h").agg(F.collect_list(F.struct("phrase", "is_hot", "words")).alias("held"))
    found = written(passages(keyed.where("doc_id is not null").join(lists, ["doc_id", "h"]), window, phrase), "passages")
    ranges = (repeats(found.where("not is_hot"), window).unionByName(hot_repeats(found.where("is_hot"), window)).distinct().groupBy("doc_id", "h")
              .agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
    # a document whose words equal a smaller document's loses everything, others what their class's first lost
    verdict = (long_enough.select("doc_id", "h", "digest").distinct().join(classes, "digest")
               .select("doc_id", "h", (F.col("doc_id") > F.col("least.doc_id")).alias("whole"),
                       F.col("least.doc_id").alias("l_id"), F.col("least.h").alias("l_h")))
    lost = ranges.select(F.col("doc_id").alias("l_id"), F.col("h").alias("l_h"), "ranges")
    own = verdict.where("not whole").join(lost, ["l_id", "l_h"]).select("doc_id", "h", "whole", "ranges")
    decided = own.unionByName(verdict.where("whole").select(
        "doc_id", "h", "whole", F.lit(None).cast(own.schema["ranges"].dataType).alias("ranges")))
    decided = decided.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "whole", "ranges")
    others = [c for c in docs.columns if c != text_col]
    wide = docs.select(texts.alias("_text"), ids.alias("_id"), F.xxhash64(texts).alias("_key"),
                       F.struct(*[docs[c] for c in others]).alias("_rest"))
    joined = wide.join(decided, (F.col("_id") == F.col("_d")) & (F.col("_key") == F.col("_h")), "left")
    joined = joined.select(F.col("_text").alias("text"), F.coalesce("whole", F.lit(False)).alias("whole"), "ranges",
                           F.col("_rest").alias("rest"))
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("rest", joined.schema["rest"].dataType)])
    renamed = T.StructType([*schema.fields[:3], T.StructField("c3", schema.fields[3].dataType)])
    return joined.mapInArrow(_cut(verbatim), renamed).withColumnRenamed("c3", "rest")
