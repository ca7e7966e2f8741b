"""The corpus pipeline: toxicity filter, near-duplicate classes, substring dedup, benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as
the next stage's ``docs``.  All stages but the last return the columns of ``documents``; other columns pass through
by name.  Every stage works on all rows that the one before it kept.  Near duplicates are judged on five-word
shingles at a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.llm.common import read_table, written
from fieldwork.llm.decontam import clean_documents
from fieldwork.llm.ngram_join import jaccard_classes
from fieldwork.llm.packing import pack
from fieldwork.llm.phrase_dedup import remove_repeats
from fieldwork.llm.toxicity import clean_of_toxic
from fieldwork.session import ensure_checkpoint_dir

ORACLE_SQL = None  # the toxicity model is trained, and pieces are tokenised: SQL cannot express them


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier chain rejects as toxic."""
    return clean_of_toxic(docs, read_table(spark, sf_dir, "labels"))


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each class of near duplicates; rows without doc_id or without words all stay.

    A document is a (doc_id, text): different texts under one doc_id are judged one by one, equal ones are one document."""
    judged = F.coalesce(docs["doc_id"].isNotNull() & docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(judged).select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), F.struct("*").alias("row"))
    classes = jaccard_classes(rows.select("key", F.col("row.text").alias("text")), k=5, num=8, den=10, id_col="key")
    ids = rows.select("key", F.col("row.doc_id").cast("long").alias("id")).distinct()
    kept = classes.select(F.col("doc_id").alias("key"), "component_id").distinct().join(ids, "key") \
        .groupBy("component_id").agg(F.min(F.struct("id", "key"))["key"].alias("key")).select("key")
    one = rows.join(kept, "key", "left_semi").dropDuplicates(["key"])
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns]).unionByName(docs.where(~judged))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that a document with a smaller doc_id holds."""
    out = remove_repeats(docs, window=50, verbatim=True)
    cols = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"rest.`{c}`").alias(c)
            for c in docs.columns]
    return out.select(*cols)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain a benchmark item."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens; each row holds its ids."""
    return pack(docs, seq_len=2048)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", one_per_class), ("substring_dedup", cut_repeats),
          ("decontamination", drop_benchmark), ("packing", pack_documents)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared scratch folder and read again."""
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
