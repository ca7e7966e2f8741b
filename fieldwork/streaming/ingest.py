"""Streaming file ingest: every file is ingested once, however often the job runs.

The file source records processed files in the checkpoint; each micro-batch
goes through the same rules as the batch ingest and is written to its own
``batch_id=<n>`` folder with ``overwrite``, so a retried batch replaces its
own output instead of duplicating it.  A batch's ids follow the highest id of the
batches before it, so they are dense, unique, and the same on a retry.

A batch holds a bounded number of files: for each of them the driver keeps a path in the plan,
a listing and a scan partition, some kilobytes.  Of the files outside the batch it
keeps what Spark's file source does, a path and a time.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.operators.scoring import read_if_written
from fieldwork.session import delete_folder, scratch_path
from fieldwork.sources import files as FL

FILES_PER_BATCH = 20_000
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_ingest(spark: SparkSession, raw_root: str, table_root: str, checkpoint: str,
                  layout: str = "hive", suffix: str = ".txt", max_files_per_trigger: int | None = None,
                  available_now: bool = True):
    """Start (and, with ``available_now``, finish) the ingest stream.

    Writes ``table_root/interviews`` and ``table_root/rejects``; returns the
    finished ``StreamingQuery``.  Every file is ingested, in as many batches as it takes,
    of ``max_files_per_trigger`` files or, without it, ``FILES_PER_BATCH``.
    """
    reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("pathGlobFilter", f"*{suffix}")
              .option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", str(max_files_per_trigger or FILES_PER_BATCH)))
    src = reader.load(raw_root)
    if layout == "hive":
        project = FL.folder_value("path", "project")
    else:
        project = F.element_at(F.split("path", "/"), -2)
    files = src.select("path", project.alias("project_name"), F.col("content").alias("raw"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        top = highest_id(batch.sparkSession, table_root, batch_id)
        path = scratch_path(batch.sparkSession, "ingest-staged")
        good, bad = FL.number_staged(FL.staged_table(batch, path), top)
        good.write.mode("overwrite").parquet(f"{table_root}/interviews/batch_id={batch_id}", compression="zstd")
        bad.write.mode("overwrite").parquet(f"{table_root}/rejects/batch_id={batch_id}")
        delete_folder(batch.sparkSession, path)  # the batch is written

    writer = files.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    with _light_listing(spark):
        q = writer.start()
        if available_now:
            q.awaitTermination()
    return q


@contextmanager
def _light_listing(spark: SparkSession):
    """A batch's files are listed one by one in up to 10,000 tasks, each far shorter than its start; four a core do.
    Where a file's blocks are is not asked: of small files that takes the driver more memory than their paths."""
    tasks, blocks = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.sources.ignoreDataLocality"
    before = {name: spark.conf.get(name) for name in (tasks, blocks)}
    spark.conf.set(tasks, min(int(before[tasks]), 4 * spark.sparkContext.defaultParallelism))
    spark.conf.set(blocks, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def highest_id(spark: SparkSession, table_root: str, batch_id: int) -> int:
    """The highest id before a batch: that of the last batch before it that has any."""
    for n in range(batch_id - 1, -1, -1):
        table = read_if_written(spark, f"{table_root}/interviews/batch_id={n}", "interview_id bigint")
        top = table.agg(F.max("interview_id")).first()[0] if table is not None else None  # one scalar
        if top is not None:
            return top
    return 0


def read_ingested(spark: SparkSession, table_root: str) -> DataFrame:
    schema = "interview_id bigint, project_name string, path string, content string, batch_id int"
    table = read_if_written(spark, f"{table_root}/interviews", schema)
    return table if table is not None else spark.createDataFrame([], schema)
