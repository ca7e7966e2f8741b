"""Streaming latest answer per key over a growing answer log.

A streaming aggregate keeps one state row per ``(project, interview,
analysis_step)``: ``max_by`` of the answer by ``(created, id)``.  The merge is
commutative, so late or out-of-order rows need no watermark: any arrival order
gives the batch result.  Update mode emits only changed keys; each micro-batch
is written to its own ``updates/batch_id=<n>`` folder (idempotent on retry).
Every ``compact_every`` batches the view so far is written to
``snapshots/upto=<n>``, and then, when that is complete, ``pointers/upto=<n>`` names it.  The current view
takes, per key, the row of the highest batch among the newest snapshot that a pointer names
and the batches after it, so a snapshot that is being written, or was left unfinished, is never read, and the view never
reads more than ``2 * compact_every`` batches.  A snapshot is a function of its batches, and a
retried batch writes it again.  After a pointer is written, what the pointer before it had already replaced is deleted: older
snapshots and their pointers, and the batches they cover.  Readers that hold the view of the pointer before finish undisturbed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork import schemas as S
from fieldwork.operators.scoring import read_if_written

KEY = ["project", "interview", "analysis_step"]


def latest_stream(log: DataFrame, analysis_type: str = "interview") -> DataFrame:
    """The streaming aggregate (usable with any streaming source of the log)."""
    return (log.where(F.col("analysis_type") == analysis_type)
            .groupBy(*KEY)
            .agg(F.max_by(F.struct("id", "answer_content"), F.struct("created", "id")).alias("latest")))


def stream_latest(spark: SparkSession, log_dir: str, out_root: str, checkpoint: str,
                  schema=S.ANSWERS_SCHEMA, max_files_per_trigger: int = 1, available_now: bool = True,
                  state_partitions: int | None = None, compact_every: int = 50):
    """Run the latest-answer stream over the parquet log in ``log_dir``.

    ``state_partitions`` fixes the number of state-store partitions; a
    streaming query records it in its checkpoint on the first start, so it is
    applied only while the query starts (the session setting is restored).
    """
    src = (spark.readStream.schema(schema)
           .option("maxFilesPerTrigger", str(max_files_per_trigger)).parquet(log_dir))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_root}/updates/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            write_snapshot(batch.sparkSession, out_root, batch_id)

    writer = (latest_stream(src).writeStream.outputMode("update").foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if state_partitions:
        spark.conf.set(key, str(state_partitions))
    try:
        q = writer.start()
    finally:
        spark.conf.set(key, before)
    if available_now:
        q.awaitTermination()
    return q


def write_snapshot(spark: SparkSession, out_root: str, batch_id: int) -> None:
    """Write the view up to a batch, name it, and delete what the view named before it had replaced."""
    _merged(_parts(spark, out_root, before=batch_id)).write.mode("overwrite").parquet(f"{out_root}/snapshots/upto={batch_id}")
    older = [n for n in _pointers(spark, out_root) if n < batch_id]
    spark.range(1).write.mode("overwrite").parquet(f"{out_root}/pointers/upto={batch_id}")
    kept = max(older, default=-1)  # readers may still use this one
    for name, number in (("pointers", "upto"), ("snapshots", "upto")):
        _delete(spark, f"{out_root}/{name}", number, lambda n: n < kept)
    _delete(spark, f"{out_root}/updates", "batch_id", lambda n: n <= kept)


def _delete(spark: SparkSession, folder: str, number: str, unused: Callable[[int], bool]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path) if fs.exists(path) else []:
        name, _, value = status.getPath().getName().partition("=")
        if name == number and unused(int(value)):
            fs.delete(status.getPath(), True)


def _pointers(spark: SparkSession, out_root: str) -> list[int]:
    """The batches up to which finished snapshots reach: two at most, besides one that is being replaced."""
    named = read_if_written(spark, f"{out_root}/pointers", "id long, upto int")
    return [r[0] for r in named.select("upto").collect()] if named is not None else []


def _parts(spark: SparkSession, out_root: str, before: int | None = None) -> DataFrame:
    """The newest finished snapshot (older than batch ``before``) and the batches after it; folders are pruned by their number."""
    updates = spark.read.parquet(f"{out_root}/updates")
    last = max((n for n in _pointers(spark, out_root) if before is None or n < before), default=None)
    if last is None:
        return updates
    snapshot = spark.read.parquet(f"{out_root}/snapshots/upto={last}").withColumn("batch_id", F.lit(last))
    return updates.where(F.col("batch_id") > last).unionByName(snapshot)


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEY).agg(F.max_by("latest", "batch_id").alias("latest"))


def current_view(spark: SparkSession, out_root: str) -> DataFrame:
    """Per key, the state emitted by the latest micro-batch that touched it."""
    return (_merged(_parts(spark, out_root))
            .select(*KEY, F.col("latest.id").alias("id"), F.col("latest.answer_content").alias("answer_content")))
