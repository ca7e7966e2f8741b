"""Row numbers and running totals inside groups that may be very large.

``row_number() OVER (PARTITION BY g ORDER BY o)`` puts a whole group into one
task.  When one group may hold a third of all rows, that task is the job.  The
operators here range-partition on ``(g, o)`` instead, so a large group is
spread over many partitions, number each piece locally, and add per-piece
offsets from a small table (at most one row per group and partition).

The range-partitioned rows are checkpointed (reliably, to the shared
checkpoint folder) before they are used twice: range bounds come from a
sample, and a second evaluation could draw other bounds.  Pass only the
columns you need; ``sequence_number`` callers with a payload can number the
keys alone and join the numbers back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwork.session import ensure_checkpoint_dir


def _piece_offsets(pieces: DataFrame, group_cols: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive prefix sums over the pieces of each group, in partition order.

    ``pieces`` has at most one row per (group, partition), so the window here
    handles at most ``num_partitions`` rows per group.
    """
    w = (Window.partitionBy(*group_cols).orderBy("_pid")
         .rowsBetween(Window.unboundedPreceding, -1))
    cols = [F.coalesce(F.sum(src).over(w), F.lit(0)).alias(dst) for src, dst in sums.items()]
    extra = [c for c in pieces.columns if c.startswith("_first")]
    return pieces.select(*group_cols, "_pid", *extra, *cols)


def _ranged(df: DataFrame, keys: list[str], n: int | None, sort: bool) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    out = df.repartitionByRange(*([n] if n else []), *keys)  # without a number, sized by the input at run time
    if sort:
        out = out.sortWithinPartitions(*keys)
    out = out.withColumn("_pid", F.spark_partition_id())
    if sort:
        out = out.withColumn("_mid", F.monotonically_increasing_id())
    return out.checkpoint(eager=True)


def sequence_number(df: DataFrame, group_cols: list[str], order_cols: list[str],
                    name: str = "seq", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of the row inside its group, by ``order_cols``.

    One range shuffle.  Inside a partition the rows are sorted by the full key,
    so ``monotonically_increasing_id`` gives each row its position; the first
    position of every (group, partition) piece and the sizes of the earlier
    pieces come from a small aggregate that is joined back (AQE broadcasts it
    once it has measured it).  Ties in ``order_cols`` are numbered arbitrarily,
    as with ``row_number``.
    """
    keys = [*group_cols, *order_cols]
    ranged = _ranged(df, keys, num_partitions, sort=True)
    pieces = ranged.groupBy(*group_cols, "_pid").agg(F.count(F.lit(1)).alias("_n"),
                                                     F.min("_mid").alias("_first_mid"))
    offsets = _piece_offsets(pieces, group_cols, {"_n": "_off_n"})
    return (ranged.join(offsets, [*group_cols, "_pid"])
            .withColumn(name, F.col("_mid") - F.col("_first_mid") + F.col("_off_n") + F.lit(1))
            .drop("_pid", "_mid", "_first_mid", "_off_n"))


def running_total(df: DataFrame, group_cols: list[str], order_cols: list[str], weight: str,
                  name: str = "cum", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = sum of ``weight`` over the rows of the group up to and
    including this one, by ``order_cols`` (ties broken arbitrarily but consistently).

    The window runs per (group, range partition) piece, never over a whole group;
    earlier pieces contribute through the offset table.
    """
    keys = [*group_cols, *order_cols]
    ranged = _ranged(df, keys, num_partitions, sort=False)
    w = (Window.partitionBy(*group_cols, "_pid").orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn("_local", F.sum(weight).over(w))
    pieces = ranged.groupBy(*group_cols, "_pid").agg(F.sum(weight).alias("_w"))
    offsets = _piece_offsets(pieces, group_cols, {"_w": "_off_w"})
    return (local.join(offsets, [*group_cols, "_pid"])
            .withColumn(name, F.col("_local") + F.col("_off_w"))
            .drop("_pid", "_local", "_off_w"))
