"""Report sink: ordered report blocks to text files, one folder per project and report."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_reports(blocks: DataFrame, path: str, num_partitions: int | None = None) -> str:
    """Write ``(project_name, report_type, block_no, text)`` below
    ``path/project_name=<name>/report_type=<summary|interviews>/``.

    Blocks are range-partitioned on ``(project_name, report_type, block_no)`` and
    sorted inside each partition, so a large project is written by many tasks in
    parallel and its report is the concatenation of its part files in file-name
    order (each block followed by one line break).  No task ever holds a whole
    report.
    """
    keys = ["project_name", "report_type", "block_no"]
    (blocks.select(*keys, "text")
     .repartitionByRange(*([num_partitions] if num_partitions else []), *keys)
     .sortWithinPartitions(*keys)
     .drop("block_no")
     .write.mode("overwrite").partitionBy("project_name", "report_type").text(path))
    return path


def read_reports(spark, path: str) -> DataFrame:
    """Lines of the written reports: ``(value, project_name, report_type)``; names stay strings."""
    return spark.read.schema("value string, project_name string, report_type string").text(path)
