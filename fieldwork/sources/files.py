"""Text-file ingest and page assembly.

Files are read with the ``binaryFile`` source, so invalid UTF-8 is detected
instead of being silently replaced; decoding, line-end normalisation and the
emptiness rule are Column expressions.
"""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork import schemas as S
from fieldwork.operators.numbering import sequence_number
from fieldwork.operators.scoring import persist_table
from fieldwork.session import local_path

_WS_CHARS = S.whitespace_chars()

SCANS_PER_TASK = 32  # file scan partitions that one task reads, see ``fewer_tasks``
#: What Spark writes as %XX in the name of a partition folder.
_ESCAPES = {ord(c): f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"]}


def read_text_files(spark: SparkSession, root: str, suffix: str = ".txt", layout: str = "folders") -> DataFrame:
    """``(path, project_name, raw)`` for every file ending in ``suffix`` (case-sensitive).

    ``layout="folders"``: ``root/<project_name>/<file>`` (one level, not recursive).
    ``layout="hive"``: ``root/project=<name>/.../<file>``, any depth.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
    if layout == "hive":
        df = reader.option("recursiveFileLookup", "true").load(root)
        project = folder_value("path", "project")
    else:
        df = reader.load(f"{root.rstrip('/')}/*/")
        project = F.element_at(F.split("path", "/"), -2)
    return df.select("path", project.alias("project_name"), F.col("content").alias("raw"))


def folder_value(path: str, name: str) -> F.Column:
    """The decoded value of a ``name=value`` folder; a plus sign stays a plus sign."""
    raw = F.regexp_extract(path, rf"/{name}=([^/]+)/", 1)
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def normalise_file_text(raw) -> F.Column:
    """UTF-8 text with ``\\r\\n`` and ``\\r`` turned into ``\\n`` and outer whitespace
    stripped; ``NULL`` when the bytes are not valid UTF-8."""
    text = F.try_validate_utf8(F.col(raw).cast("string"))
    text = F.regexp_replace(text, r"\r\n?", "\n")
    return F.btrim(text, F.lit(_WS_CHARS))


def stage_files(files: DataFrame) -> DataFrame:
    """``(path, project_name, content, reason)``; ``reason`` is null for a valid file."""
    staged = files.select("path", "project_name", normalise_file_text("raw").alias("content"))
    reason = (F.when(F.col("content").isNull(), F.lit("invalid utf-8"))
              .when(F.col("content") == "", F.lit("empty content")))
    return staged.withColumn("reason", reason)


def fewer_tasks(files: DataFrame) -> DataFrame:
    """``files`` read by fewer tasks.  A scan counts every file as ``spark.sql.files.openCostInBytes`` at least, so small files come a few
    to a partition; ``SCANS_PER_TASK`` of these make a task, and at least four tasks a core are kept."""
    scans, least = files.rdd.getNumPartitions(), 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(least, scans // SCANS_PER_TASK)) if scans > least else files


def staged_table(files: DataFrame, path: str | None = None) -> DataFrame:
    """``stage_files``, each file read once and written to ``path``, or to the scratch folder."""
    staged = stage_files(fewer_tasks(files))
    if path is None:
        return persist_table(staged, "ingest-staged", compression="zstd")
    staged.write.mode("overwrite").parquet(path, compression="zstd")
    return files.sparkSession.read.parquet(path)


def split_staged(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid interviews ``(project_name, path, content)``, without ids, and the rejects ``(source, reason, payload)`` of staged files."""
    good = staged.where(F.col("reason").isNull()).select("project_name", "path", "content")
    bad = staged.where(F.col("reason").isNotNull()).select(
        F.lit("interviews").alias("source"), "reason", F.col("path").alias("payload"))
    return good, bad


def split_ingest(files: DataFrame, top: int = 0) -> tuple[DataFrame, DataFrame]:
    """Valid interviews ``(interview_id, project_name, path, content)`` and
    rejects ``(source, reason, payload)``; one bad file never stops the others.

    Files are read once and staged in the scratch folder.  Ids are the numbers above ``top`` in the order of
    ``(project_name, path)``, which names one file; only these keys are range-partitioned.
    """
    return number_staged(staged_table(files), top)


def number_staged(staged: DataFrame, top: int = 0) -> tuple[DataFrame, DataFrame]:
    """``split_ingest`` of staged files."""
    good, bad = split_staged(staged)
    order = ["project_name", "path"]
    ids = sequence_number(good.select(*order), [], order, name="_n")
    return (good.join(ids, order).select((F.col("_n") + F.lit(top)).alias("interview_id"), "project_name", "path", "content"), bad)


def ingest_text(spark: SparkSession, root: str, suffix: str = ".txt",
                layout: str = "folders", top: int = 0) -> tuple[DataFrame, DataFrame]:
    """One interview row per text file: ``(interviews, rejects)``; ids follow ``top``."""
    return split_ingest(read_text_files(spark, root, suffix, layout), top)


def write_documents_as_files(docs: DataFrame, root: str) -> None:
    """Lay texts out as one file per document below ``root/project=<name>/``.

    Used to derive file inputs from the given tables.  Each file holds the text followed by one line break.  What ``root``
    held is replaced.  In a folder that all machines mount (no scheme, or ``file:``) the tasks write the files themselves:
    for every file made there, Spark's writer starts two processes that set its mode, at some 20 ms a file.  In
    other stores Spark's writer makes them, with ``maxRecordsPerFile=1``.
    """
    rows = docs.select(F.col("project_name").alias("project"), "text")
    mounted = urlparse(root).scheme in ("", "file")
    (rows.limit(0) if mounted else rows).write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("project").text(root)
    if mounted:
        (rows.select(F.col("project").cast("string").alias("project"), F.col("text").cast("binary").alias("text"))
         .mapInArrow(_file_writer(local_path(root)), "files long").write.format("noop").mode("overwrite").save())


def _file_writer(root: str):
    """A ``mapInArrow`` function that writes a file a row.  Files get their names by task and row and are moved into place when they
    are whole, so a task that runs again replaces its own files."""
    escapes = _ESCAPES

    def write(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        task, made, n = TaskContext.get(), set(), 0
        for batch in batches:
            for project, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{root}/project={project.translate(escapes) if project else '__HIVE_DEFAULT_PARTITION__'}".encode()
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                name = f"part-{task.partitionId():05d}-{n:09d}.txt"
                part = folder + f"/.{name}-{task.taskAttemptId()}".encode()
                with open(part, "wb") as f:
                    f.write((text or b"") + b"\n")
                os.replace(part, folder + f"/{name}".encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    return write


def page_text_assembly(pages: DataFrame, doc: str = "doc", page_no: str = "page_no",
                       text: str = "text") -> DataFrame:
    """Page texts of a document concatenated in page order, no separator."""
    return (pages.groupBy(doc)
            .agg(F.expr(f"listagg({text}, '') within group (order by {page_no})").alias("text")))
