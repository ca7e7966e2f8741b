"""Table access: parameterised SQL, validated append, project registry, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwork import schemas as S
from fieldwork.operators.numbering import sequence_number
from fieldwork.session import scratch_path

_WS_CHARS = S.whitespace_chars()


def param_sql(spark: SparkSession, query: str, params: dict | None = None, **frames: DataFrame) -> DataFrame:
    """Run ``query`` with ``:name`` parameter markers bound from ``params``.

    Tables are passed as DataFrames and referenced as ``{name}``; values are
    bound, never pasted into the text.
    """
    return spark.sql(query, args=params or {}, **frames)


# ---------------------------------------------------------------------------
# Validated append
# ---------------------------------------------------------------------------

# Column rules per table: required columns must be present (strings non-empty
# after stripping); optional strings default to ''; ``created`` defaults to now.
TABLE_RULES = {
    "projects": {"schema": S.PROJECTS_SCHEMA, "required": ["project_name"], "optional_str": []},
    "interviews": {"schema": S.INTERVIEWS_SCHEMA, "required": ["project", "content"], "optional_str": []},
    "llm_answers": {"schema": S.ANSWERS_SCHEMA,
                    "required": ["project", "analysis_type", "created", "model", "input_tokens",
                                 "output_tokens", "prompt"],
                    "optional_str": ["answer_full", "answer_content", "answer_content_clear"]},
}


def validate_rows(rows: DataFrame, table_name: str, projects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split candidate rows for ``table_name`` into valid rows (cast to the table
    schema, strings stripped, defaults filled) and rejects with a reason.

    Columns missing from ``rows`` count as NULL; a value that cannot be cast is a
    reject ("<column> invalid").  A missing key (the table's first column) stays NULL until the append
    assigns it (``with_new_keys``).  With ``projects`` given, a row whose project is not registered is
    rejected.  One bad row never stops the others; rejects keep the row as it came.
    """
    rules = TABLE_RULES[table_name]
    schema: T.StructType = rules["schema"]
    cols, reason = [], None
    for f in schema.fields:
        raw = F.col(f.name) if f.name in rows.columns else F.lit(None)
        c = raw.try_cast(f.dataType)
        bad = raw.isNotNull() & c.isNull()
        reason = F.when(bad, F.lit(f"{f.name} invalid")) if reason is None else reason.when(bad, F.lit(f"{f.name} invalid"))
        if isinstance(f.dataType, T.StringType):
            c = F.btrim(c, F.lit(_WS_CHARS))
            if f.name in rules["optional_str"]:
                c = F.coalesce(c, F.lit(""))
        if f.name == "created":
            c = F.coalesce(c, F.current_timestamp().cast("timestamp_ntz"))
        cols.append(c.alias(f.name))
    raw_row = F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("_raw")
    staged = rows.select(*cols, raw_row, reason.alias("_reason"))
    reason = F.when(F.col("_reason").isNotNull(), F.col("_reason"))
    for name in rules["required"]:
        bad = F.col(name).isNull()
        if isinstance(schema[name].dataType, T.StringType):
            bad = bad | (F.col(name) == "")
        reason = reason.when(bad, F.lit(f"{name} required"))
    if projects is not None and "project" in schema.names:
        known = projects.select(F.col("project_id").alias("project")).distinct().withColumn("_known", F.lit(True))
        staged = staged.join(known, "project", "left")
        reason = reason.when(F.col("_known").isNull(), F.lit("project unknown"))
    staged = staged.withColumn("_reason", reason)
    valid = staged.where(F.col("_reason").isNull()).select(*schema.names)
    rejects = staged.where(F.col("_reason").isNotNull()).select(
        F.lit(table_name).alias("source"), F.col("_reason").alias("reason"),
        F.col("_raw").alias("payload"))
    return valid, rejects


def with_new_keys(rows: DataFrame, key: str, top: int, order: list[str] | None = None) -> tuple[DataFrame, int]:
    """Give every row without ``key`` a number above ``top`` and above all keys the rows bring; return the rows and the new top.

    Numbers are consecutive, so equal rows get different ones, and a caller that keeps the top never
    gives one out twice.  With ``order`` they follow it (one range shuffle), so the same rows get the same numbers again.

    The rows are written once to the scratch folder; a row's number is its place in its file plus the
    rows of the files before, so no text is shuffled for it.  The offsets are a table of one row a file.
    """
    spark = rows.sparkSession
    new = rows.where(F.col(key).isNull())
    if order:
        new = new.repartitionByRange(*order).sortWithinPartitions(*order)
    path = scratch_path(spark, f"new-{key}")
    new.write.parquet(path)
    brought = rows.where(F.col(key).isNotNull())
    top = max(top, brought.agg(F.max(key)).first()[0] or 0)  # one scalar
    placed = spark.read.schema(rows.schema).parquet(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    part = F.regexp_extract("_file", r"/part-(\d+)", 1).cast("int")
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).withColumn("_part", part)
    before = Window.orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(offsets, "_file").withColumn(key, F.lit(top) + F.col("_before") + F.col("_row") + 1)
    count = sizes.agg(F.sum("_n")).first()[0] or 0  # one scalar
    return brought.unionByName(numbered.select(*rows.columns)), top + count


def validated_append(rows: DataFrame, table_name: str, path: str, projects: DataFrame | None = None) -> DataFrame:
    """Append the valid rows to the table at ``path``, with keys above those it holds; return the rejects.

    One writer at a time.  ``plans.job.Store`` commits the tables of a run together instead."""
    from fieldwork.operators.scoring import read_if_written
    valid, rejects = validate_rows(rows, table_name, projects)
    schema = TABLE_RULES[table_name]["schema"]
    key = schema.fields[0].name
    held = read_if_written(rows.sparkSession, path, schema)
    top = held.agg(F.max(key)).first()[0] if held is not None else None  # one scalar
    with_new_keys(valid, key, top or 0)[0].write.mode("append").parquet(path)
    return rejects


# ---------------------------------------------------------------------------
# Projects
# ---------------------------------------------------------------------------

def register_projects(existing: DataFrame, names: DataFrame) -> DataFrame:
    """Add names not yet registered; ids continue after the largest existing id
    in name order.  Duplicate names collapse to their smallest id.

    ``existing``: ``(project_id, project_name)``; ``names``: ``(project_name)``.
    """
    current = existing.groupBy("project_name").agg(F.min("project_id").alias("project_id"))
    new = names.select("project_name").distinct().join(current, "project_name", "left_anti")
    top = existing.agg(F.max("project_id")).first()[0]  # one scalar
    top = int(top) if top is not None else 0
    numbered = sequence_number(new, [], ["project_name"], name="_n")
    added = numbered.select((F.col("_n") + F.lit(top)).alias("project_id"), "project_name")
    return current.select("project_id", "project_name").unionByName(added)


def number_names(names: DataFrame) -> DataFrame:
    """A fresh registry: ids 1..n in name order."""
    return (sequence_number(names.select("project_name").distinct(), [], ["project_name"], name="project_id")
            .select("project_id", "project_name"))


def resolve_project(projects: DataFrame, name: str) -> DataFrame:
    """``SELECT DISTINCT project_id … WHERE project_name = :name`` then the first:
    the smallest id (deterministic)."""
    return (projects.where(F.col("project_name") == F.lit(name))
            .groupBy("project_name").agg(F.min("project_id").alias("project_id")))


def project_interviews(interviews: DataFrame, project_id) -> DataFrame:
    """``SELECT DISTINCT interview_id, content … WHERE project = :id``."""
    pid = project_id if isinstance(project_id, F.Column) else F.lit(project_id)
    return interviews.where(F.col("project") == pid).select("interview_id", "content").distinct()
