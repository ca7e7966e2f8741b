"""Latest-version selection over the append-only answer log (and related lookups)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANSWER_KEY = ("project", "interview", "analysis_step")


def answers_filter(answers: DataFrame, analysis_type: str = "interview",
                   project: int | None = None) -> DataFrame:
    """Rows of one analysis type, optionally of one project.

    Written before any window or aggregate so that Catalyst pushes it into the
    Parquet scan; with ``project=None`` every project is processed at once.
    """
    cond = F.col("analysis_type") == F.lit(analysis_type)
    if project is not None:
        cond = cond & (F.col("project") == F.lit(project))
    return answers.where(cond)


def latest_answers(answers: DataFrame, analysis_type: str = "interview",
                   project: int | None = None) -> DataFrame:
    """One row per ``(project, interview, analysis_step)``: the newest ``created``;
    on equal ``created`` the higher ``id``.

    ``row_number() = 1`` is planned as a partial ``WindowGroupLimit`` before the
    shuffle, so every map task forwards at most one row per key: a key holding
    a large share of all versions is reduced before it reaches a single task.
    ``NULL`` interviews (project-level answers) form one key, as in SQL.
    """
    w = Window.partitionBy(*ANSWER_KEY).orderBy(F.col("created").desc(), F.col("id").desc())
    return (answers_filter(answers, analysis_type, project)
            .withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == 1)
            .drop("_rn"))


def first_project_step(latest_project: DataFrame) -> DataFrame:
    """Per project, the answer of the lowest step (then lowest id) among the latest ones."""
    return (latest_project.groupBy("project")
            .agg(F.min_by("answer_content", F.struct("analysis_step", "id")).alias("answer_content")))


def previous_answers(latest: DataFrame, plan: DataFrame) -> DataFrame:
    """For every latest answer whose plan step uses the previous answer, the latest
    answer of step ``n-1`` of the same interview (``NULL`` when that step is missing).

    An equi-join on ``(project, interview, step-1)`` rather than ``lag``: ``lag``
    would pick step ``n-2`` when step ``n-1`` is missing.
    """
    steps = F.broadcast(plan.select("analysis_type", "analysis_step", "uses_previous"))  # a handful of rows
    cur = (latest.join(steps, ["analysis_type", "analysis_step"])
           .where("uses_previous")
           .select("project", "interview", "analysis_step"))
    prev = latest.select("project", "interview",
                         (F.col("analysis_step") + 1).alias("analysis_step"),
                         F.col("id").alias("previous_id"),
                         F.col("answer_content").alias("previous_answer"))
    return cur.join(prev, ["project", "interview", "analysis_step"], "left")


def last_value_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``{key: value}`` where later rows (higher ``order``) win.

    ``max_by`` is an aggregate, so each map task pre-reduces a hot key to one row.
    """
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
