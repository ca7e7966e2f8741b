"""Interview reports and project summaries.

Reports stay as rows of blocks ``(project, report_type, block_no, text)``; a
project's report becomes one string only at the sink, which writes the blocks
in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwork import schemas as S
from fieldwork.functions import text as T
from fieldwork.operators import latest as L
from fieldwork.operators import sections as SEC
from fieldwork.operators.numbering import sequence_number


def report_numbers(keys: DataFrame) -> DataFrame:
    """Running number 1..n per project over the interviews that have answers:
    ``(project, interview) -> report_no`` (keys are unique)."""
    return sequence_number(keys.select("project", "interview"), ["project"], ["interview"], name="report_no")


def interviews_report(answers: DataFrame, project: int | None = None) -> DataFrame:
    """One block per interview with answers:
    ``"\\nИНТЕРВЬЮ № {n}"`` followed by every labelled, normalised section in match order.

    Shuffles: the latest-version window, the per-interview concatenation, and
    the range shuffle of the numbering.  The block itself is built per row from
    the extracted arrays, with no explode / re-group.
    """
    latest = L.latest_answers(answers.select("id", "project", "interview", "analysis_type",
                                             "analysis_step", "created", "answer_content"),
                              "interview", project)
    concat = SEC.concat_answers(latest)
    # only the keys go through the numbering; the texts stay in the aggregate's
    # partitioning and the (small) numbers are joined onto them
    numbered = concat.join(report_numbers(concat), ["project", "interview"])
    return numbered.select(
        "project", "interview", "report_no",
        T.interview_report_block("report_no", T.extract_sections("answers_text")).alias("report_block"))


def _first_project_answers(answers: DataFrame, project: int | None = None) -> DataFrame:
    latest = L.latest_answers(answers.select("id", "project", "interview", "analysis_type",
                                             "analysis_step", "created", "answer_content"),
                              "project", project)
    return L.first_project_step(latest)


def last_section_by_tag(answers: DataFrame, project: int | None = None) -> DataFrame:
    """Per ``(project, tag)`` of the project answer: the content of the last occurrence."""
    secs = SEC.explode_sections(_first_project_answers(answers, project), "answer_content", ["project"])
    return secs.groupBy("project", "tag").agg(F.max_by("content", "ord").alias("content"))


def summary_body(text) -> F.Column:
    """``"\\n{content}\\n"`` for each present summary tag (last occurrence wins), in summary order."""
    secs = T.extract_sections(text)

    def is_tag(t):
        return lambda s: s["tag"] == F.lit(t)

    parts = []
    for tag in S.SUMMARY_TAG_ORDER:
        hits = F.filter(secs, is_tag(tag))
        last = F.element_at(hits, -1)["content"]
        parts.append(F.when(F.size(hits) > 0, F.concat(F.lit("\n"), last, F.lit("\n"))))
    return F.concat_ws("", *parts)


def project_summary(answers: DataFrame, projects: DataFrame, project: int | None = None) -> DataFrame:
    """``"ИТОГОВЫЕ РЕЗУЛЬТАТЫ ПО ПРОЕКТУ {name}"`` + the present summary sections.

    Uses only the lowest-step latest project answer; a project without one has
    no row.  Built per row from that answer; ``keywords`` and ``reflections``
    are not in the summary order and are left out.
    """
    first = _first_project_answers(answers, project)
    names = projects.select(F.col("project_id").alias("project"), "project_name")
    return (first.join(names, "project")
            .select("project", "project_name",
                    F.concat(F.lit(S.SUMMARY_HEADER), F.col("project_name"),
                             summary_body("answer_content")).alias("summary")))


def report_blocks(answers: DataFrame, projects: DataFrame) -> DataFrame:
    """Both reports as ordered blocks: ``(project, project_name, report_type, block_no, text)``."""
    names = projects.select(F.col("project_id").alias("project"), "project_name")
    interviews = (interviews_report(answers).join(names, "project")
                  .select("project", "project_name", F.lit("interviews").alias("report_type"),
                          F.col("report_no").alias("block_no"), F.col("report_block").alias("text")))
    summary = (project_summary(answers, projects)
               .select("project", "project_name", F.lit("summary").alias("report_type"),
                       F.lit(1).cast("bigint").alias("block_no"), F.col("summary").alias("text")))
    return interviews.unionByName(summary)
