"""From latest answers to tagged sections and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwork import schemas as S
from fieldwork.functions import text as T


def concat_answers(latest: DataFrame) -> DataFrame:
    """One text per interview: its latest answers joined by ``\\n`` in step order.

    ``NULL`` answers are skipped and ``''`` is kept (a blank line).  The group is
    one interview's steps, bounded by the plan.
    """
    return (latest.groupBy("project", "interview")
            .agg(F.expr("listagg(answer_content, '\\n') within group (order by analysis_step)")
                 .alias("answers_text")))


def explode_sections(df: DataFrame, text_col: str, keys: list[str],
                     tags=S.TAGS) -> DataFrame:
    """``(keys..., ord, tag, content)``: one row per match, ``ord`` 1-based in match order.

    Extraction runs on the whole text (after concatenation), so a tag opened in
    one step and closed in a later one is still found.
    """
    return (df.select(*keys, F.posexplode(T.extract_sections(text_col, tags)).alias("_pos", "_s"))
            .select(*keys, (F.col("_pos") + 1).cast("int").alias("ord"),
                    F.col("_s.tag").alias("tag"), F.col("_s.content").alias("content")))


def interview_sections(latest: DataFrame) -> DataFrame:
    """``sections(project, interview, ord, tag, content)`` for interview answers."""
    return explode_sections(concat_answers(latest), "answers_text", ["project", "interview"])


def with_processed(sections: DataFrame) -> DataFrame:
    return sections.withColumn("processed", T.normalise_lines("content"))


def with_labels(sections: DataFrame) -> DataFrame:
    """Adds ``block = "\\n{label}\\n{processed}\\n"``; the label lookup is a constant map."""
    return sections.withColumn("block", T.labelled_block("tag", T.normalise_lines("content")))


def section_items(sections: DataFrame) -> DataFrame:
    """One row per non-blank line of a section: ``(..., ord, tag, item_no, item)``."""
    keys = [c for c in sections.columns if c not in ("content", "processed", "block")]
    return (sections.select(*keys, F.posexplode(T.item_lines("content")).alias("_i", "item"))
            .select(*keys, (F.col("_i") + 1).cast("int").alias("item_no"), "item"))
