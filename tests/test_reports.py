"""Latest-version rule, concatenation order, interviews report and project summary."""

from __future__ import annotations

import datetime as dt

from fieldwork.operators import latest as L
from fieldwork.operators import reports as R
from fieldwork.operators import sections as SEC

SCHEMA = ("id long, project long, interview long, analysis_type string, analysis_step int, "
          "created timestamp_ntz, answer_content string")
T0 = dt.datetime(2024, 1, 1)


def answers(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_latest_tie_break_on_id(spark):
    df = answers(spark, [(7, 1, 5, "interview", 1, T0, "old"), (9, 1, 5, "interview", 1, T0, "new"),
                         (3, 1, 5, "interview", 1, T0 - dt.timedelta(1), "older")])
    got = L.latest_answers(df).collect()
    assert [(r["id"], r["answer_content"]) for r in got] == [(9, "new")]


def test_latest_later_created_wins_over_id(spark):
    df = answers(spark, [(9, 1, 5, "interview", 1, T0, "a"), (2, 1, 5, "interview", 1, T0 + dt.timedelta(1), "b")])
    assert L.latest_answers(df).first()["answer_content"] == "b"


def test_concat_skips_null_keeps_empty_orders_by_step(spark):
    df = answers(spark, [(1, 1, 5, "interview", 10, T0, "c"), (2, 1, 5, "interview", 1, T0, "a"),
                         (3, 1, 5, "interview", 2, T0, None), (4, 1, 5, "interview", 3, T0, "")])
    assert SEC.concat_answers(df).first()["answers_text"] == "a\n\nc"


def test_interviews_report_golden(spark):
    df = answers(spark, [(1, 1, 5, "interview", 1, T0, "<codes>- a\n- b</codes>"),
                         (2, 1, 8, "interview", 1, T0, "no tags here")])
    blocks = R.interviews_report(df).orderBy("report_no").collect()
    assert [b["report_no"] for b in blocks] == [1, 2]
    text = "".join(b["report_block"] for b in blocks)
    assert text == "\nИНТЕРВЬЮ № 1\nКодирование интервью:\na. b.\n\nИНТЕРВЬЮ № 2"


def test_interviews_report_null_answer_keeps_header(spark):
    df = answers(spark, [(1, 1, 5, "interview", 1, T0, None)])
    assert R.interviews_report(df).first()["report_block"] == "\nИНТЕРВЬЮ № 1"


def test_project_summary_golden(spark):
    text = "<keywords>k</keywords><problems>x</problems><results>r</results><problems>y</problems>"
    df = answers(spark, [(1, 1, None, "project", 1, T0, text)])
    projects = spark.createDataFrame([(1, "p")], "project_id long, project_name string")
    got = R.project_summary(df, projects).first()["summary"]
    assert got == "ИТОГОВЫЕ РЕЗУЛЬТАТЫ ПО ПРОЕКТУ p\nr\n\ny\n"


def test_project_summary_uses_lowest_step_only(spark):
    df = answers(spark, [(1, 1, None, "project", 2, T0, "<results>two</results>"),
                         (2, 1, None, "project", 1, T0, "<results>one</results>")])
    projects = spark.createDataFrame([(1, "p")], "project_id long, project_name string")
    assert R.project_summary(df, projects).first()["summary"].endswith("\none\n")


def test_no_summary_no_row(spark):
    df = answers(spark, [(1, 1, 3, "interview", 1, T0, "<results>x</results>")])
    projects = spark.createDataFrame([(1, "p")], "project_id long, project_name string")
    assert R.project_summary(df, projects).count() == 0


def test_rerun_changes_only_that_step(spark):
    base = [(1, 1, 5, "interview", 1, T0, "<codes>a</codes>"), (2, 1, 5, "interview", 2, T0, "<code_groups>g</code_groups>")]
    before = {r["analysis_step"]: r["answer_content"] for r in L.latest_answers(answers(spark, base)).collect()}
    rerun = base + [(3, 1, 5, "interview", 2, T0 + dt.timedelta(hours=1), "<code_groups>h</code_groups>")]
    after = {r["analysis_step"]: r["answer_content"] for r in L.latest_answers(answers(spark, rerun)).collect()}
    assert before[1] == after[1] and after[2] == "<code_groups>h</code_groups>"
