"""Plan-shape guards: the physical plans keep the properties the scale design relies on."""

from __future__ import annotations

import pytest

from conftest import SF_SMALL
from fieldwork.plans.queries import queries

QS = queries()

# queries without eager side effects (no writes, streams or checkpoints while building)
PURE = ["answers_filter", "latest_interview_answer", "latest_project_answer", "first_project_step",
        "previous_answer", "last_content_by_id", "concat_answers", "extract_sections", "normalise_lines",
        "label_sections", "last_section_by_tag", "project_summary", "scoring_requests", "render_prompt",
        "batch_score", "usage_metadata", "page_text_assembly", "param_sql", "validated_append",
        "section_items", "keyword_topk", "problem_mentions", "item_connections", "theme_frequency",
        "clean_text", "anonymise", "text_blocks", "usage_stats", "answer_categories", "project_trends"]


def _plan(spark, key):
    df = QS[key](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", PURE)
def test_no_cartesian_or_nested_loop_join(spark, key):
    plan = _plan(spark, key)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan  # no Python UDF


def test_latest_version_is_reduced_before_the_shuffle(spark):
    plan = _plan(spark, "latest_interview_answer")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_summary_filter_reaches_the_scan(spark):
    plan = _plan(spark, "project_summary")
    assert "PushedFilters" in plan and "EqualTo(role,system)" in plan


def test_keyword_topk_tokenises_in_one_pass(spark):
    from fieldwork.operators.insights import token_counts
    from fieldwork.sources.tables import load
    docs = load(spark, SF_SMALL, "documents").selectExpr("source as project", "doc_id as interview", "text as content")
    counts = token_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in counts and counts.count("split(") == 1
    plan = _plan(spark, "keyword_topk")  # frequencies and scores read the counts
    assert "split(" not in plan and "text:string" not in plan and plan.count("ReadSchema: struct<project:string,interview:bigint,token:string,tf:bigint>") == 1


def test_keyword_topk_tasks_grow_with_the_input(spark):
    from collections import Counter
    from math import log

    from fieldwork.operators.insights import keyword_topk, token_counts
    texts = {(p, i): " ".join(["the"] * (i % 3 + 1) + [f"w{'abcdefghij'[j % 10]}{'klmnop'[(i + j) % 6]}" for j in range(i % 17)])
             for p in ("a", "b") for i in range(40)}
    docs = spark.createDataFrame([(*k, t) for k, t in texts.items()] + [("a", 99, None), (None, 1, "lost")], "project string, interview long, content string")
    assert token_counts(docs, 9).rdd.getNumPartitions() == 9
    n = Counter(p for p, _ in texts)
    n["a"] += 1
    tf = {k: Counter(t.split()) for k, t in texts.items()}
    df = Counter((p, w) for (p, _), c in tf.items() for w in c)
    want = []
    for (p, i), c in tf.items():
        best = sorted((-x * (log((n[p] + 1) / (df[p, w] + 1)) + 1), w, x) for w, x in c.items())[:3]
        want += [(p, i, r, w, x, df[p, w], round(-s, 6)) for r, (s, w, x) in enumerate(best, 1)]
    for interviews in (10 ** 6, 7):  # a token's rows in one task, and in several
        got = keyword_topk(docs, 3, piece_chars=100, piece_counts=20, piece_interviews=interviews)
        assert got.rdd.getNumPartitions() > 8  # the session has 4 shuffle partitions
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
