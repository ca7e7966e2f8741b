"""Faults found in review: lost chunk answers, project step chaining, failures, casts, names, duplicates."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from fieldwork.operators import scoring as SC
from fieldwork.operators.store import project_interviews, validate_rows, validated_append, with_new_keys
from fieldwork.plans.job import Store, run_job
from fieldwork.sources.files import ingest_text
from fieldwork.sources.sinks import read_reports, write_reports

TWO_STEPS = [
    {"analysis_type": "project", "analysis_step": 1, "llm_temperature": None, "uses_previous": False,
     "input_variables": ["raw_interview"], "text_template": "A {raw_interview}"},
    {"analysis_type": "project", "analysis_step": 2, "llm_temperature": None, "uses_previous": True,
     "input_variables": ["previous_answers"], "text_template": "B {previous_answers}"},
]


def _client(fail_step=None):
    def make():
        def call(req):
            if req["analysis_step"] == fail_step:
                raise RuntimeError("no model")
            return {"content": f"[{req['prompt'][:20]}]", "model": "m", "input_tokens": 1, "output_tokens": 1}
        return call
    return make


def _blocks(spark, n=6):
    return spark.createDataFrame([(1, i, f"block{i} ") for i in range(1, n + 1)], "project long, block_no long, text string")


def test_all_chunk_answers_reach_the_project_answer(spark):
    calls = SC.project_score(_blocks(spark), SC.pandas_responder(_client()), TWO_STEPS[:1], budget_chars=7)
    assert calls.where("level = 0").count() == 6
    row = SC.project_answers(calls).collect()
    assert len(row) == 1 and row[0]["input_tokens"] == row[0]["calls"] == calls.count()


def test_project_steps_are_chained_at_one_chunk_and_many(spark):
    for budget in (7, 1000):
        calls = SC.project_score(_blocks(spark), SC.pandas_responder(_client()), TWO_STEPS, budget_chars=budget).collect()
        first = [r["content"] for r in calls if r["analysis_step"] == 1]
        got = [r["content"] for r in calls if r["analysis_step"] == 2]
        assert got and all(c.startswith("[B [A") for c in got), (first, got)


def test_failed_project_step_fails_the_answer_and_the_next_step(spark):
    calls = SC.project_score(_blocks(spark), SC.pandas_responder(_client(fail_step=1)), TWO_STEPS, budget_chars=7)
    rows = {r["analysis_step"]: r["error"] for r in SC.project_answers(calls).collect()}
    assert "no model" in rows[1] and rows[2] == "previous step missing"


def test_job_keeps_chunks_and_writes_project_failures_to_rejects(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    for i in range(3):
        os.makedirs(f"{raw}/a+b", exist_ok=True)
        with open(f"{raw}/a+b/{i}.txt", "w") as f:
            f.write(f"text {i}")
    with open(f"{raw}/a+b/bad.txt", "wb") as f:
        f.write(b"\xff\xfe\xff")
    store = Store(spark, os.path.join(tmp_dir, "store"))

    def make():
        def call(req):
            body = "<results>\n" + str(len(req["prompt"])) + "\n</results>" if req["analysis_type"] == "project" else "<codes>x</codes>"
            return {"content": body, "model": "m", "input_tokens": 2, "output_tokens": 1}
        return call

    responder = SC.pandas_responder(make)
    run_job(spark, store, raw, save_files=True, process_interviews=True, process_project=True, responder=responder,
            project_responder=responder, project_budget_chars=10)
    answers = store.read("llm_answers").where("analysis_type = 'project'").collect()
    # three chunks, then two answers in one call, then that and the third
    assert len(answers) == 1 and answers[0]["answer_content"].count("<results>") == 1 and answers[0]["input_tokens"] == 2 * 5
    assert {r["project_name"] for r in store.read("projects").collect()} == {"a+b"}
    assert store.read("rejects").count() == 1
    run_job(spark, store, raw, save_files=True, process_project=True, project_responder=SC.pandas_responder(_client(fail_step=1)))
    assert store.read("rejects").where("reason = 'invalid utf-8'").count() == 1  # a rerun adds no second reject
    assert store.read("rejects").where("source = 'llm_answers'").count() == 1


def test_names_survive_ingest_and_sink(spark, tmp_dir):
    names = ["a+b", "50%", "007", "дом"]
    (spark.createDataFrame([(n, "text " + n) for n in names], "project string, text string")
     .write.partitionBy("project").text(f"{tmp_dir}/hive"))
    good, bad = ingest_text(spark, f"{tmp_dir}/hive", layout="hive")
    assert {r["project_name"]: r["content"] for r in good.collect()} == {n: "text " + n for n in names} and bad.count() == 0
    blocks = spark.createDataFrame([(n, "summary", 1, n) for n in names], "project_name string, report_type string, block_no long, text string")
    rows = read_reports(spark, write_reports(blocks, f"{tmp_dir}/out")).collect()
    assert {(r["project_name"], r["value"]) for r in rows} == {(n, n) for n in names}


def test_append_rejects_bad_casts_and_unknown_projects_and_assigns_ids(spark, tmp_dir):
    rows = spark.createDataFrame(
        [("1", "1", "ok"), ("1", "x", "bad number"), ("9", "1", "no project"), ("1", "2", " ")],
        "project string, input_tokens string, prompt string").withColumn("analysis_type", F.lit("interview")) \
        .withColumn("model", F.lit("m")).withColumn("output_tokens", F.lit(1))
    projects = spark.createDataFrame([(1, "p")], "project_id long, project_name string")
    rejects = validated_append(rows, "llm_answers", f"{tmp_dir}/t", projects)
    assert {r["reason"] for r in rejects.collect()} == {"input_tokens invalid", "project unknown", "prompt required"}
    assert '"x"' in rejects.where("reason = 'input_tokens invalid'").first()["payload"]
    kept = spark.read.parquet(f"{tmp_dir}/t").collect()
    assert len(kept) == 1 and kept[0]["id"] is not None
    valid, _ = validate_rows(spark.createDataFrame([("p",)], "project_name string"), "projects")
    assert with_new_keys(valid, "project_id", 4)[0].first()["project_id"] == 5


def test_project_interviews_are_distinct(spark):
    rows = spark.createDataFrame([(1, 5, "t"), (1, 5, "t"), (2, 5, "u")], "interview_id long, project long, content string")
    assert project_interviews(rows, 5).count() == 2


def test_text_blocks_are_built_inside_the_row(spark):
    from fieldwork.operators.insights import text_blocks
    docs = spark.createDataFrame([(1, "ab\ncd\n\nefghij"), (1, "x"), (2, ""), (3, None)], "doc_id long, text string")
    blocks = text_blocks(docs, max_chars=6)
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in blocks.collect()) == [
        (1, 0, "ab\ncd", 2), (1, 0, "x", 1), (1, 1, "\nefghij", 2), (2, 0, "", 1)]


def test_files_are_known_by_project_and_path(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw-paths")
    os.makedirs(os.path.join(raw, "p"))
    for name in ("a.txt", "b.txt"):
        with open(os.path.join(raw, "p", name), "w") as f:
            f.write("same words")
    store = Store(spark, os.path.join(tmp_dir, "store-paths"))
    for _ in range(2):
        run_job(spark, store, raw, save_files=True)
    paths = [r["path"] for r in store.read("interviews").collect()]
    assert sorted(os.path.basename(p) for p in paths) == ["a.txt", "b.txt"]
