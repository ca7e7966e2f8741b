"""The stage-switched job end to end (R34): ingest, scoring with a pandas client, reports, reruns."""

from __future__ import annotations

import os

from fieldwork.operators import scoring as SC
from fieldwork.plans.job import Store, run_job


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _client_factory():
    def make_client():
        def call(req):
            step = req["analysis_step"]
            if req["analysis_type"] == "project":
                body = "<results>\nall good\n</results><keywords>k</keywords>"
            elif step == 1:
                body = "<keywords>\n- hello\n</keywords>\n<codes>\n- greeting\n- world\n</codes>"
            else:
                body = f"<problems>\n- issue {step}\n</problems>"
            return {"content": body, "model": "fake", "input_tokens": len(req["prompt"]), "output_tokens": 3}
        return call
    return make_client


def test_job_stages_and_reruns(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    _write(f"{raw}/alpha/i1.txt", "hello world")
    _write(f"{raw}/alpha/i2.txt", "second interview")
    _write(f"{raw}/beta/i3.txt", "third")
    store = Store(spark, os.path.join(tmp_dir, "store"))
    responder = SC.pandas_responder(_client_factory(), partitions=2)

    blocks = run_job(spark, store, raw, save_files=True, process_interviews=True, process_project=True,
                     responder=responder, project_responder=responder,
                     sink_path=os.path.join(tmp_dir, "out"))
    rows = blocks.collect()
    interviews = [r for r in rows if r["report_type"] == "interviews"]
    summaries = {r["project_name"]: r["text"] for r in rows if r["report_type"] == "summary"}
    assert len(interviews) == 3
    assert sorted(summaries) == ["alpha", "beta"]
    assert summaries["alpha"] == "ИТОГОВЫЕ РЕЗУЛЬТАТЫ ПО ПРОЕКТУ alpha\nall good\n"
    first = [r["text"] for r in interviews if r["project_name"] == "alpha" and r["block_no"] == 1][0]
    assert first.startswith("\nИНТЕРВЬЮ № 1\nКлючевые фразы интервью:\nhello.\n\nКодирование интервью:\ngreeting. world.\n")
    assert store.read("llm_answers").count() == 3 * 5 + 2
    assert os.path.isdir(os.path.join(tmp_dir, "out", "project_name=alpha", "report_type=summary"))

    # rerun ingest: every file once; reports only from stored answers
    run_job(spark, store, raw, save_files=True)
    assert store.read("interviews").count() == 3
    assert store.read("projects").count() == 2

    # a new file in an existing project, scored on the next run; earlier answers get a second version
    _write(f"{raw}/alpha/i4.txt", "fourth")
    blocks = run_job(spark, store, raw, save_files=True, process_interviews=True, responder=responder)
    assert store.read("interviews").count() == 4
    assert len([r for r in blocks.collect() if r["report_type"] == "interviews"]) == 4


def test_job_limited_to_named_project(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    _write(f"{raw}/alpha/i1.txt", "hello")
    _write(f"{raw}/beta/i2.txt", "other")
    store = Store(spark, os.path.join(tmp_dir, "store"))
    responder = SC.pandas_responder(_client_factory(), partitions=1)
    blocks = run_job(spark, store, raw, save_files=True, process_interviews=True, responder=responder,
                     project_names=["beta"]).collect()
    assert {r["project_name"] for r in blocks} == {"beta"}
    assert store.read("interviews").count() == 2  # ingest covers the folder tree
    assert store.read("llm_answers").count() == 5  # only beta was scored


def test_job_command_line_ingest(spark, tmp_dir, capsys):
    from fieldwork.plans.job import main
    raw = os.path.join(tmp_dir, "raw")
    _write(f"{raw}/alpha/i1.txt", "hello")
    _write(f"{raw}/beta/i2.txt", "other")
    store_dir = os.path.join(tmp_dir, "store")
    main(["--store", store_dir, "--raw", raw, "--save-files"])
    store = Store(spark, store_dir)
    assert store.read("interviews").count() == 2
    assert sorted(r["project_name"] for r in store.read("projects").collect()) == ["alpha", "beta"]
