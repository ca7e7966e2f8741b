"""Whole-project answers, runs that stop and start again, commits, keys and pacing."""

from __future__ import annotations

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from fieldwork import schemas as S
from fieldwork.operators import reports as R
from fieldwork.operators import scoring as SC
from fieldwork.operators.store import validated_append, with_new_keys
from fieldwork.plans.job import Store, run_job
from fieldwork.sources.files import ingest_text


SHORT_PLAN = [p for p in S.QUESTION_PLAN if p["analysis_type"] == "project" or p["analysis_step"] <= 2]


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _namer():
    """Names the blocks that it saw in the prompt."""
    def make():
        def call(req):
            import re
            seen = sorted(set(re.findall(r"block\d+", req["prompt"])))
            return {"content": f"<results>{' '.join(seen)}</results>", "model": "m", "input_tokens": 1, "output_tokens": 1}
        return call
    return make


def _blocks(spark, n, project=1):
    return spark.createDataFrame([(project, i, f"block{i} ") for i in range(1, n + 1)], "project long, block_no long, text string")


@pytest.mark.parametrize("n,budget", [(6, 7), (6, 10_000), (11, 60)])
def test_the_summary_covers_every_block(spark, n, budget):
    calls = SC.project_score(_blocks(spark, n), SC.pandas_responder(_namer()), budget_chars=budget)
    row = SC.project_answers(calls).withColumn("summary", R.summary_body("content")).collect()
    assert len(row) == 1
    assert set(row[0]["summary"].split()) == {f"block{i}" for i in range(1, n + 1)}
    if budget > 8 * n:
        assert row[0]["calls"] == 1 and row[0]["levels"] == 1  # one request over everything, as ever


def test_levels_keep_projects_apart_and_stop_at_failures(spark):
    blocks = _blocks(spark, 9).unionByName(_blocks(spark, 1, 2)).unionByName(_blocks(spark, 5, 3))

    namer = _namer()

    def make():
        inner = namer()

        def call(req):
            if req["project"] == 3 and "block4" in req["prompt"]:
                raise RuntimeError("no answer")
            return inner(req)
        return call

    calls = SC.project_score(blocks, SC.pandas_responder(make), budget_chars=7).cache()
    rows = {r["project"]: r for r in SC.project_answers(calls).collect()}
    assert set(rows) == {1, 2, 3}
    assert all(f"block{i}" in rows[1]["content"] for i in range(1, 10)) and rows[1]["levels"] > 2
    assert rows[2]["levels"] == 1 and rows[2]["content"] == "<results>block1</results>"
    assert "no answer" in rows[3]["error"] and rows[3]["content"] is None and rows[3]["levels"] == 1
    assert SC.project_score(blocks.limit(0), SC.pandas_responder(_namer())).count() == 0


# ------------------------------------------------------------------ a second start

def _logging_client(folder, poison=None, others=0):
    """Leaves a file per call; at the poisoned interview it kills its task after ``others`` files are there."""
    def make():
        def call(req):
            import os
            import time
            import uuid
            if poison is not None and (req["interview"], req["analysis_step"]) == poison:
                end = time.time() + 60
                while time.time() < end and len(os.listdir(folder)) < others:
                    time.sleep(0.1)
                time.sleep(3)  # the other tasks end
                raise SystemExit(1)
            with open(f"{folder}/{req['analysis_step']}-{req['interview']}-{uuid.uuid4().hex}", "w") as f:
                f.write("")
            return {"content": f"a{req['analysis_step']}", "model": "m", "input_tokens": 1, "output_tokens": 1}
        return call
    return make


def test_a_second_start_asks_only_what_has_no_answer(spark, tmp_dir):
    logs, run = os.path.join(tmp_dir, "calls"), os.path.join(tmp_dir, "run")
    os.makedirs(logs)
    interviews = spark.createDataFrame([(i, 1, f"text {i}") for i in range(1, 9)], "interview_id long, project long, content string")
    # the task that holds interview 5 dies in step 2 after the 15 other calls of steps 1 and 2
    with pytest.raises(Exception):
        SC.chained_steps(interviews, SC.pandas_responder(_logging_client(logs, (5, 2), 15), partitions=8), SHORT_PLAN, run_path=run)
    first = os.listdir(logs)
    assert len([f for f in first if f.startswith("1-")]) == 8 and len(first) == 15
    answers, dead = SC.chained_steps(interviews, SC.pandas_responder(_logging_client(logs), partitions=8), SHORT_PLAN, run_path=run)
    assert answers.count() == 8 * 2 and dead.count() == 0
    made = [f.rsplit("-", 1)[0] for f in os.listdir(logs)]
    again = [f for f in made if made.count(f) > 1]
    # of step 2 only the requests of the dead task's partition can be asked twice; with one request each, none is
    assert not again and len(made) == 16
    # a third start calls nobody, and a changed text is asked anew
    SC.chained_steps(interviews, SC.pandas_responder(_logging_client(logs), partitions=8), SHORT_PLAN, run_path=run)[0].count()
    assert len(os.listdir(logs)) == 16
    changed = interviews.withColumn("content", F.when(F.col("interview_id") == 3, "new text").otherwise(F.col("content")))
    answers, _ = SC.chained_steps(changed, SC.pandas_responder(_logging_client(logs), partitions=8), SHORT_PLAN, run_path=run)
    assert answers.count() == 16 and len(os.listdir(logs)) == 18


def test_errors_are_asked_again(spark, tmp_dir):
    interviews = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "interview_id long, project long, content string")
    plan = [p for p in S.QUESTION_PLAN if p["analysis_type"] == "interview" and p["analysis_step"] <= 2]

    def client(fails):
        def make():
            def call(req):
                if fails and req["interview"] == 2:
                    raise RuntimeError("later")
                return {"content": f"a{req['interview']}", "model": "m", "input_tokens": 1, "output_tokens": 1}
            return call
        return make

    _, dead = SC.chained_steps(interviews, SC.pandas_responder(client(True)), plan, run_path=f"{tmp_dir}/run")
    assert [(r["interview"], r["analysis_step"]) for r in dead.collect()] == [(2, 1)]
    answers, dead = SC.chained_steps(interviews, SC.pandas_responder(client(False)), plan, run_path=f"{tmp_dir}/run")
    assert dead.count() == 0
    assert sorted((r["interview"], r["analysis_step"], r["content"]) for r in answers.collect()) == [
        (1, 1, "a1"), (1, 2, "a1"), (2, 1, "a2"), (2, 2, "a2")]


# ------------------------------------------------------------------ commits

def _fake():
    def make():
        def call(req):
            return {"content": f"<results>{req['analysis_type']}</results>", "model": "m", "input_tokens": 1, "output_tokens": 1}
        return call
    return SC.pandas_responder(make, partitions=2)


def test_a_run_shows_all_of_its_tables_or_none(spark, tmp_dir, monkeypatch):
    raw, root = os.path.join(tmp_dir, "raw"), os.path.join(tmp_dir, "store")
    _write(f"{raw}/alpha/1.txt", "one")
    run_job(spark, Store(spark, root), raw, save_files=True, process_interviews=True, responder=_fake(), plan=SHORT_PLAN)
    before = {t: Store(spark, root).read(t).count() for t in Store.SCHEMAS}
    assert before == {"projects": 1, "interviews": 1, "llm_answers": 2, "rejects": 0}

    _write(f"{raw}/beta/2.txt", "two")
    plain = Store.append

    def stops(self, df, table):
        if table == "llm_answers":
            raise RuntimeError("driver lost")
        plain(self, df, table)

    monkeypatch.setattr(Store, "append", stops)
    with pytest.raises(RuntimeError):
        run_job(spark, Store(spark, root), raw, save_files=True, process_interviews=True, responder=_fake(), plan=SHORT_PLAN)
    monkeypatch.undo()
    # projects, interviews and all model calls of the run were written, but nothing is visible
    assert {t: Store(spark, root).read(t).count() for t in Store.SCHEMAS} == before
    assert len(os.listdir(f"{root}/data/interviews")) > 1 and os.listdir(f"{root}/runs") == ["2"]

    asked = []

    def no_model(requests):
        asked.append(requests.count())
        return _fake()(requests)

    run_job(spark, Store(spark, root), raw, save_files=True, process_interviews=True, responder=no_model, plan=SHORT_PLAN)
    assert asked == [0] * 2  # every answer of the stopped run was kept
    store = Store(spark, root)
    assert {t: store.read(t).count() for t in Store.SCHEMAS} == {"projects": 2, "interviews": 2, "llm_answers": 6, "rejects": 0}
    # what the stopped run left is gone: folders are those of the manifest, and no answers are kept
    listed = {(r["table"], r["folder"]) for r in store._newest()[1]}
    assert {(t, f) for t in Store.SCHEMAS for f in os.listdir(f"{root}/data/{t}")} == listed
    assert os.listdir(f"{root}/runs") == []


def test_a_reader_keeps_its_version_and_old_manifests_go(spark, tmp_dir):
    store = Store(spark, os.path.join(tmp_dir, "store"))
    names = [spark.createDataFrame([(i, f"p{i}")], S.PROJECTS_SCHEMA) for i in range(1, 6)]
    store.append(names[0], "projects")
    old = Store(spark, store.root).read("projects")
    for df in names[1:]:
        store.append(df, "projects")
    assert old.count() == 1 and store.read("projects").count() == 5 and store.top("projects") == 5
    assert sorted(os.path.basename(p) for p in glob.glob(f"{store.root}/manifests/version=*")) == ["version=4", "version=5"]


# ------------------------------------------------------------------ keys

def test_equal_rows_get_different_keys_and_runs_share_none(spark, tmp_dir):
    row = {"project": 1, "analysis_type": "interview", "created": None, "model": "m", "input_tokens": 1, "output_tokens": 1, "prompt": "p"}
    schema = "project long, analysis_type string, created timestamp_ntz, model string, input_tokens int, output_tokens int, prompt string"
    rows = spark.createDataFrame([row] * 40, schema).repartition(3)
    store = Store(spark, os.path.join(tmp_dir, "store"))
    store.append(spark.createDataFrame([(1, "p")], S.PROJECTS_SCHEMA), "projects")
    for _ in range(2):
        store.append_valid(rows, "llm_answers")
    ids = [r["id"] for r in store.read("llm_answers").collect()]
    assert sorted(ids) == list(range(1, 81))
    unknown = rows.withColumn("project", F.lit(9))
    store.append_valid(unknown, "llm_answers")  # a required link
    assert store.read("rejects").where("reason = 'project unknown'").count() == 40 and store.read("llm_answers").count() == 80
    for _ in range(2):
        assert validated_append(rows, "llm_answers", f"{tmp_dir}/plain").count() == 0
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_dir}/plain").collect()) == list(range(1, 81))


def test_given_keys_are_kept_and_new_ones_lie_above(spark):
    rows = spark.createDataFrame([(7, "x"), (None, "b"), (None, "a"), (None, "b"), (30, "y")], "id long, t string").repartition(2)
    got, top = with_new_keys(rows, "id", 12, ["t"])
    assert top == 33 and sorted(tuple(r) for r in got.collect()) == [(7, "x"), (30, "y"), (31, "a"), (32, "b"), (33, "b")]
    none, top = with_new_keys(rows.limit(0), "id", 12)
    assert none.collect() == [] and top == 12


def test_files_are_numbered_across_runs(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    for i in range(5):
        _write(f"{raw}/p/{i}.txt", "same words")
    good, _ = ingest_text(spark, raw, top=10)
    assert [r["interview_id"] for r in good.orderBy("path").collect()] == [11, 12, 13, 14, 15]
    store = Store(spark, os.path.join(tmp_dir, "store"))
    run_job(spark, store, raw, save_files=True)
    _write(f"{raw}/p/00.txt", "same words")
    run_job(spark, store, raw, save_files=True)
    ids = {os.path.basename(r["path"]): r["interview_id"] for r in store.read("interviews").collect()}
    assert ids == {"0.txt": 1, "1.txt": 2, "2.txt": 3, "3.txt": 4, "4.txt": 5, "00.txt": 6}


# ------------------------------------------------------------------ pacing

def test_turns_of_different_clients_never_meet():
    rnd = random.Random(1)
    starts = []
    for client in range(4):
        now, last = 1000.0 + rnd.random(), 0.0
        for _ in range(50):
            last = SC.next_turn(now, last, 0.5, 4, client)
            assert last >= now
            starts.append(last)
            now = last + rnd.random() * 3  # calls of any length
    starts.sort()
    assert min(b - a for a, b in zip(starts, starts[1:])) > 0.499


def test_all_partitions_together_keep_the_pause(spark, tmp_dir):
    logs = os.path.join(tmp_dir, "starts")
    os.makedirs(logs)

    def make():
        def call(req):
            import time
            with open(f"{logs}/{time.time():.6f}", "w") as f:
                f.write("")
            time.sleep(0.25)
            return {"content": "c", "model": "m", "input_tokens": 1, "output_tokens": 1}
        return call

    interviews = spark.createDataFrame([(i, 1, "t") for i in range(4)], "interview_id long, project long, content string")
    reqs = SC.render_requests(SC.scoring_requests(interviews), None)
    t0 = time.time()
    assert SC.batch_score(reqs, SC.pandas_responder(make, min_interval_s=0.2, partitions=4, concurrency=2)).count() == 20
    starts = sorted(float(f) for f in os.listdir(logs))
    assert len(starts) == 20 and min(b - a for a, b in zip(starts, starts[1:])) > 0.1  # 0.2 less the delay of waking up
    assert time.time() - t0 < 60
