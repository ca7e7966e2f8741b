"""Replay tests for requests, chaining, failure isolation and the pandas responder."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import functions as F

from fieldwork import schemas as S
from fieldwork.operators import scoring as SC


def _interviews(spark):
    return spark.createDataFrame([(5, 1, "five"), (8, 1, "eight")], "interview_id long, project long, content string")


def _recorded(spark, holes=()):
    rows = []
    for iv in (5, 8):
        for step in range(1, 6):
            if (iv, step) in holes:
                continue
            rows.append((1, iv, step, f"ans {iv}/{step}", "m", 10, 2))
    return spark.createDataFrame(rows, "project long, interview long, analysis_step int, answer_content string, "
                                       "model string, input_tokens int, output_tokens int")


def test_requests_cover_every_step_in_order(spark):
    reqs = SC.scoring_requests(_interviews(spark)).collect()
    assert len(reqs) == 10
    steps = sorted((r["interview"], r["call_no"], r["analysis_step"]) for r in reqs)
    assert [s[2] for s in steps[:5]] == [1, 2, 3, 4, 5]
    temps = {r["analysis_step"]: r["temperature"] for r in reqs}
    assert temps[1] == S.DEFAULT_TEMPERATURE and temps[5] == 0.5
    assert all(r["template"].endswith(S.LANGUAGE_SUFFIX) for r in reqs)


def test_chain_passes_previous_answer(spark):
    replay = SC.replay_responder(_recorded(spark))

    def respond(requests):  # shows the prompt it was asked as the model's name
        return replay(requests).withColumn("response", F.col("response").withField("model", F.col("prompt")))

    answers, dead = SC.chained_steps(_interviews(spark), respond)
    rows = {(r["interview"], r["analysis_step"]): r for r in answers.collect()}
    assert len(rows) == 10 and dead.count() == 0
    assert "ans 5/1" in rows[(5, 2)]["model"]
    assert "ans 5/4" in rows[(5, 5)]["model"]
    assert "ans 5/2" not in rows[(5, 3)]["model"]  # step 3 does not use the previous answer
    # the step tables hold a digest of the prompt, never the prompt
    assert "prompt" not in answers.columns
    assert all(r["prompt_hash"] == hashlib.sha256(r["model"].encode()).hexdigest() for r in rows.values())


def test_hole_stops_only_that_interview(spark):
    answers, dead = SC.chained_steps(_interviews(spark), SC.replay_responder(_recorded(spark, {(5, 2)})))
    got = sorted((r["interview"], r["analysis_step"]) for r in answers.collect())
    assert got == [(5, 1)] + [(8, s) for s in range(1, 6)]
    assert [(r["interview"], r["analysis_step"]) for r in dead.collect()] == [(5, 2)]


def test_answer_rows_project_usage(spark):
    reqs = SC.render_requests(SC.scoring_requests(_interviews(spark)), None)
    scored = SC.batch_score(reqs, SC.replay_responder(_recorded(spark)))
    rows = SC.answer_rows(scored).collect()
    assert len(rows) == 10
    assert {(r["model"], r["input_tokens"], r["output_tokens"]) for r in rows} == {("m", 10, 2)}
    assert all(r["id"] is None for r in rows)  # the append gives out the numbers


def _flaky_factory():
    # a closure, so the worker receives it by value
    def make_client():
        def call(req):
            if req["interview"] == 8 and req["analysis_step"] == 3:
                raise RuntimeError("boom")
            return {"content": f"c{req['interview']}/{req['analysis_step']}", "model": "fake",
                    "input_tokens": len(req["prompt"]), "output_tokens": 1}
        return call
    return make_client


def test_pandas_responder_isolates_errors(spark):
    _flaky_client = _flaky_factory()
    reqs = SC.render_requests(SC.scoring_requests(_interviews(spark)), None)
    out = SC.batch_score(reqs, SC.pandas_responder(_flaky_client, partitions=2)).collect()
    errors = [(r["interview"], r["analysis_step"]) for r in out if r["error"]]
    assert errors == [(8, 3)]
    assert all(r["content"] for r in out if not r["error"])


def test_pandas_responder_throttle(spark):
    _flaky_client = _flaky_factory()
    reqs = SC.render_requests(SC.scoring_requests(_interviews(spark)), None).coalesce(1)
    t0 = time.monotonic()
    n = SC.batch_score(reqs, SC.pandas_responder(_flaky_client, min_interval_s=0.05, partitions=1)).count()
    assert n == 10 and time.monotonic() - t0 >= 9 * 0.05


def test_project_requests_chunk_by_budget(spark):
    blocks = spark.createDataFrame([(1, i, "x" * 40) for i in range(1, 11)] + [(2, 1, "y")],
                                   "project long, block_no long, text string")
    reqs = SC.project_requests(SC.chunk_texts(blocks, 100)).collect()
    by = sorted((r["project"], r["chunk_no"], r["input_chars"]) for r in reqs)
    assert by == [(1, 1, 120), (1, 2, 80), (1, 3, 120), (1, 4, 80), (2, 1, 1)]
    first = [r for r in reqs if r["project"] == 1 and r["chunk_no"] == 1][0]
    assert first["content"] == "x" * 120 and first["analysis_type"] == "project"


def test_pandas_responder_concurrency_keeps_rows(spark):
    def factory():
        def make_client():
            def call(req):
                time.sleep(0.05)
                return {"content": f"c{req['interview']}/{req['analysis_step']}", "model": "fake",
                        "input_tokens": 1, "output_tokens": 1}
            return call
        return make_client

    reqs = SC.render_requests(SC.scoring_requests(_interviews(spark)), None)
    t0 = time.monotonic()
    out = SC.batch_score(reqs, SC.pandas_responder(factory(), partitions=1, concurrency=5)).collect()
    elapsed = time.monotonic() - t0
    assert sorted((r["interview"], r["analysis_step"], r["content"]) for r in out) == \
        sorted((iv, st, f"c{iv}/{st}") for iv in (5, 8) for st in range(1, 6))
    assert elapsed < 10 * 0.05 + 5  # generous: the calls overlap


def test_project_chunks_match_sql_across_range_pieces(spark):

    from conftest import SF_SMALL
    from fieldwork.operators import reports as R
    from fieldwork.plans import queries as QQ
    from fieldwork.sources import tables as TB
    from oracle_check import duck_conn

    budget = 3_000
    blocks = R.interviews_report(TB.answers_fixture(spark, SF_SMALL)).select(
        "project", F.col("report_no").alias("block_no"), F.col("report_block").alias("text"))
    got = sorted((r["project"], r["chunk_no"], r["input_chars"], len(r["content"]))
                 for r in SC.project_requests(SC.chunk_texts(blocks, budget)).collect())
    sql = TB.with_fixtures(f"""with {QQ._REPORT_CTES},
sized as (select project, report_no, report_block, length(report_block) as len,
  sum(length(report_block)) over (partition by project order by report_no
                                  rows between unbounded preceding and current row) as e from report)
select project, cast(floor((e - len) / {budget}) + 1 as bigint) as chunk_no, sum(len) as input_chars,
       length(string_agg(report_block, '' order by report_no)) as n
from sized group by 1, 2""")
    expected = sorted(tuple(int(x) for x in r) for r in duck_conn(SF_SMALL).sql(sql).fetchall())
    assert got == expected and max(c for _, c, _, _ in got) > 1


def test_throttle_leaves_no_turn_unused(spark):
    def make_client():
        return lambda req: {"content": "x", "model": "m", "input_tokens": 1, "output_tokens": 1}

    slots = spark.sparkContext.defaultParallelism
    reqs = SC.render_requests(SC.scoring_requests(_interviews(spark)), None)
    asked = SC.pandas_responder(make_client, min_interval_s=0.001, partitions=20 * slots)(reqs)
    assert asked.rdd.getNumPartitions() == slots  # more would wait for a core while their turns pass
    assert asked.count() == 10
