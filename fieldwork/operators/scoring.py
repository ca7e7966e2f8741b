"""Batch model scoring: request building, responders, chained steps.

The model call itself is outside Spark.  Around it everything is a Spark job:

* requests = interviews expanded by the plan steps (a literal array, no join);
* a *responder* turns requests into responses.  ``replay_responder`` is an
  equi-join with recorded answers (pure Spark, used by tests and oracles);
  ``pandas_responder`` calls a user client inside ``mapInPandas``, one client per
  partition, with an optional per-partition pause;
* the step loop runs each plan step as ONE distributed batch over all
  interviews, writes its answers to a table in the shared checkpoint folder
  (so a re-evaluation never calls the model twice) and drops interviews whose
  chain broke;
* a project's report is scored in chunks that fit a budget, and the chunks'
  answers are scored again, in groups that fit it, until one answer is left
  (``project_score``);
* with ``run_path`` every call's answer is kept as soon as its task ends, under
  a name that a second start finds: it calls the model only for requests (by
  key and prompt) that have no answer yet (``score_once``).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwork import schemas as S
from fieldwork.functions import text as TX
from fieldwork.operators.numbering import running_total, sequence_number
from fieldwork.session import scratch_path, ship_package

KEY = ["project", "interview", "analysis_step"]


def plan_frame(spark: SparkSession, plan=S.QUESTION_PLAN) -> DataFrame:
    """The question plan as a DataFrame (a handful of rows; safe to broadcast)."""
    return spark.createDataFrame([dict(p) for p in plan], schema=S.PLAN_SCHEMA)


def plan_steps(plan, analysis_type: str) -> list[dict]:
    """Steps of one analysis type in call order (ascending step)."""
    return sorted((p for p in plan if p["analysis_type"] == analysis_type), key=lambda p: p["analysis_step"])


def _plan_array(steps: list[dict]) -> F.Column:
    structs = []
    for call_no, p in enumerate(steps, start=1):
        structs.append(F.struct(
            F.lit(p["analysis_type"]).alias("analysis_type"),
            F.lit(p["analysis_step"]).cast("int").alias("analysis_step"),
            F.lit(call_no).cast("int").alias("call_no"),
            F.lit(p["llm_temperature"]).cast("double").alias("llm_temperature"),
            F.lit(bool(p["uses_previous"])).alias("uses_previous"),
            F.lit(p["text_template"]).alias("text_template")))
    return F.array(*structs)


def scoring_requests(interviews: DataFrame, plan=S.QUESTION_PLAN, analysis_type: str = "interview",
                     suffix: str = S.LANGUAGE_SUFFIX, keep: tuple[str, ...] = (), previous: DataFrame | None = None) -> DataFrame:
    """Every interview x every plan step of ``analysis_type``.

    The plan is a literal array exploded per row (its size is fixed by the
    plan), so there is no join and no shuffle.  Columns: ``project, interview,
    content, analysis_type, analysis_step, call_no, temperature, uses_previous,
    template`` (template already carries the language suffix), plus ``keep``.

    With ``previous`` (earlier answers ``project, interview, analysis_step, content``, one a key) each request also has
    ``previous_answers``, step n-1 of the same interview where the plan asks for it, and ``prompt``.  The answers of an
    interview are gathered into one map and joined before the plan is exploded, so its text is shuffled once, not once a step.
    """
    source = interviews.select("project", F.col("interview_id").alias("interview"), "content", *keep)
    if previous is not None:
        by_step = (previous.groupBy("project", "interview")
                   .agg(F.map_from_entries(F.collect_list(F.struct("analysis_step", "content"))).alias("_answers")))  # at most one a step
        source = source.join(by_step, ["project", "interview"], "left")
        keep = (*keep, "_answers")
    out = (source.select("project", "interview", "content", *keep, F.explode(_plan_array(plan_steps(plan, analysis_type))).alias("p"))
           .select("project", "interview", "content", *keep,
                   "p.analysis_type", "p.analysis_step", "p.call_no",
                   TX.default_temperature("p.llm_temperature").alias("temperature"),
                   "p.uses_previous",
                   TX.with_language_suffix("p.text_template", suffix).alias("template")))
    if previous is not None:
        out = out.withColumn("previous_answers", F.when(F.col("uses_previous"), F.try_element_at("_answers", F.col("analysis_step") - 1)))
        out = out.drop("_answers").withColumn("prompt", TX.render_prompt("template", "content", "previous_answers"))
    return out


def render_requests(requests: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Attach ``previous_answers`` to the requests of one step (a row an interview) and render ``prompt``; see
    ``scoring_requests`` for all steps of interviews at once."""
    if previous is not None:
        prev = previous.select("project", "interview",
                               (F.col("analysis_step") + 1).alias("analysis_step"),
                               F.col("content").alias("previous_answers"))
        requests = requests.join(prev, KEY, "left")
        requests = requests.withColumn(
            "previous_answers", F.when(F.col("uses_previous"), F.col("previous_answers")))
    else:
        requests = requests.withColumn("previous_answers", F.lit(None).cast("string"))
    return requests.withColumn("prompt", TX.render_prompt("template", "content", "previous_answers"))


# ---------------------------------------------------------------------------
# Responders
# ---------------------------------------------------------------------------

def replay_responder(recorded: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Responder that answers from recorded answers ``(project, interview,
    analysis_step, answer_content, model, input_tokens, output_tokens)`` by an
    equi-join (null-safe on ``interview``, which is NULL for project answers);
    a request without a recording fails with an error.  Recordings must have
    one row per key: pass the latest answers, not the whole log."""
    rec = recorded.select(
        F.col("project").alias("_r_project"), F.col("interview").alias("_r_interview"),
        F.col("analysis_step").alias("_r_step"),
        F.struct(F.col("answer_content").alias("content"), F.col("model"),
                 F.col("input_tokens").cast("int").alias("input_tokens"),
                 F.col("output_tokens").cast("int").alias("output_tokens"),
                 F.lit(None).cast("string").alias("error")).alias("response"))

    def respond(requests: DataFrame) -> DataFrame:
        cond = (F.col("project").eqNullSafe(F.col("_r_project"))
                & F.col("interview").eqNullSafe(F.col("_r_interview"))
                & (F.col("analysis_step") == F.col("_r_step")))
        joined = requests.join(rec, cond, "left").drop("_r_project", "_r_interview", "_r_step")
        missing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in S.RESPONSE_SCHEMA.fields[:-1]],
                           F.lit("no recorded answer").alias("error"))
        return joined.withColumn("response", F.coalesce("response", missing))

    return respond


def next_turn(now: float, last: float, interval: float, clients: int, client: int) -> float:
    """The first start after ``last`` and not before ``now`` in the turns of one client.

    Time is dealt out in turns of ``interval`` seconds, and client ``c`` of ``n`` owns every turn whose number is ``c``
    modulo ``n``.  Starts of different clients are then at least one turn apart without their knowing of each other."""
    turn = max(int(now // interval), int(round(last / interval)) + 1)
    turn += (client - turn) % clients
    return turn * interval if turn * interval >= now else (turn + clients) * interval


def pandas_responder(make_client: Callable[[], Callable[[dict], dict]], min_interval_s: float = 0.0,
                     partitions: int | None = None, max_tokens: int = S.MAX_OUTPUT_TOKENS,
                     concurrency: int = 1) -> Callable[[DataFrame], DataFrame]:
    """Responder that calls a user client inside ``mapInPandas``.

    ``make_client()`` runs once per partition and returns ``call(request) ->
    {content, model, input_tokens, output_tokens}``; ``request`` holds the
    request row plus ``max_tokens``.  An exception becomes the row's ``error``.
    ``concurrency`` threads share the partition's client (model calls wait on
    the network, not the CPU).  The number of partitions times ``concurrency``
    bounds the calls in flight.

    ``min_interval_s`` keeps the starts of any two calls of the job that far apart, over all
    partitions: each partition starts its calls in its own turns of the wall clock (``next_turn``; the machines' clocks must agree to
    within the interval).  Turns of waiting tasks would stay unused, so there are then at most as many partitions as the default
    parallelism, the number of tasks that run at once.
    """

    def respond(requests: DataFrame) -> DataFrame:
        out_schema = T.StructType(requests.schema.fields + [T.StructField("response", S.RESPONSE_SCHEMA)])
        cols = requests.columns
        clients = partitions
        if min_interval_s:
            at_once = requests.sparkSession.sparkContext.defaultParallelism
            clients = min(clients or at_once, at_once)

        def run(batches):
            import threading
            from concurrent.futures import ThreadPoolExecutor

            from pyspark import TaskContext

            call = make_client()
            gate = threading.Lock()
            last_start = [0.0]
            client = TaskContext.get().partitionId()

            def one(rec):
                if min_interval_s:
                    with gate:
                        last_start[0] = next_turn(time.time(), last_start[0], min_interval_s, clients, client % clients)
                        start = last_start[0]
                    while (wait := start - time.time()) > 0:
                        time.sleep(wait)
                try:
                    r = call({**rec, "max_tokens": max_tokens})
                    return {"content": r.get("content"), "model": r.get("model"),
                            "input_tokens": r.get("input_tokens"),
                            "output_tokens": r.get("output_tokens"), "error": None}
                except Exception as e:  # the row fails, the batch goes on
                    return {"content": None, "model": None, "input_tokens": None,
                            "output_tokens": None, "error": f"{type(e).__name__}: {e}"}

            with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
                for pdf in batches:
                    out = pdf[cols].copy()
                    out["response"] = list(pool.map(one, pdf.to_dict("records")))  # keeps row order
                    yield out

        ship_package(requests.sparkSession)
        src = requests.repartition(clients) if clients else requests
        return src.mapInPandas(run, out_schema)

    return respond


def batch_score(requests: DataFrame, responder) -> DataFrame:
    """Responses flattened next to their request keys."""
    return responder(requests).select(
        "project", "interview", "analysis_type", "analysis_step",
        "prompt", "temperature",
        F.col("response.content").alias("content"), F.col("response.model").alias("model"),
        F.col("response.input_tokens").alias("input_tokens"),
        F.col("response.output_tokens").alias("output_tokens"),
        F.col("response.error").alias("error"))


def prompt_digest() -> F.Column:
    return F.sha2(F.coalesce(F.col("prompt"), F.lit("")), 256)


def answer_rows(scored: DataFrame, created: F.Column | None = None) -> DataFrame:
    """Successful responses as ``llm_answers`` rows (usage metadata projected out
    of the response).  ``id`` is left to the append, which gives out running numbers.

    ``prompt`` holds the plan step and a SHA-256 of the rendered prompt rather
    than the prompt itself (which repeats the whole interview once per step);
    ``answer_full`` is the response as JSON.  ``scored`` holds ``prompt`` or, where
    it was already digested, ``prompt_hash``.
    """
    created = created if created is not None else F.current_timestamp().cast("timestamp_ntz")
    digest = F.col("prompt_hash") if "prompt_hash" in scored.columns else prompt_digest()
    prompt_ref = F.concat(F.col("analysis_type"), F.lit("/"), F.col("analysis_step").cast("string"), F.lit(":"), digest)
    ok = scored.where(F.col("error").isNull()).withColumn("created", created)
    return ok.select(
        F.lit(None).cast("bigint").alias("id"),
        "project", "interview", "analysis_type", F.col("analysis_step").cast("int").alias("analysis_step"),
        "created", "model", F.col("input_tokens").cast("int").alias("input_tokens"),
        F.col("output_tokens").cast("int").alias("output_tokens"),
        prompt_ref.alias("prompt"),
        F.to_json(F.struct("content", "model", "input_tokens", "output_tokens")).alias("answer_full"),
        F.coalesce(F.col("content"), F.lit("")).alias("answer_content"),
        F.lit(None).cast("string").alias("answer_content_clear"))


# ---------------------------------------------------------------------------
# Chained steps
# ---------------------------------------------------------------------------

def persist_table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write to the shared checkpoint folder and read back (cuts lineage; a
    recomputation reads the table instead of calling the model again)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def read_if_written(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """The table at ``path``, or None where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def score_once(requests: DataFrame, responder, keys: list[str], name: str, run_path: str | None = None,
               broken: DataFrame | None = None) -> DataFrame:
    """Score requests (with ``prompt``) and keep their answers in a table; return its rows for these requests.

    Without ``run_path`` the table is a fresh one in the shared scratch folder.  With it, the table is ``run_path/name``, and each
    start adds an ``attempt``: requests whose key and prompt digest already have an answer are not scored again.
    Finished tasks' files are kept if the job fails or the driver is lost (the committer moves a task's file
    into place when that task ends), so a failure costs the calls of the unfinished tasks only.  Errors are
    stored too, and asked again at the next start.

    ``broken``: rows ``(keys..., temperature, error)`` that cannot be asked; they are written with the rest.
    The prompts, which repeat the whole input, are digested before they are written.
    """
    spark = requests.sparkSession
    path = f"{run_path.rstrip('/')}/{name}" if run_path else scratch_path(spark, name)
    requests = requests.withColumn("prompt_hash", prompt_digest())
    extra = [c for c in ("input_chars",) if c in requests.columns]
    schema = T.StructType([requests.schema[c] for c in [*keys, *extra, "temperature", "prompt_hash"]]
                          + [T.StructField(f.name, f.dataType) for f in S.RESPONSE_SCHEMA] + [T.StructField("attempt", T.IntegerType())])
    match = [*keys, "prompt_hash"]
    before = read_if_written(spark, path, schema) if run_path else None
    todo, attempt = requests, 0
    if before is not None:
        attempt = (before.agg(F.max("attempt")).first()[0] or 0) + 1  # one scalar, from the folder names
        todo = requests.join(before.where(F.col("error").isNull()).select(*match).distinct(), match, "left_anti")
    scored = responder(todo).select(*keys, *extra, "temperature", "prompt_hash", "response.*")
    if broken is not None:
        scored = scored.unionByName(broken, allowMissingColumns=True)
    (scored.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
     .parquet(f"{path}/attempt={attempt}"))
    rows = spark.read.schema(schema).parquet(path)
    if before is not None:  # of each request its answer, or the newest error; rows of other prompts are left out
        asked = requests.select(*match)
        if broken is not None:
            asked = asked.unionByName(broken.select(*match))
        best = Window.partitionBy(*match).orderBy(F.col("error").isNotNull(), F.col("attempt").desc())
        rows = (rows.join(asked.distinct(), match, "left_semi")
                .withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("_best"))
        rows = persist_table(rows, name)  # later steps read the rows, not the requests behind them
    return rows.drop("attempt")


def chained_steps(interviews: DataFrame, responder, plan=S.QUESTION_PLAN,
                  analysis_type: str = "interview", run_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run the plan step by step over all interviews at once.

    Step *n* sees the answer of step *n-1* of the same interview from this run.
    A failed request (responder error, or a missing step *n-1* where the plan
    needs it) ends that interview's remaining steps only: later steps
    ``left_anti`` the failed interviews.  Returns ``(answers, dead_letters)``;
    ``answers`` holds ``project, interview, analysis_type, analysis_step, prompt_hash,
    temperature, content, model, input_tokens, output_tokens``.  With ``run_path`` a second
    start goes on where the first one stopped (``score_once``).
    """
    answers = dead = failed = prev = None
    keys = ["project", "interview", "analysis_type", "analysis_step"]
    for p in plan_steps(plan, analysis_type):
        req = scoring_requests(interviews, [p], analysis_type)
        if failed is not None:
            req = req.join(failed, ["project", "interview"], "left_anti")
        rendered = render_requests(req, prev)
        broken = None
        if p["uses_previous"]:  # written with the step, so later steps do not render it again
            broken = rendered.where(F.col("previous_answers").isNull()).select(
                *keys, "temperature", prompt_digest().alias("prompt_hash"), F.lit("previous step missing").alias("error"))
            rendered = rendered.where(F.col("previous_answers").isNotNull())
        scored = score_once(rendered, responder, keys, f"step-{analysis_type}-{p['analysis_step']}", run_path, broken)
        ok = scored.where(F.col("error").isNull()).withColumn("content", F.coalesce("content", F.lit("")))
        bad = scored.where(F.col("error").isNotNull()).select("project", "interview", "analysis_step", "error")
        dead = bad if dead is None else dead.unionByName(bad)
        failed = bad.select("project", "interview") if failed is None else \
            failed.unionByName(bad.select("project", "interview"))
        prev = ok.select("project", "interview", "analysis_step", "content")
        answers = ok if answers is None else answers.unionByName(ok)
    return answers, dead


# ---------------------------------------------------------------------------
# Project scoring
# ---------------------------------------------------------------------------

def chunk_texts(texts: DataFrame, budget_chars: int, separator: str = "", in_pairs: bool = False) -> DataFrame:
    """Join consecutive texts of a project into chunks ``(project, chunk_no, content, input_chars, members)``.

    ``texts``: ``project, block_no, text``; one chunk holds the texts that start within the same ``budget_chars``
    characters, so no group is larger than the budget plus one text, and a text longer than the budget is a chunk.  With ``in_pairs`` texts
    are taken two at a time, so every chunk but a last odd one has two members at least.
    Only keys and lengths are range-partitioned for the offsets; the texts join them by key.
    """
    sizes = texts.select("project", "block_no", F.length("text").cast("bigint").alias("_len"))
    if in_pairs:
        sizes = sequence_number(sizes, ["project"], ["block_no"], name="_pos")
    cum = running_total(sizes, ["project"], ["block_no"], "_len", name="_end")
    start = F.col("_end") - F.col("_len")
    if in_pairs:  # at most two rows a key
        start = F.min(start).over(Window.partitionBy("project", F.floor((F.col("_pos") + 1) / 2)))
    chunk_of = cum.select("project", "block_no", "_len", (F.floor(start / F.lit(budget_chars)) + 1).alias("chunk_no"))
    return (texts.join(chunk_of, ["project", "block_no"]).groupBy("project", "chunk_no")
            .agg(F.expr(f"listagg(text, '{separator}') within group (order by block_no)").alias("content"),
                 F.sum("_len").alias("input_chars"), F.count(F.lit(1)).alias("members")))


def project_requests(chunks: DataFrame, plan=S.QUESTION_PLAN, suffix: str = S.LANGUAGE_SUFFIX) -> DataFrame:
    """One request per chunk and project plan step.  A project whose report fits the budget has one
    chunk, and its request is the whole report."""
    reqs = scoring_requests(chunks.select("project", F.col("chunk_no").alias("interview_id"), "content", "input_chars"),
                            plan, "project", suffix, keep=("input_chars",))
    return (reqs.withColumnRenamed("interview", "chunk_no")
            .withColumn("interview", F.lit(None).cast("bigint")))


CALL_KEYS = ["project", "analysis_type", "analysis_step", "level", "chunk_no"]


def project_score(blocks: DataFrame, responder, plan=S.QUESTION_PLAN, budget_chars: int = 2_000_000,
                  run_path: str | None = None) -> DataFrame:
    """All calls that lead to one answer per project and plan step, steps in order.

    Level 0 scores the chunks of the project's report.  While a project has more than one answer, these are the texts of
    the next level: joined in order into chunks that fit the budget (two answers at least), and scored with the same step of the
    plan, so the last answer has seen, through the ones below it, every block.  An odd answer left over moves up as it is.
    Each level at least halves the answers of a project, and there is one batch a level for all projects.  A project with a
    failed call stops there.  Step *n* gets the whole answer of step *n-1* where the plan asks for it; a
    project whose step *n-1* failed is answered with an error.

    ``blocks``: ``project, block_no, text``.  Rows: ``CALL_KEYS``, ``input_chars, temperature, prompt_hash`` and the
    response's columns; ``project_answers`` reduces them to the answers.
    """
    report = persist_table(chunk_texts(blocks, budget_chars), "project-chunks")
    prev = out = None
    steps = plan_steps(plan, "project")
    for p in steps:
        level, chunks, carried, calls = 0, report, None, None
        while True:
            req = (project_requests(chunks, plan).where(F.col("analysis_step") == p["analysis_step"])
                   .withColumn("level", F.lit(level)))
            broken = None
            if prev is not None and p["uses_previous"]:
                req = req.join(prev, "project", "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
            else:
                req = req.withColumn("previous_answers", F.lit(None).cast("string"))
            req = req.withColumn("prompt", TX.render_prompt("template", "content", "previous_answers"))
            if "_ok" in req.columns:
                broken = req.where(~F.col("_ok")).select(
                    *CALL_KEYS, "input_chars", "temperature", prompt_digest().alias("prompt_hash"),
                    F.lit("previous step missing").alias("error"))
                req = req.where("_ok").drop("_ok")
            scored = score_once(req, responder, CALL_KEYS, f"step-project-{p['analysis_step']}-{level}", run_path, broken)
            calls = scored if calls is None else calls.unionByName(scored)
            texts = scored.select("project", F.col("chunk_no").alias("block_no"), F.coalesce("content", F.lit("")).alias("text"), "error")
            if carried is not None:
                texts = texts.unionByName(carried, allowMissingColumns=True)
            more = texts.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad")).where("n > 1 and bad = 0")
            more = persist_table(more.select("project"), "project-more")  # one row a project
            if not more.head(1):
                break
            texts = texts.drop("error").join(more, "project", "left_semi")
            grouped = persist_table(chunk_texts(texts, budget_chars, "\n", in_pairs=True), "project-chunks")
            chunks = grouped.where("members > 1")
            carried = grouped.where("members = 1").select("project", F.col("chunk_no").alias("block_no"), F.col("content").alias("text"))
            level += 1
        out = calls if out is None else out.unionByName(calls)
        if p is steps[-1]:
            break
        whole = project_answers(calls)
        prev = persist_table(whole.select("project", F.coalesce("content", F.lit("")).alias("previous_answers"),
                                          F.col("error").isNull().alias("_ok")), "project-previous")
    return out


def project_answers(calls: DataFrame) -> DataFrame:
    """One answer per project and step: that of the call of the highest level; tokens are added up over all its calls.

    If a call failed, the answer fails with the first such call's error, so no part of a project is lost silently."""
    failed = F.when(F.col("error").isNotNull(), F.struct("level", "chunk_no"))
    answers = calls.groupBy("project", "analysis_type", "analysis_step").agg(
        F.max_by("content", "level").alias("content"), F.max_by("model", "level").alias("model"),
        F.sum("input_tokens").cast("int").alias("input_tokens"), F.sum("output_tokens").cast("int").alias("output_tokens"),
        F.min_by("error", failed).alias("error"), F.first("temperature").alias("temperature"),
        F.max_by("prompt_hash", "level").alias("prompt_hash"), F.count(F.lit(1)).alias("calls"),
        (F.max("level") + 1).alias("levels"))
    return (answers.withColumn("content", F.when(F.col("error").isNull(), F.coalesce("content", F.lit(""))))
            .withColumn("interview", F.lit(None).cast("bigint")))
