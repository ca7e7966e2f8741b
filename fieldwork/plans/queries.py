"""Query registry: one Spark callable and (where SQL can say it) one DuckDB oracle per key.

Every callable takes ``(spark, sf_dir)`` and reads the given tables (or tables
Spark derives from them), whole.  Computed columns carry the same names in both
engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork import schemas as S
from fieldwork.functions import text as T
from fieldwork.operators import latest as L
from fieldwork.operators import reports as R
from fieldwork.operators import sections as SEC
from fieldwork.plans import sqlfrag as Q
from fieldwork.sources import tables as TB

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None, fixtures: bool = True):
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLES[key] = TB.with_fixtures(oracle) if fixtures else oracle
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _answers(spark, sf_dir):
    return TB.answers_fixture(spark, sf_dir)


# ---------------------------------------------------------------------------
# 2.2 filter / 2.3 windows / 2.4 aggregates on the answer log
# ---------------------------------------------------------------------------

@register("answers_filter", """
select id, project, interview, analysis_step, model from llm_answers_v where analysis_type = 'interview'
""")
def q_answers_filter(spark, sf_dir):
    return (L.answers_filter(_answers(spark, sf_dir), "interview")
            .select("id", "project", "interview", "analysis_step", "model"))


@register("latest_interview_answer", f"""
with {Q.LATEST_INTERVIEW}
select project, interview, analysis_step, id, answer_content from latest
""")
def q_latest_interview_answer(spark, sf_dir):
    return (L.latest_answers(_answers(spark, sf_dir), "interview")
            .select("project", "interview", "analysis_step", "id", "answer_content"))


@register("latest_project_answer", f"""
with {Q.LATEST_PROJECT}
select project, interview, analysis_step, id, answer_content from latest_p
""")
def q_latest_project_answer(spark, sf_dir):
    return (L.latest_answers(_answers(spark, sf_dir), "project")
            .select("project", "interview", "analysis_step", "id", "answer_content"))


@register("first_project_step", f"""
with {Q.LATEST_PROJECT}, {Q.FIRST_PROJECT}
select project, answer_content from first_p
""")
def q_first_project_step(spark, sf_dir):
    return L.first_project_step(L.latest_answers(_answers(spark, sf_dir), "project"))


@register("report_number", f"""
with {Q.LATEST_INTERVIEW}
select project, interview, row_number() over (partition by project order by interview) as report_no
from (select distinct project, interview from latest) t
""")
def q_report_number(spark, sf_dir):
    latest = L.latest_answers(_answers(spark, sf_dir), "interview")
    return R.report_numbers(latest.select("project", "interview").distinct())


@register("previous_answer", f"""
with {Q.LATEST_INTERVIEW}
select c.project, c.interview, c.analysis_step, p.id as previous_id, p.answer_content as previous_answer
from latest c left join latest p
  on p.project = c.project and p.interview = c.interview and p.analysis_step = c.analysis_step - 1
where c.analysis_step in ({", ".join(str(p["analysis_step"]) for p in S.QUESTION_PLAN
                                 if p["analysis_type"] == "interview" and p["uses_previous"])})
""")
def q_previous_answer(spark, sf_dir):
    from fieldwork.operators.scoring import plan_frame
    latest = L.latest_answers(_answers(spark, sf_dir), "interview")
    return L.previous_answers(latest, plan_frame(spark))


@register("last_content_by_id", """
select conv_id, arg_max(text, turn) as text from conversations group by conv_id
""", fixtures=False)
def q_last_content_by_id(spark, sf_dir):
    conv = TB.load(spark, sf_dir, "conversations")
    return L.last_value_by_key(conv, "conv_id", "text", "turn")


@register("concat_answers", f"""
with {Q.LATEST_INTERVIEW}, {Q.CONCAT}
select project, interview, answers_text from concat_a
""")
def q_concat_answers(spark, sf_dir):
    return SEC.concat_answers(L.latest_answers(_answers(spark, sf_dir), "interview"))


# ---------------------------------------------------------------------------
# 2.5 string scalars
# ---------------------------------------------------------------------------

@register("extract_sections", f"""
with {Q.LATEST_INTERVIEW}, {Q.CONCAT}, {Q.SECTIONS}
select project, interview, ord, tag, content from sections
""")
def q_extract_sections(spark, sf_dir):
    return SEC.interview_sections(L.latest_answers(_answers(spark, sf_dir), "interview"))


@register("normalise_lines", f"""
with {Q.LATEST_INTERVIEW}, {Q.CONCAT}, {Q.SECTIONS}
select project, interview, ord, {Q.normalise('content')} as processed from sections
""")
def q_normalise_lines(spark, sf_dir):
    secs = SEC.interview_sections(L.latest_answers(_answers(spark, sf_dir), "interview"))
    return SEC.with_processed(secs).select("project", "interview", "ord", "processed")


@register("label_sections", f"""
with {Q.LATEST_INTERVIEW}, {Q.CONCAT}, {Q.SECTIONS}
select project, interview, ord, tag,
       chr(10) || {Q.label('tag')} || chr(10) || {Q.normalise('content')} || chr(10) as block
from sections
""")
def q_label_sections(spark, sf_dir):
    secs = SEC.interview_sections(L.latest_answers(_answers(spark, sf_dir), "interview"))
    return SEC.with_labels(secs).select("project", "interview", "ord", "tag", "block")


# ---------------------------------------------------------------------------
# 2.4 reports
# ---------------------------------------------------------------------------

_REPORT_CTES = f"""{Q.LATEST_INTERVIEW}, {Q.CONCAT}, {Q.SECTIONS},
numbered as (
  select project, interview, row_number() over (partition by project order by interview) as report_no
  from concat_a),
bodies as (
  select project, interview,
         string_agg(chr(10) || {Q.label('tag')} || chr(10) || {Q.normalise('content')} || chr(10), ''
                    order by ord) as body
  from sections group by project, interview),
report as (
  select n.project, n.interview, n.report_no,
         {Q.text_lit(S.INTERVIEW_HEADER)} || cast(n.report_no as varchar) || coalesce(b.body, '') as report_block
  from numbered n left join bodies b on b.project = n.project and b.interview = n.interview)"""

_REPORT_SQL = f"with {_REPORT_CTES} select project, interview, report_no, report_block from report"


@register("interviews_report", _REPORT_SQL)
def q_interviews_report(spark, sf_dir):
    return R.interviews_report(_answers(spark, sf_dir))


@register("last_section_by_tag", f"""
with {Q.LATEST_PROJECT}, {Q.FIRST_PROJECT},
secs as ({Q.sections_from('first_p', 'project', 'answer_content')})
select project, tag, arg_max(content, ord) as content from secs group by project, tag
""")
def q_last_section_by_tag(spark, sf_dir):
    return R.last_section_by_tag(_answers(spark, sf_dir))


_SUMMARY_CTES = f"""{Q.LATEST_PROJECT}, {Q.FIRST_PROJECT},
secs as ({Q.sections_from('first_p', 'project', 'answer_content')}),
last_tag as (
  select project, tag, arg_max(content, ord) as content from secs group by project, tag),
body as (
  select project, string_agg(chr(10) || content || chr(10), '' order by {Q.summary_order('tag')}) as body
  from last_tag where {Q.summary_order('tag')} is not null group by project),
summary_q as (
  select f.project, p.project_name,
         {Q.q(S.SUMMARY_HEADER)} || p.project_name || coalesce(b.body, '') as summary
  from first_p f join projects_v p on p.project_id = f.project
  left join body b on b.project = f.project)"""


@register("project_summary", f"with {_SUMMARY_CTES} select project, project_name, summary from summary_q")
def q_project_summary(spark, sf_dir):
    return R.project_summary(_answers(spark, sf_dir), TB.projects_fixture(spark, sf_dir))


# ---------------------------------------------------------------------------
# 2.6 scoring (replay responder over the recorded answers)
# ---------------------------------------------------------------------------

PROJECT_BUDGET_CHARS = 2_000_000
THROTTLE_INTERVAL_S = 0.001


def _interviews(spark, sf_dir):
    return TB.interviews_fixture(spark, sf_dir)


def _stored_previous(latest):
    return latest.select("project", "interview", "analysis_step", F.col("answer_content").alias("content"))


def _rendered(spark, sf_dir):
    from fieldwork.operators import scoring as SC
    answers = _answers(spark, sf_dir)
    latest = L.latest_answers(answers, "interview")
    return SC.scoring_requests(_interviews(spark, sf_dir), previous=_stored_previous(latest)), latest


_REQ_CTES = f"""{Q.LATEST_INTERVIEW},
req as (
  select i.project, i.interview_id as interview, i.content, plan.*
  from interviews_v i cross join {Q.plan_values('interview')}),
rendered as (
  select r.*, case when r.uses_previous then p.answer_content end as previous_answers
  from req r left join latest p
    on p.project = r.project and p.interview = r.interview and p.analysis_step = r.analysis_step - 1)"""


@register("scoring_requests", f"""
with {_REQ_CTES}
select project, interview, analysis_step, call_no, uses_previous, temperature from req
""")
def q_scoring_requests(spark, sf_dir):
    from fieldwork.operators import scoring as SC
    return (SC.scoring_requests(_interviews(spark, sf_dir))
            .select("project", "interview", "analysis_step", "call_no", "uses_previous", "temperature"))


@register("default_temperature", f"""
with {_REQ_CTES}
select project, interview, analysis_step, temperature from req
""")
def q_default_temperature(spark, sf_dir):
    from fieldwork.operators import scoring as SC
    return SC.scoring_requests(_interviews(spark, sf_dir)).select(
        "project", "interview", "analysis_step", "temperature")


@register("language_suffix", f"""
with {_REQ_CTES}
select project, interview, analysis_step, {Q.template_case('interview')} as template from req
""")
def q_language_suffix(spark, sf_dir):
    from fieldwork.operators import scoring as SC
    return SC.scoring_requests(_interviews(spark, sf_dir)).select(
        "project", "interview", "analysis_step", "template")


@register("plan_order", f"""
with {_REQ_CTES}
select project, interview, analysis_step, call_no from req
""")
def q_plan_order(spark, sf_dir):
    from fieldwork.operators import scoring as SC
    return SC.scoring_requests(_interviews(spark, sf_dir)).select(
        "project", "interview", "analysis_step", "call_no")


@register("render_prompt", f"""
with {_REQ_CTES}
select project, interview, analysis_step, {Q.prompt_case('interview', 'content', 'previous_answers')} as prompt
from rendered
""")
def q_render_prompt(spark, sf_dir):
    rendered, _ = _rendered(spark, sf_dir)
    return rendered.select("project", "interview", "analysis_step", "prompt")


_SCORED_SQL = f"""
with {_REQ_CTES}
select r.project, r.interview, r.analysis_step, r.temperature,
       l.answer_content as content, l.model, l.input_tokens, l.output_tokens,
       case when l.id is null then 'no recorded answer' end as error
from rendered r left join latest l
  on l.project = r.project and l.interview = r.interview and l.analysis_step = r.analysis_step
"""


@register("batch_score", _SCORED_SQL)
def q_batch_score(spark, sf_dir):
    from fieldwork.operators import scoring as SC
    rendered, latest = _rendered(spark, sf_dir)
    return (SC.batch_score(rendered, SC.replay_responder(latest))
            .select("project", "interview", "analysis_step", "temperature", "content", "model",
                    "input_tokens", "output_tokens", "error"))


def _echo_client():
    """Stands in for a model client: answers with the recorded reply carried on the row."""
    def call(req):
        if req.get("rec_error"):
            raise LookupError(req["rec_error"])
        return {"content": req["rec_content"], "model": req["rec_model"],
                "input_tokens": req["rec_input_tokens"], "output_tokens": req["rec_output_tokens"]}
    return call


@register("throttle", _SCORED_SQL)
def q_throttle(spark, sf_dir):
    from fieldwork.operators import scoring as SC
    rendered, latest = _rendered(spark, sf_dir)
    carried = SC.replay_responder(latest)(rendered).select(
        *rendered.columns,
        F.col("response.content").alias("rec_content"), F.col("response.model").alias("rec_model"),
        F.col("response.input_tokens").alias("rec_input_tokens"),
        F.col("response.output_tokens").alias("rec_output_tokens"),
        F.col("response.error").alias("rec_error"))
    responder = SC.pandas_responder(_echo_client, min_interval_s=THROTTLE_INTERVAL_S,
                                    partitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (SC.batch_score(carried, responder)
            .select("project", "interview", "analysis_step", "temperature", "content", "model",
                    "input_tokens", "output_tokens", F.regexp_replace("error", "^LookupError: ", "").alias("error")))


@register("usage_metadata", f"""
with {_REQ_CTES}
select r.project, r.interview, 'interview' as analysis_type, r.analysis_step,
       l.model, l.input_tokens, l.output_tokens, coalesce(l.answer_content, '') as answer_content
from rendered r join latest l
  on l.project = r.project and l.interview = r.interview and l.analysis_step = r.analysis_step
""")
def q_usage_metadata(spark, sf_dir):
    from fieldwork.operators import scoring as SC
    rendered, latest = _rendered(spark, sf_dir)
    rows = SC.answer_rows(SC.batch_score(rendered, SC.replay_responder(latest)))
    return rows.select("project", "interview", "analysis_type", "analysis_step", "model",
                       "input_tokens", "output_tokens", "answer_content")


_CHAIN_CTES = f"""{_REQ_CTES},
have as (
  select r.project, r.interview, r.analysis_step, l.answer_content, l.model, l.input_tokens,
         l.output_tokens, l.id is not null as ok
  from req r left join latest l
    on l.project = r.project and l.interview = r.interview and l.analysis_step = r.analysis_step),
first_fail as (
  select project, interview, min(analysis_step) as failed_step from have where not ok group by project, interview)"""


def _chained(spark, sf_dir):
    from fieldwork.operators import scoring as SC
    latest = L.latest_answers(_answers(spark, sf_dir), "interview")
    return SC.chained_steps(_interviews(spark, sf_dir), SC.replay_responder(latest))


@register("chained_steps", f"""
with {_CHAIN_CTES}
select h.project, h.interview, h.analysis_step, coalesce(h.answer_content, '') as content, h.model,
       h.input_tokens, h.output_tokens
from have h left join first_fail f on f.project = h.project and f.interview = h.interview
where h.ok and (f.failed_step is null or h.analysis_step < f.failed_step)
""")
def q_chained_steps(spark, sf_dir):
    answers, _ = _chained(spark, sf_dir)
    return answers.select("project", "interview", "analysis_step", "content", "model",
                          "input_tokens", "output_tokens")


@register("failure_isolation", f"""
with {_CHAIN_CTES}
select project, interview, failed_step as analysis_step, 'no recorded answer' as error from first_fail
""")
def q_failure_isolation(spark, sf_dir):
    _, dead = _chained(spark, sf_dir)
    return dead.select("project", "interview", "analysis_step", "error")


@register("project_score", f"""
with {_REPORT_CTES}, {Q.LATEST_PROJECT},
sized as (
  select project, report_no, report_block, length(report_block) as len,
         sum(length(report_block)) over (partition by project order by report_no
                                         rows between unbounded preceding and current row) as e
  from report),
chunks as (
  select project, cast(floor((e - len) / {PROJECT_BUDGET_CHARS}) + 1 as bigint) as chunk_no,
         cast(sum(len) as bigint) as input_chars
  from sized group by 1, 2)
select c.project, c.chunk_no, 1 as analysis_step, c.input_chars,
       l.answer_content as content, l.model, l.input_tokens, l.output_tokens,
       case when l.id is null then 'no recorded answer' end as error
from chunks c left join latest_p l on l.project = c.project and l.analysis_step = 1
""")
def q_project_score(spark, sf_dir):
    from fieldwork.operators import scoring as SC
    answers = _answers(spark, sf_dir)
    blocks = R.interviews_report(answers).select("project", F.col("report_no").alias("block_no"),
                                                 F.col("report_block").alias("text"))
    latest_p = L.latest_answers(answers, "project")
    return (SC.project_score(blocks, SC.replay_responder(latest_p), budget_chars=PROJECT_BUDGET_CHARS)
            .where("level = 0").select("project", "chunk_no", "analysis_step", "input_chars", "content", "model",
                    "input_tokens", "output_tokens", "error"))


TREE_BUDGET_CHARS = 3_000
TREE_LEVELS = 12
_TREE_MARK = "№ "


def _naming_responder(requests):
    """Answers that depend on the whole prompt: the interview numbers it holds, each once, and digests of it as a long keyword list."""
    seen = F.array_sort(F.array_distinct(F.transform(
        F.regexp_extract_all("prompt", F.lit(_TREE_MARK + r"(\d+)"), F.lit(1)), lambda n: n.cast("bigint"))))
    named = F.array_join(F.transform(seen, lambda n: F.concat(F.lit(_TREE_MARK), n.cast("string"))), " ")
    content = F.concat(F.lit("<results>"), named, F.lit("</results>\n<keywords>"),
                       F.repeat(F.sha2(F.col("prompt").cast("binary"), 256), F.lit(16)), F.lit("</keywords>"))
    return requests.withColumn("response", F.struct(
        content.alias("content"), F.lit("namer").alias("model"), F.length("prompt").alias("input_tokens"),
        F.length(content).alias("output_tokens"), F.lit(None).cast("string").alias("error")))


def _tree_sql() -> str:
    """The levels one after the other: ``t<i>`` are chunks, ``a<i>`` their answers (a chunk of one answer is not asked again)."""
    seen = f"list_sort(list_distinct(list_transform(regexp_extract_all(prompt, '{_TREE_MARK}(\\d+)', 1), lambda n: n::bigint)))"
    answer = (f"'<results>' || array_to_string(list_transform({seen}, lambda n: '{_TREE_MARK}' || n), ' ') || '</results>' || chr(10)"
              " || '<keywords>' || repeat(sha256(prompt), 16) || '</keywords>'")
    prompt = Q.prompt([p for p in S.QUESTION_PLAN if p["analysis_type"] == "project"][0]["text_template"] + S.LANGUAGE_SUFFIX, "content", "null")
    ctes = [f"""t0 as materialized (
  select project, chunk_no, string_agg(report_block, '' order by report_no) as content, 2 as members
  from (select project, report_no, report_block, cast(floor((e - length(report_block)) / {TREE_BUDGET_CHARS}) + 1 as bigint) as chunk_no
        from (select *, sum(length(report_block)) over (partition by project order by report_no
                                                        rows between unbounded preceding and current row) as e from report))
  group by project, chunk_no)"""]
    for i in range(TREE_LEVELS):
        ctes.append(f"""a{i} as materialized (
  select project, chunk_no, members > 1 as asked, length(prompt) as n_in,
         case when members > 1 then {answer} else content end as content
  from (select *, {prompt} as prompt from t{i})),
t{i + 1} as materialized (
  select project, chunk_no, string_agg(content, chr(10) order by prior) as content, count(*) as members
  from (select project, prior, content, cast(floor(min(e - length(content)) over (partition by project, (pos + 1) // 2) / {TREE_BUDGET_CHARS}) + 1
                                             as bigint) as chunk_no
        from (select project, chunk_no as prior, content, row_number() over (partition by project order by chunk_no) as pos,
                     count(*) over (partition by project) as n,
                     sum(length(content)) over (partition by project order by chunk_no rows between unbounded preceding and current row) as e
              from a{i}) where n > 1)
  group by project, chunk_no)""")
    rows = " union all ".join(f"select project, {i} as level, n_in, content from a{i} where asked" for i in range(TREE_LEVELS))
    return f"""
with {_REPORT_CTES}, {", ".join(ctes)}, calls as ({rows})
select project, arg_max(content, level) as content, cast(sum(n_in) as integer) as input_tokens, count(*) as calls,
       cast(max(level) + 1 as integer) as levels from calls group by project
"""


@register("project_score_tree", _tree_sql())
def q_project_score_tree(spark, sf_dir):
    """Reports far above the budget: the last answer names every interview of its project."""
    from fieldwork.operators import scoring as SC
    blocks = R.interviews_report(_answers(spark, sf_dir)).select(
        "project", F.col("report_no").alias("block_no"), F.col("report_block").alias("text"))
    calls = SC.project_score(blocks, _naming_responder, budget_chars=TREE_BUDGET_CHARS)
    return SC.project_answers(calls).select("project", "content", "input_tokens", "calls", "levels")


# ---------------------------------------------------------------------------
# 2.1 sources, sinks, table access / 2.2 lookups
# ---------------------------------------------------------------------------

LOOKUP_PROJECT = "src3"
PARAM_SEGMENT = "BUILDING"


def _docs_as_files(spark, sf_dir) -> str:
    from fieldwork.session import scratch_path
    from fieldwork.sources.files import write_documents_as_files
    docs = TB.load(spark, sf_dir, "documents").select(F.col("source").alias("project_name"), "text")
    root = scratch_path(spark, "raw")
    write_documents_as_files(docs, root)
    return root


_INGEST_SQL = f"""
with norm as (
  select source as project_name, {Q.strip_ws("regexp_replace(text, '\\r\\n?', chr(10), 'g')")} as content
  from documents)
select project_name, content from norm where content <> ''
"""


def _ingested_view(good):
    return good.select("project_name", "content")


@register("ingest_text", _INGEST_SQL, fixtures=False)
def q_ingest_text(spark, sf_dir):
    from fieldwork.session import delete_folder
    from fieldwork.sources.files import ingest_text
    root = _docs_as_files(spark, sf_dir)
    good, _ = ingest_text(spark, root, layout="hive")
    delete_folder(spark, root)  # every file is read and staged by now
    return _ingested_view(good)


@register("page_text_assembly", """
select conv_id as doc, string_agg(text, '' order by turn) as text from conversations group by conv_id
""", fixtures=False)
def q_page_text_assembly(spark, sf_dir):
    from fieldwork.sources.files import page_text_assembly
    pages = TB.load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("page_no"), "text")
    return page_text_assembly(pages)


@register("param_sql", f"""
select distinct c_custkey, c_name from customer where c_mktsegment = {Q.q(PARAM_SEGMENT)}
""", fixtures=False)
def q_param_sql(spark, sf_dir):
    from fieldwork.operators.store import param_sql
    return param_sql(spark, "SELECT DISTINCT c_custkey, c_name FROM {customer} WHERE c_mktsegment = :segment",
                     {"segment": PARAM_SEGMENT}, customer=TB.load(spark, sf_dir, "customer"))


@register("validated_append", f"""
select conv_id * 100 + turn as id,
       case when role = 'user' then 'valid' else 'rejected' end as status,
       case when role = 'system' then 'model required' when role <> 'user' then 'prompt required' end as reason,
       case when role = 'user' then {Q.strip_ws('text')} end as prompt
from conversations
""", fixtures=False)
def q_validated_append(spark, sf_dir):
    from fieldwork.operators.store import validate_rows
    conv = TB.load(spark, sf_dir, "conversations")
    candidates = conv.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.col("conv_id") % 7).alias("project"),
        F.col("conv_id").alias("interview"), F.lit("interview").alias("analysis_type"),
        (F.col("turn") % 5 + 1).alias("analysis_step"),
        F.when(F.col("role") != "system", F.col("role")).alias("model"),
        F.length("text").alias("input_tokens"), (F.length("text") % 97).alias("output_tokens"),
        F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit(" ")).alias("prompt"))
    valid, rejects = validate_rows(candidates, "llm_answers")
    return valid.select("id", F.lit("valid").alias("status"), F.lit(None).cast("string").alias("reason"),
                        "prompt").unionByName(
        rejects.select(F.get_json_object("payload", "$.id").cast("bigint").alias("id"),
                       F.lit("rejected").alias("status"), "reason",
                       F.lit(None).cast("string").alias("prompt")))


@register("register_project", """
with ex as (select project_id, project_name from projects_v),
nw as (select distinct source as project_name from documents
       where source not in (select project_name from ex))
select project_id, project_name from ex
union all
select (select max(project_id) from ex) + row_number() over (order by project_name), project_name from nw
""")
def q_register_project(spark, sf_dir):
    from fieldwork.operators.store import register_projects
    names = TB.load(spark, sf_dir, "documents").select(F.col("source").alias("project_name"))
    return register_projects(TB.projects_fixture(spark, sf_dir), names)


_REGISTRY_SQL = """
registry as (
  select row_number() over (order by project_name) as project_id, project_name
  from (select distinct source as project_name from documents) t)"""


def _registry(spark, sf_dir):
    from fieldwork.operators.store import number_names
    return number_names(TB.load(spark, sf_dir, "documents").select(F.col("source").alias("project_name")))


@register("resolve_project", f"""
with {_REGISTRY_SQL}
select project_name, min(project_id) as project_id from registry
where project_name = {Q.q(LOOKUP_PROJECT)} group by project_name
""", fixtures=False)
def q_resolve_project(spark, sf_dir):
    from fieldwork.operators.store import resolve_project
    return resolve_project(_registry(spark, sf_dir), LOOKUP_PROJECT)


@register("project_interviews", f"""
select distinct doc_id as interview_id, text as content from documents where source = {Q.q(LOOKUP_PROJECT)}
""", fixtures=False)
def q_project_interviews(spark, sf_dir):
    from fieldwork.operators.store import project_interviews, resolve_project
    registry = _registry(spark, sf_dir)
    interviews = (TB.document_interviews(spark, sf_dir)
                  .join(registry, "project_name")
                  .select("interview_id", F.col("project_id").alias("project"), "content"))
    resolved = resolve_project(registry, LOOKUP_PROJECT).select(F.col("project_id").alias("project"))
    # the resolved id is at most one row: a semi join keeps the plan free of driver round trips
    return project_interviews(interviews.join(F.broadcast(resolved), "project", "left_semi"),
                              F.col("project"))


@register("report_sink", f"""
with {_REPORT_CTES}, {_SUMMARY_CTES},
blocks as (
  select p.project_name, 'interviews' as report_type, r.report_block as text
  from report r join projects_v p on p.project_id = r.project
  union all
  select project_name, 'summary' as report_type, summary as text from summary_q)
select unnest(string_split(text, chr(10))) as value, project_name, report_type from blocks
""")
def q_report_sink(spark, sf_dir):
    from fieldwork.session import scratch_path
    from fieldwork.sources.sinks import read_reports, write_reports
    blocks = R.report_blocks(_answers(spark, sf_dir), TB.projects_fixture(spark, sf_dir))
    path = write_reports(blocks, scratch_path(spark, "reports"))
    return read_reports(spark, path).select("value", F.col("project_name").cast("string"), "report_type")


# ---------------------------------------------------------------------------
# 2.8 insight tables (definitions are ours)
# ---------------------------------------------------------------------------

KEYWORD_K = 5
ROLLUP_BUDGET_CHARS = 1_000_000
BLOCK_MAX_CHARS = 500


def _sections(spark, sf_dir):
    return SEC.interview_sections(L.latest_answers(_answers(spark, sf_dir), "interview"))


def _items(spark, sf_dir):
    return SEC.section_items(_sections(spark, sf_dir))


_ITEM_CTES = f"{Q.LATEST_INTERVIEW}, {Q.CONCAT}, {Q.SECTIONS}, {Q.ITEMS}"


@register("section_items", f"""
with {_ITEM_CTES}
select project, interview, ord, tag, item_no, item from items
""")
def q_section_items(spark, sf_dir):
    return _items(spark, sf_dir)


@register("keyword_topk", f"""
with docs as (select source as project, doc_id as interview, text as content from documents),
tok as (select project, interview, unnest(regexp_extract_all(lower(content), '\\p{{L}}+')) as token from docs),
tf as (select project, interview, token, count(*) as tf from tok group by project, interview, token),
df as (select project, token, count(*) as df from tf group by project, token),
n as (select project, count(*) as n_docs from docs group by project),
sc as (select tf.project, tf.interview, tf.token, tf.tf, df.df,
              tf.tf * (ln((n.n_docs + 1) / (df.df + 1)) + 1) as score
       from tf join df on df.project = tf.project and df.token = tf.token join n on n.project = tf.project),
r as (select *, row_number() over (partition by project, interview order by score desc, token) as rank from sc)
select project, interview, cast(rank as integer) as rank, token, tf, df, round(score, 6) as score
from r where rank <= {KEYWORD_K}
""", fixtures=False)
def q_keyword_topk(spark, sf_dir):
    from fieldwork.operators.insights import keyword_topk
    docs = TB.load(spark, sf_dir, "documents").select(
        F.col("source").alias("project"), F.col("doc_id").alias("interview"), F.col("text").alias("content"))
    return keyword_topk(docs, KEYWORD_K)


@register("problem_mentions", f"""
with {_ITEM_CTES}
select i.project, i.interview, i.ord, i.item_no, i.item,
       (length(lower(v.content)) - length(replace(lower(v.content), lower(i.item), ''))) // length(lower(i.item))
         as mentions
from items i join interviews_v v on v.project = i.project and v.interview_id = i.interview
where i.tag = 'problems' and length(i.item) > 0
""")
def q_problem_mentions(spark, sf_dir):
    from fieldwork.operators.insights import problem_mentions
    return problem_mentions(_items(spark, sf_dir), _interviews(spark, sf_dir))


@register("item_connections", f"""
with {_ITEM_CTES},
base as (select project, interview, ord, item_no, item from items where tag = 'codes'),
pairs as (
  select a.project, a.interview, least(a.item, b.item) as item_a, greatest(a.item, b.item) as item_b
  from base a join base b on b.project = a.project and b.interview = a.interview and b.ord = a.ord
                          and b.item_no = a.item_no + 1
  where a.item <> b.item)
select project, item_a, item_b, count(distinct interview) as interviews from pairs group by project, item_a, item_b
""")
def q_item_connections(spark, sf_dir):
    from fieldwork.operators.insights import item_connections_from_sections
    return item_connections_from_sections(_sections(spark, sf_dir), "codes", 1)


GROUP_PERCENT = 50
SUBTOPIC_PERCENT = 80


def _component_cte(name: str, edges: str) -> str:
    return f"""
{name}(project, item, label) using key (project, item) as (
  select project, item, item from nodes
  union
  select e.project, e.other, min(w.label)
  from {name} w join {edges} e on e.project = w.project and e.item = w.item
  join recurring.{name} cur on cur.project = e.project and cur.item = e.other
  where w.label < cur.label
  group by e.project, e.other)"""


@register("item_groups", f"""
with recursive {_ITEM_CTES},
nodes as (select distinct project, item from items where tag = 'codes'),
tok as (select distinct project, item, token
        from (select project, item, unnest(regexp_extract_all(lower(item), '\\p{{L}}+')) as token from nodes) t),
n as (select project, item, count(*) as n from tok group by project, item),
inter as (select a.project, a.item, b.item as hub, count(*) as i from tok a
          join tok b on b.project = a.project and b.token = a.token and a.item < b.item
          group by a.project, a.item, b.item),
sim as (select x.project, x.item, x.hub, x.i * 100 as i100, na.n + nb.n - x.i as u from inter x
        join n na on na.project = x.project and na.item = x.item
        join n nb on nb.project = x.project and nb.item = x.hub),
edges as (select project, item, hub as other from sim where i100 >= u * {GROUP_PERCENT}
          union all select project, hub, item from sim where i100 >= u * {GROUP_PERCENT}),
sub_edges as (select project, item, hub as other from sim where i100 >= u * {SUBTOPIC_PERCENT}
              union all select project, hub, item from sim where i100 >= u * {SUBTOPIC_PERCENT}),
{_component_cte("cc", "edges")},
{_component_cte("sub", "sub_edges")}
select c.project, c.item, c.label as group_label, count(*) over (partition by c.project, c.label) as group_size,
       s.label as subtopic_label
from cc c join sub s on s.project = c.project and s.item = c.item
""")
def q_item_groups(spark, sf_dir):
    from fieldwork.operators.components import item_groups
    return item_groups(_items(spark, sf_dir), "codes", GROUP_PERCENT, SUBTOPIC_PERCENT)


@register("theme_frequency", f"""
with {_ITEM_CTES},
totals as (select project, count(distinct interview) as n from items group by project),
per as (select project, tag, item, count(*) as occurrences, count(distinct interview) as interviews
        from items group by project, tag, item)
select p.project, p.tag, p.item, p.occurrences, p.interviews, round(p.interviews / t.n, 6) as share
from per p join totals t on t.project = p.project
""")
def q_theme_frequency(spark, sf_dir):
    from fieldwork.operators.insights import theme_frequency
    return theme_frequency(_items(spark, sf_dir))


@register("section_rollup", f"""
with {Q.LATEST_INTERVIEW}, {Q.CONCAT}, {Q.SECTIONS},
sized as (
  select project, tag, interview, ord, {Q.normalise('content')} as processed,
         length({Q.normalise('content')}) as len
  from sections),
cum as (
  select *, sum(len) over (partition by project, tag order by interview, ord
                           rows between unbounded preceding and current row) as e
  from sized)
select project, tag, cast(floor((e - len) / {ROLLUP_BUDGET_CHARS}) + 1 as bigint) as chunk_no,
       count(*) as sections, cast(sum(len) as bigint) as chars,
       string_agg(processed, chr(10) order by interview, ord) as text
from cum group by 1, 2, 3
""")
def q_section_rollup(spark, sf_dir):
    from fieldwork.operators.insights import section_rollup
    return section_rollup(_sections(spark, sf_dir), ROLLUP_BUDGET_CHARS)


def _clean_sql(x: str) -> str:
    t = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace({t}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, ' +(\\n|\\z)', '\\1', 'g')"
    return f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


@register("clean_text", f"""
select doc_id, {_clean_sql('text')} as text from documents
""", fixtures=False)
def q_clean_text(spark, sf_dir):
    from fieldwork.operators.insights import clean_documents
    return clean_documents(TB.load(spark, sf_dir, "documents").select("doc_id", "text"))


# The masks that the oracle expects, written out here so that a change of the library's patterns shows.
_EXPECTED_MASKS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", "[EMAIL]"),
    ("secret", "[\"'][0-9a-fA-F]{16,}[\"']", "[SECRET]"),
    ("ipv4", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "[IP]"),
    ("card", r"[0-9]{16}", "[CARD]"),
    ("phone", r"[+]?[0-9]{1,3}[ .-]?[(]?[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-]?[0-9]{4}", "[PHONE]"),
)


def _anonymise_sql() -> str:
    ctes, src, cols = [], "documents", []
    for i, (kind, pattern, mask) in enumerate(_EXPECTED_MASKS):
        keep = ", ".join(["doc_id"] + cols)
        ctes.append(f"s{i} as (select {keep}, len(regexp_extract_all(text, {Q.q(pattern)})) as n_{kind}, "
                    f"regexp_replace(text, {Q.q(pattern)}, {Q.q(mask)}, 'g') as text from {src})")
        cols.append(f"n_{kind}")
        src = f"s{i}"
    return "with " + ",\n".join(ctes) + f"\nselect doc_id, text, {', '.join(cols)} from {src}"


@register("anonymise", _anonymise_sql(), fixtures=False)
def q_anonymise(spark, sf_dir):
    from fieldwork.operators.insights import anonymise_documents
    return anonymise_documents(TB.load(spark, sf_dir, "documents").select("doc_id", "text"))


@register("text_blocks", f"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as line_no
  from documents),
off as (
  select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no
                                                  rows between unbounded preceding and 1 preceding), 0) as o
  from lines)
select doc_id, cast(floor(o / {BLOCK_MAX_CHARS}) as bigint) as block_no,
       string_agg(line, chr(10) order by line_no) as text, count(*) as n_lines
from off group by 1, 2
""", fixtures=False)
def q_text_blocks(spark, sf_dir):
    from fieldwork.operators.insights import text_blocks
    return text_blocks(TB.load(spark, sf_dir, "documents").select("doc_id", "text"), max_chars=BLOCK_MAX_CHARS)


@register("usage_stats", """
select project, model, analysis_type, analysis_step,
       grouping(project, model, analysis_type, analysis_step) as gid,
       count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens,
       cast(sum(output_tokens) as bigint) as output_tokens, round(avg(input_tokens), 6) as avg_input_tokens
from llm_answers_v group by rollup (project, model, analysis_type, analysis_step)
""")
def q_usage_stats(spark, sf_dir):
    from fieldwork.operators.insights import usage_stats
    return usage_stats(_answers(spark, sf_dir))


def _categories_sql() -> str:
    cols = []
    for t in S.TAGS:
        hit = f"tag = {Q.q(t)}"
        cols += [f"cast(sum(case when {hit} then 1 else 0 end) as bigint) as {t}_sections",
                 f"cast(sum(case when {hit} then n_items else 0 end) as bigint) as {t}_items",
                 f"cast(sum(case when {hit} then length(content) else 0 end) as bigint) as {t}_chars"]
    return f"""
with {_ITEM_CTES},
n as (select project, interview, ord, count(*) as n_items from items group by 1, 2, 3),
s as (select s.*, coalesce(n.n_items, 0) as n_items from sections s
      left join n on n.project = s.project and n.interview = s.interview and n.ord = s.ord)
select project, interview, {", ".join(cols)} from s group by project, interview
"""


@register("answer_categories", _categories_sql())
def q_answer_categories(spark, sf_dir):
    from fieldwork.operators.insights import answer_categories
    secs = _sections(spark, sf_dir)
    return answer_categories(secs)


@register("project_trends", """
with daily as (
  select event_type as project, cast(ts as date) as day, count(*) as answers,
         cast(sum(cast(value as decimal(18, 2))) as double) as tokens
  from events group by 1, 2),
firsts as (
  select project, cast(f as date) as day, count(*) as firsts
  from (select event_type as project, min(ts) as f from events group by user_id, event_type) t
  group by 1, 2)
select d.project, strftime(d.day, '%Y-%m-%d') as day, d.answers, d.answers - coalesce(f.firsts, 0) as reruns,
       d.tokens, d.answers - lag(d.answers) over (partition by d.project order by d.day) as change
from daily d left join firsts f on f.project = d.project and f.day = d.day
""", fixtures=False)
def q_project_trends(spark, sf_dir):
    from fieldwork.operators.insights import project_trends
    ev = TB.load(spark, sf_dir, "events")
    return project_trends(ev, "event_type", ["user_id", "event_type"], "ts", "event_id", "value")


# ---------------------------------------------------------------------------
# 2.7 the stage-switched job / 2.10 streaming forms
# ---------------------------------------------------------------------------

def _report_ctes(src: str, p: str) -> str:
    """Interviews-report CTEs over answers ``src(project, interview, analysis_step, answer_content)``."""
    return f"""
{p}concat as (
  select project, interview, string_agg(answer_content, chr(10) order by analysis_step) as answers_text
  from {src} group by project, interview),
{p}sections as ({Q.sections_from(p + 'concat', 'project, interview', 'answers_text')}),
{p}numbered as (
  select project, interview, row_number() over (partition by project order by interview) as report_no
  from {p}concat),
{p}bodies as (
  select project, interview,
         string_agg(chr(10) || {Q.label('tag')} || chr(10) || {Q.normalise('content')} || chr(10), ''
                    order by ord) as body
  from {p}sections group by project, interview),
{p}report as (
  select n.project, n.interview, n.report_no,
         {Q.text_lit(S.INTERVIEW_HEADER)} || cast(n.report_no as varchar) || coalesce(b.body, '') as report_block
  from {p}numbered n left join {p}bodies b on b.project = n.project and b.interview = n.interview)"""


@register("stage_flags", f"""
with {_CHAIN_CTES},
job as (
  select h.project, h.interview, h.analysis_step, coalesce(h.answer_content, '') as answer_content
  from have h left join first_fail f on f.project = h.project and f.interview = h.interview
  where h.ok and (f.failed_step is null or h.analysis_step < f.failed_step)),
{_report_ctes('job', 'j_')},
{_SUMMARY_CTES}
select r.project, p.project_name, 'interviews' as report_type, r.report_no as block_no, r.report_block as text
from j_report r join projects_v p on p.project_id = r.project
union all
select project, project_name, 'summary', 1, summary from summary_q
where project in (select project from j_report)
""")
def q_stage_flags(spark, sf_dir):
    from fieldwork.operators import scoring as SC
    from fieldwork.operators.store import validate_rows
    from fieldwork.plans.job import Store, run_job
    from fieldwork.session import scratch_path
    answers = _answers(spark, sf_dir)
    store = Store(spark, scratch_path(spark, "store"))
    store.append(TB.projects_fixture(spark, sf_dir), "projects")
    store.append(validate_rows(_interviews(spark, sf_dir), "interviews")[0], "interviews")
    recorded = L.latest_answers(answers, "interview")
    recorded_p = L.latest_answers(answers, "project")
    return run_job(spark, store, process_interviews=True, process_project=True,
                   responder=SC.replay_responder(recorded), project_responder=SC.replay_responder(recorded_p),
                   project_budget_chars=PROJECT_BUDGET_CHARS)


@register("stream_ingest", _INGEST_SQL, fixtures=False)
def q_stream_ingest(spark, sf_dir):
    from fieldwork.session import delete_folder, scratch_path
    from fieldwork.streaming.ingest import read_ingested, stream_ingest
    root = _docs_as_files(spark, sf_dir)
    table = scratch_path(spark, "stream-table")
    stream_ingest(spark, root, table, scratch_path(spark, "stream-ckpt"), layout="hive")
    delete_folder(spark, root)  # the stream has ended, and nothing reads the files again
    return _ingested_view(read_ingested(spark, table))


@register("stream_latest", f"""
with {Q.LATEST_INTERVIEW}
select project, interview, analysis_step, id, answer_content from latest
""")
def q_stream_latest(spark, sf_dir):
    from fieldwork.session import scratch_path
    from fieldwork.streaming.latest import current_view, stream_latest
    log_dir = scratch_path(spark, "answer-log")
    log = _answers(spark, sf_dir)
    # the log arrives as several files in no particular order
    log.repartition(8).write.parquet(log_dir)
    out = scratch_path(spark, "latest-updates")
    stream_latest(spark, log_dir, out, scratch_path(spark, "latest-ckpt"), schema=log.schema,
                  max_files_per_trigger=4, state_partitions=spark.sparkContext.defaultParallelism)
    return current_view(spark, out)
