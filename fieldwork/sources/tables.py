"""Table loaders and the fixture views derived from the given tables.

The test tables hold no interview answers, so the answer log and the
interviews are derived from ``conversations`` (and projects / interviews from
``documents``).  The same derivations are written as DuckDB SQL
(``*_SQL`` below) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork import schemas as S

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_INTERVIEW_TAGS_BY_STEP = {
    1: ("keywords", "codes"),
    2: ("code_connections", "code_groups"),
    3: ("problems",),
    4: ("problem_connections", "problem_groups"),
    5: ("reflections", "results", "unexpected", "hypothesis", "alternatives", "additionals"),
}

def _wrap(tags, body: F.Column) -> F.Column:
    pieces = []
    for i, tag in enumerate(tags):
        if i:
            pieces.append(F.lit("\n"))
        pieces += [F.lit(f"<{tag}>\n"), body, F.lit(f"\n</{tag}>")]
    return F.concat(*pieces)


def answers_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``llm_answers_v``: an answer log with re-runs, derived from conversations.

    Turns 5-7 are second versions of steps 1-3; ``system`` turns also give one
    project-level answer each.
    """
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    base = conv.select(
        "conv_id", "turn", "role",
        F.concat(F.lit("- "), F.replace(F.col("text"), F.lit(". "), F.lit(".\n- "))).alias("b"),
        F.length("text").alias("n"))
    step = (F.col("turn") % 5 + 1).cast("int")
    content = F.when(step == 1, _wrap(_INTERVIEW_TAGS_BY_STEP[1], F.col("b")))
    for s in (2, 3, 4):
        content = content.when(step == s, _wrap(_INTERVIEW_TAGS_BY_STEP[s], F.col("b")))
    content = content.otherwise(_wrap(_INTERVIEW_TAGS_BY_STEP[5], F.col("b")))
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    interview_rows = base.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        (F.col("conv_id") % 7).alias("project"),
        F.col("conv_id").alias("interview"),
        F.lit("interview").alias("analysis_type"),
        step.alias("analysis_step"),
        (t0 + F.make_dt_interval(mins=F.col("turn").cast("int"))).alias("created"),
        F.when(F.col("role") == "user", "model-a").otherwise("model-b").alias("model"),
        F.col("n").cast("int").alias("input_tokens"),
        (F.col("n") % 97).cast("int").alias("output_tokens"),
        content.alias("answer_content"))
    p0 = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    project_rows = base.where(F.col("role") == "system").select(
        (F.lit(1000000000) + F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        (F.col("conv_id") % 7).alias("project"),
        F.lit(None).cast("bigint").alias("interview"),
        F.lit("project").alias("analysis_type"),
        F.lit(1).alias("analysis_step"),
        (p0 + F.make_dt_interval(mins=F.col("conv_id").cast("int"))).alias("created"),
        F.lit("model-p").alias("model"),
        F.col("n").cast("int").alias("input_tokens"),
        (F.col("n") % 97).cast("int").alias("output_tokens"),
        _wrap(S.TAGS, F.col("b")).alias("answer_content"))
    return interview_rows.unionByName(project_rows)


def interviews_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``interviews_v``: one interview per conversation, turns joined in order."""
    conv = load(spark, sf_dir, "conversations")
    return (conv.groupBy("conv_id")
            .agg(F.expr("listagg(concat(role, ': ', text), '\\n') within group (order by turn)")
                 .alias("content"))
            .select(F.col("conv_id").alias("interview_id"),
                    (F.col("conv_id") % 7).alias("project"),
                    F.lit(None).cast("timestamp_ntz").alias("date"),
                    "content"))


def projects_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for the fixture projects: ``p<id>``."""
    conv = load(spark, sf_dir, "conversations")
    return (conv.select((F.col("conv_id") % 7).alias("project_id")).distinct()
            .select("project_id", F.concat(F.lit("p"), F.col("project_id").cast("string")).alias("project_name")))


def document_interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as interviews: project name = ``source``, interview = ``doc_id``."""
    docs = load(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("interview_id"), F.col("source").alias("project_name"),
                       F.col("text").alias("content"))


# ---------------------------------------------------------------------------
# The same fixtures for DuckDB (used by the oracle SQL).
# ---------------------------------------------------------------------------

def _wrap_sql(tags) -> str:
    return "\n      || chr(10) || ".join(
        f"'<{t}>' || chr(10) || b || chr(10) || '</{t}>'" for t in tags)


ANSWERS_SQL = f"""
with base as (
  select conv_id, turn, role,
         '- ' || replace(text, '. ', '.' || chr(10) || '- ') as b,
         length(text) as n
  from conversations)
select conv_id * 100 + turn as id, conv_id % 7 as project, conv_id as interview,
       'interview' as analysis_type, cast(turn % 5 + 1 as integer) as analysis_step,
       timestamp '2024-01-01 00:00:00' + turn * interval '1' minute as created,
       case role when 'user' then 'model-a' else 'model-b' end as model,
       cast(n as integer) as input_tokens, cast(n % 97 as integer) as output_tokens,
       case turn % 5 + 1
       when 1 then {_wrap_sql(_INTERVIEW_TAGS_BY_STEP[1])}
       when 2 then {_wrap_sql(_INTERVIEW_TAGS_BY_STEP[2])}
       when 3 then {_wrap_sql(_INTERVIEW_TAGS_BY_STEP[3])}
       when 4 then {_wrap_sql(_INTERVIEW_TAGS_BY_STEP[4])}
       else {_wrap_sql(_INTERVIEW_TAGS_BY_STEP[5])} end as answer_content
from base
union all
select 1000000000 + conv_id * 100 + turn, conv_id % 7, cast(null as bigint), 'project', 1,
       timestamp '2024-02-01 00:00:00' + conv_id * interval '1' minute,
       'model-p', cast(n as integer), cast(n % 97 as integer),
       {_wrap_sql(S.TAGS)}
from base where role = 'system'
"""

INTERVIEWS_SQL = """
select conv_id as interview_id, conv_id % 7 as project,
       cast(null as timestamp) as date,
       string_agg(role || ': ' || text, chr(10) order by turn) as content
from conversations group by conv_id
"""

PROJECTS_SQL = """
select distinct conv_id % 7 as project_id, 'p' || cast(conv_id % 7 as varchar) as project_name
from conversations
"""


def with_fixtures(sql: str) -> str:
    """Prefix an oracle query with the fixture views as CTEs."""
    head = (f"with llm_answers_v as ({ANSWERS_SQL}),\n"
            f"interviews_v as ({INTERVIEWS_SQL}),\n"
            f"projects_v as ({PROJECTS_SQL})")
    body = sql.strip()
    if body[:15].lower() == "with recursive ":
        return f"with recursive {head[5:]},\n{body[15:]}"
    if body[:5].lower() == "with ":
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"
