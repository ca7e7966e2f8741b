"""Table schemas, fixed values and the question plan."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the original tool's values for the reports
# and prompts to come out the same; they are listed plainly, in their natural
# order, and are not derived from anything.
# ---------------------------------------------------------------------------

# Section tags recognised in model answers, in the order of the tag pattern.
TAGS = (
    "keywords",
    "codes",
    "code_connections",
    "code_groups",
    "problems",
    "problem_connections",
    "problem_groups",
    "reflections",
    "results",
    "unexpected",
    "hypothesis",
    "alternatives",
    "additionals",
)

# Heading printed above each section in the interviews report.
TAG_LABELS = {
    "keywords": "Ключевые фразы интервью:",
    "codes": "Кодирование интервью:",
    "code_connections": "Взаимосвязи кодов:",
    "code_groups": "Группировка кодов:",
    "problems": "Проблемы обозначенные в интервью:",
    "problem_connections": "Взаимосвязи обозначенных проблем:",
    "problem_groups": "Группировка обозначенных проблем:",
    "reflections": "Проблемы и частота их появления:",
    "results": "Анализ проблем:",
    "unexpected": "Неожиданные закономерности в ответах:",
    "hypothesis": "Гипотезы возникновения проблем:",
    "alternatives": "Альтернативные объяснения проблем:",
    "additionals": "Дополнительные исследования:",
}

# Order of the sections in the project summary; tags not listed are left out.
SUMMARY_TAG_ORDER = (
    "results",
    "problems",
    "problem_connections",
    "problem_groups",
    "unexpected",
    "hypothesis",
    "alternatives",
    "additionals",
    "codes",
    "code_connections",
    "code_groups",
)

# Report formats.
INTERVIEW_HEADER = "\nИНТЕРВЬЮ № "           # followed by the running number
SUMMARY_HEADER = "ИТОГОВЫЕ РЕЗУЛЬТАТЫ ПО ПРОЕКТУ "  # followed by the project name

# Line appended to every prompt template.
LANGUAGE_SUFFIX = "\nВнимание, это важно! Всегда отправляйте полный текст ответа только на русском языке. Спасибо!"

# Model call settings.
DEFAULT_TEMPERATURE = 0.25
MAX_OUTPUT_TOKENS = 4096
PAUSE_SECONDS = 30

# Whitespace removed by Python's str.strip() and matched by its regex \s:
# inclusive code-point ranges.
WHITESPACE_RANGES = (
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)

# ---------------------------------------------------------------------------
# Derived helpers
# ---------------------------------------------------------------------------

REPORT_ORDER = {tag: i + 1 for i, tag in enumerate(TAG_LABELS)}
SUMMARY_ORDER = {tag: i + 1 for i, tag in enumerate(SUMMARY_TAG_ORDER)}


def whitespace_chars() -> str:
    """All whitespace characters as one string (for ``btrim``)."""
    return "".join(chr(c) for lo, hi in WHITESPACE_RANGES for c in range(lo, hi + 1))


def whitespace_class() -> str:
    """The whitespace set as a regex character class that Java and RE2 both read."""
    parts = []
    for lo, hi in WHITESPACE_RANGES:
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "[" + "".join(parts) + "]"


# ---------------------------------------------------------------------------
# Question plan.  Temperatures, chaining and requested tags follow the original
# plan; the template wording is our own.  ``None`` temperature = default.
# ---------------------------------------------------------------------------

_INTERVIEW_INTRO = ("Read the interview below carefully and follow the steps.\n"
                    "<interview>{raw_interview}</interview>\n"
                    "Use only what the interview says; do not invent anything.\n")

QUESTION_PLAN = (
    {
        "analysis_type": "interview", "analysis_step": 1, "llm_temperature": None,
        "input_variables": ["raw_interview"], "uses_previous": False,
        "text_template": _INTERVIEW_INTRO
        + "List the key phrases that carry the main ideas (tag <keywords>).\n"
          "Give each phrase a short descriptive code (tag <codes>).\n",
    },
    {
        "analysis_type": "interview", "analysis_step": 2, "llm_temperature": None,
        "input_variables": ["raw_interview", "previous_answers"], "uses_previous": True,
        "text_template": _INTERVIEW_INTRO
        + "Codes found before: <interview_code>{previous_answers}</interview_code>\n"
          "Describe links among these codes (tag <code_connections>).\n"
          "Group related codes into broader themes (tag <code_groups>).\n"
          "Name subtopics inside each theme (tag <code_groups_subtopics>).\n",
    },
    {
        "analysis_type": "interview", "analysis_step": 3, "llm_temperature": None,
        "input_variables": ["raw_interview"], "uses_previous": False,
        "text_template": _INTERVIEW_INTRO
        + "List every concrete problem the respondent mentions and how often (tag <problems>).\n",
    },
    {
        "analysis_type": "interview", "analysis_step": 4, "llm_temperature": None,
        "input_variables": ["raw_interview", "previous_answers"], "uses_previous": True,
        "text_template": _INTERVIEW_INTRO
        + "Problems found before: <interview_problems>{previous_answers}</interview_problems>\n"
          "Describe links among the problems (tag <problem_connections>).\n"
          "Group the problems into broader types (tag <problem_groups>).\n",
    },
    {
        "analysis_type": "interview", "analysis_step": 5, "llm_temperature": 0.5,
        "input_variables": ["raw_interview", "previous_answers"], "uses_previous": True,
        "text_template": _INTERVIEW_INTRO
        + "Problem categories found before: <interview_problems>{previous_answers}</interview_problems>\n"
          "Reflect on themes and problem frequency (tag <reflections>); what they say about the "
          "respondent (tag <results>); unexpected patterns (tag <unexpected>); hypotheses (tag "
          "<hypothesis>); alternative explanations (tag <alternatives>); further research (tag "
          "<additionals>).\n",
    },
    {
        "analysis_type": "project", "analysis_step": 1, "llm_temperature": 0.3,
        "input_variables": ["raw_interview"], "uses_previous": False,
        "text_template": "Summarise every section across all interview notes below, one tag per "
                         "section (keywords, codes, code_connections, code_groups, problems, "
                         "problem_connections, problem_groups, reflections, results, unexpected, "
                         "hypothesis, alternatives, additionals).\n"
                         "<interview>{raw_interview}</interview>\n",
    },
)

PLAN_SCHEMA = T.StructType([
    T.StructField("analysis_type", T.StringType(), False),
    T.StructField("analysis_step", T.IntegerType(), False),
    T.StructField("llm_temperature", T.DoubleType(), True),
    T.StructField("input_variables", T.ArrayType(T.StringType()), False),
    T.StructField("uses_previous", T.BooleanType(), False),
    T.StructField("text_template", T.StringType(), False),
])

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------

PROJECTS_SCHEMA = T.StructType([
    T.StructField("project_id", T.LongType(), False),
    T.StructField("project_name", T.StringType(), False),
])

INTERVIEWS_SCHEMA = T.StructType([
    T.StructField("interview_id", T.LongType(), False),
    T.StructField("project", T.LongType(), False),
    T.StructField("date", T.TimestampNTZType(), True),
    T.StructField("content", T.StringType(), False),
    T.StructField("path", T.StringType(), True),  # of an ingested file, its identity
])

ANSWERS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("project", T.LongType(), False),
    T.StructField("interview", T.LongType(), True),
    T.StructField("analysis_type", T.StringType(), False),
    T.StructField("analysis_step", T.IntegerType(), True),
    T.StructField("created", T.TimestampNTZType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("input_tokens", T.IntegerType(), False),
    T.StructField("output_tokens", T.IntegerType(), False),
    T.StructField("prompt", T.StringType(), False),
    T.StructField("answer_full", T.StringType(), True),
    T.StructField("answer_content", T.StringType(), True),
    T.StructField("answer_content_clear", T.StringType(), True),
])

REJECTS_SCHEMA = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("reason", T.StringType(), False),
    T.StructField("payload", T.StringType(), True),
])

RESPONSE_SCHEMA = T.StructType([
    T.StructField("content", T.StringType(), True),
    T.StructField("model", T.StringType(), True),
    T.StructField("input_tokens", T.IntegerType(), True),
    T.StructField("output_tokens", T.IntegerType(), True),
    T.StructField("error", T.StringType(), True),
])
