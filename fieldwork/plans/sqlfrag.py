"""DuckDB SQL fragments for the oracle queries (same definitions, other engine).

DuckDB's regex engine (RE2) has no back-references, so the tag pattern is an
alternation of one branch per tag; the tag and the content of a match are then
read by a second, anchored pattern.
"""

from __future__ import annotations

import re

from fieldwork import schemas as S

WS = S.whitespace_class()
WS_CHARS = " || ".join(f"chr({c})" for lo, hi in S.WHITESPACE_RANGES for c in range(lo, hi + 1))


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def text_lit(s: str) -> str:
    """SQL expression for a string that may hold line breaks."""
    return " || chr(10) || ".join(q(p) for p in s.split("\n"))


def tag_alternation(tags=S.TAGS) -> str:
    return "(?s)" + "|".join(f"<{t}>{WS}*.*?{WS}*</{t}>" for t in tags)


def match_tag(m: str) -> str:
    return f"regexp_extract({m}, '^<([a-z_]+)>', 1)"


def match_content(m: str) -> str:
    return f"regexp_extract({m}, '(?s)^<[a-z_]+>{WS}*(.*?){WS}*</[a-z_]+>$', 1)"


def strip_ws(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def nonblank_lines(text: str) -> str:
    return f"list_filter(string_split({text}, chr(10)), lambda x: {strip_ws('x')} <> '')"


def clean_line(x: str) -> str:
    return strip_ws(f"trim({x}, '- ')")


def normalise(text: str) -> str:
    return (f"array_to_string(list_transform({nonblank_lines(text)}, "
            f"lambda x: {clean_line('x')} || '.'), ' ')")


def item_lines(text: str) -> str:
    return f"list_transform({nonblank_lines(text)}, lambda x: {clean_line('x')})"


def case_map(col: str, mapping: dict, default: str = "null") -> str:
    whens = " ".join(f"when {q(k)} then {q(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"case {col} {whens} else {default} end"


def label(tag: str) -> str:
    return case_map(tag, S.TAG_LABELS)


def summary_order(tag: str) -> str:
    return case_map(tag, S.SUMMARY_ORDER)


def sections_from(source: str, keys: str, text_col: str) -> str:
    """``select keys, ord, tag, content`` of every tag match in ``text_col``."""
    return f"""
select {keys}, cast(ord as integer) as ord, {match_tag('m')} as tag, {match_content('m')} as content
from (select {keys}, unnest(ms) as m, generate_subscripts(ms, 1) as ord
      from (select {keys}, regexp_extract_all({text_col}, '{tag_alternation()}') as ms from {source}))
"""


LATEST_INTERVIEW = """
latest as (
  select id, project, interview, analysis_step, answer_content, model, input_tokens, output_tokens from (
    select *, row_number() over (partition by project, interview, analysis_step
                                 order by created desc, id desc) as rn
    from llm_answers_v where analysis_type = 'interview') t where rn = 1)"""

LATEST_PROJECT = """
latest_p as (
  select id, project, interview, analysis_step, answer_content, model, input_tokens, output_tokens from (
    select *, row_number() over (partition by project, interview, analysis_step
                                 order by created desc, id desc) as rn
    from llm_answers_v where analysis_type = 'project') t where rn = 1)"""

CONCAT = """
concat_a as (
  select project, interview, string_agg(answer_content, chr(10) order by analysis_step) as answers_text
  from latest group by project, interview)"""

FIRST_PROJECT = """
first_p as (
  select project, arg_min(answer_content, (analysis_step, id)) as answer_content
  from latest_p group by project)"""

SECTIONS = f"""
sections as ({sections_from('concat_a', 'project, interview', 'answers_text')})"""


def prompt(template: str, raw: str, prev: str) -> str:
    """Template pieces and values concatenated (markers split once, in Python)."""
    parts = re.split(r"\{(raw_interview|previous_answers)\}", template)
    expr = [text_lit(parts[0])]
    for i in range(1, len(parts), 2):
        value = raw if parts[i] == "raw_interview" else prev
        expr += [f"coalesce({value}, 'None')", text_lit(parts[i + 1])]
    return " || ".join(expr)


def plan_values(analysis_type: str) -> str:
    """The plan steps of one type as a VALUES table
    ``(analysis_step, call_no, temperature, uses_previous)``."""
    steps = sorted((p for p in S.QUESTION_PLAN if p["analysis_type"] == analysis_type),
                   key=lambda p: p["analysis_step"])
    rows = ", ".join(
        f"({p['analysis_step']}, {i}, cast({p['llm_temperature'] if p['llm_temperature'] is not None else S.DEFAULT_TEMPERATURE} as double), "
        f"{'true' if p['uses_previous'] else 'false'})" for i, p in enumerate(steps, start=1))
    return f"(values {rows}) as plan(analysis_step, call_no, temperature, uses_previous)"


def prompt_case(analysis_type: str, raw: str, prev: str, step_col: str = "analysis_step") -> str:
    steps = [p for p in S.QUESTION_PLAN if p["analysis_type"] == analysis_type]
    whens = " ".join(
        f"when {p['analysis_step']} then {prompt(p['text_template'] + S.LANGUAGE_SUFFIX, raw, prev)}" for p in steps)
    return f"case {step_col} {whens} end"


def template_case(analysis_type: str, step_col: str = "analysis_step") -> str:
    steps = [p for p in S.QUESTION_PLAN if p["analysis_type"] == analysis_type]
    whens = " ".join(f"when {p['analysis_step']} then {text_lit(p['text_template'] + S.LANGUAGE_SUFFIX)}"
                     for p in steps)
    return f"case {step_col} {whens} end"


ITEMS = f"""
items as (
  select project, interview, ord, tag, item, cast(item_no as integer) as item_no
  from (select project, interview, ord, tag, unnest({item_lines('content')}) as item,
               generate_subscripts({item_lines('content')}, 1) as item_no
        from sections) t)"""
