"""Column expressions for answer texts.

Everything here returns a ``Column`` built from JVM-side functions (regex,
higher-order functions, string functions), so it runs inside the executor JVM
with no Python worker and composes into any projection.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldwork import schemas as S

_WS = S.whitespace_class()
_WS_CHARS = S.whitespace_chars()
_NL = "\n"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tag_pattern(tags: Iterable[str] = S.TAGS) -> str:
    """``<tag> ws* (content, lazy) ws* </tag>`` with a back-reference, dot-all."""
    alternatives = "|".join(tags)
    return f"(?s)<({alternatives})>{_WS}*(.*?){_WS}*</\\1>"


def extract_sections(text, tags: Iterable[str] = S.TAGS) -> Column:
    """All ``(tag, content)`` matches of the tag pattern, leftmost and non-overlapping.

    Both arrays come from the same ``find`` loop over the same pattern, so they
    line up position by position.  Returns ``ARRAY<STRUCT<tag, content>>``.
    """
    pat = F.lit(tag_pattern(tuple(tags)))
    t = _col(text)
    return F.arrays_zip(
        F.regexp_extract_all(t, pat, F.lit(1)).alias("tag"),
        F.regexp_extract_all(t, pat, F.lit(2)).alias("content"),
    )


def _strip_ws(x: Column) -> Column:
    return F.btrim(x, F.lit(_WS_CHARS))


def _nonblank_lines(text) -> Column:
    return F.filter(F.split(_col(text), _NL, -1), lambda line: _strip_ws(line) != F.lit(""))


def clean_line(line: Column) -> Column:
    """One line stripped of ``-`` and spaces at both ends, then of all whitespace."""
    return _strip_ws(F.btrim(line, F.lit("- ")))


def normalise_lines(text) -> Column:
    """Non-blank lines, each cleaned and ended with ``.``, joined by one space."""
    return F.array_join(F.transform(_nonblank_lines(text), lambda x: F.concat(clean_line(x), F.lit("."))), " ")


def item_lines(text) -> Column:
    """Non-blank lines cleaned as in ``normalise_lines`` but without the period."""
    return F.transform(_nonblank_lines(text), clean_line)


def literal_map(mapping: dict) -> Column:
    """A constant ``MAP`` column (no join needed for a fixed lookup table)."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def tag_label(tag) -> Column:
    return F.element_at(literal_map(S.TAG_LABELS), _col(tag))


def summary_order(tag) -> Column:
    return F.element_at(literal_map(S.SUMMARY_ORDER), _col(tag))


def labelled_block(tag, processed) -> Column:
    """``"\\n{label}\\n{processed}\\n"``."""
    return F.concat(F.lit(_NL), tag_label(tag), F.lit(_NL), _col(processed), F.lit(_NL))


def interview_report_block(report_no, sections) -> Column:
    """Header with the running number followed by every labelled section, in match order."""
    body = F.array_join(
        F.transform(sections, lambda s: labelled_block(s["tag"], normalise_lines(s["content"]))), "")
    return F.concat(F.lit(S.INTERVIEW_HEADER), _col(report_no).cast("string"), F.coalesce(body, F.lit("")))


# ---------------------------------------------------------------------------
# Prompts
# ---------------------------------------------------------------------------

_MARKERS = ("raw_interview", "previous_answers")


def with_language_suffix(template, suffix: str = S.LANGUAGE_SUFFIX) -> Column:
    return F.concat(_col(template), F.lit(suffix))


def render_prompt(template, raw_interview, previous_answers) -> Column:
    """Fill ``{raw_interview}`` / ``{previous_answers}`` in one pass.

    The template is split on its markers once and the pieces are concatenated
    with the values, so a value that itself contains a marker is left as it is
    (chained ``replace`` would substitute it again).  A missing value renders as
    ``None``, as Python formatting of a missing answer does.
    """
    t = _col(template)
    marker_re = r"\{(" + "|".join(_MARKERS) + r")\}"
    parts = F.split(t, marker_re, -1)
    markers = F.regexp_extract_all(t, F.lit(marker_re), F.lit(1))
    raw = F.coalesce(_col(raw_interview).cast("string"), F.lit("None"))
    prev = F.coalesce(_col(previous_answers).cast("string"), F.lit("None"))
    filled = F.transform(
        markers,
        lambda m, i: F.concat(F.when(m == F.lit("raw_interview"), raw).otherwise(prev),
                              F.element_at(parts, i + 2)))
    return F.concat(F.element_at(parts, 1), F.array_join(filled, ""))


def default_temperature(temperature, default: float = S.DEFAULT_TEMPERATURE) -> Column:
    """Plan temperature, or the default where the plan leaves it unset (0 is kept)."""
    return F.coalesce(_col(temperature), F.lit(float(default)))


# ---------------------------------------------------------------------------
# Text preparation (cleaning, masking, blocks)
# ---------------------------------------------------------------------------

_CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]"


def clean_text(text) -> Column:
    """Line ends to ``\\n``; control characters dropped; runs of blanks to one
    space; blanks before a line end removed; three or more line breaks to two."""
    t = F.regexp_replace(_col(text), r"\r\n?", "\n")
    t = F.regexp_replace(t, _CONTROL, "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" +(\n|\z)", "$1")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


# Masks applied in this order; each pattern runs on the text left by the ones
# before.  The last field lists characters every match must contain: a text
# without any of them is skipped (the masks add none of these characters).
PII_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", "@"),
    ("secret", "[\"'][0-9a-fA-F]{16,}[\"']", "[SECRET]", "\"'"),
    ("ipv4", r"[0-9]{1,3}(\.[0-9]{1,3}){3}", "[IP]", "0123456789"),
    ("card", r"[0-9]{16}", "[CARD]", "0123456789"),
    ("phone", r"\+?[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}", "[PHONE]", "0123456789"),
)


def contains_any(text, chars: str) -> Column:
    """True when ``text`` holds at least one of ``chars`` (one literal scan per
    character for short sets, one character-class scan otherwise)."""
    t = _col(text)
    if len(chars) <= 2:
        cond = None
        for ch in chars:
            c = F.instr(t, ch) > 0
            cond = c if cond is None else cond | c
        return cond
    cls = "".join("\\" + ch if ch in "\\^-]" else ch for ch in chars)
    return F.regexp_like(t, F.lit(f"[{cls}]"))


def word_tokens(text) -> Column:
    """Lower-cased runs of letters (``\\p{L}+``), as the pieces between runs of
    non-letters (a split is cheaper than extracting every match)."""
    return F.filter(F.split(F.lower(_col(text)), r"\P{L}+", -1), lambda x: x != F.lit(""))
