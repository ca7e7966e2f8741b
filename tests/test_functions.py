"""Golden cases and property tests for the text expressions (R20, R22, R23)."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldwork import schemas as S
from fieldwork.functions import text as T

def _trim(chars: list[str], drop) -> list[str]:
    first, last = 0, len(chars)
    while first < last and drop(chars[first]):
        first += 1
    while last > first and drop(chars[last - 1]):
        last -= 1
    return chars[first:last]


def py_normalise(text: str) -> str:
    """Line by line: blank lines go; dashes and blanks, then white space, are trimmed; a full stop ends each."""
    out = ""
    for line in text.split("\n"):
        chars = list(line)
        if all(c.isspace() for c in chars):
            continue
        chars = _trim(_trim(chars, lambda c: c in "- "), str.isspace)
        out += (" " if out else "") + "".join(chars) + "."
    return out


def py_sections(text: str):
    """A scanner: the next opening tag that has a closing tag after it; the first such closing tag ends the section."""
    found, at = [], 0
    while (at := text.find("<", at)) >= 0:
        for tag in S.TAGS:
            begin = at + len(tag) + 2
            if text[at:begin] == f"<{tag}>" and (end := text.find(f"</{tag}>", begin)) >= 0:
                body = _trim(list(text[begin:end]), str.isspace)
                found.append((tag, "".join(body)))
                at = end + len(tag) + 3
                break
        else:
            at += 1
    return found


def _one(spark, col_fn, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col_fn(F.col("v"))).collect()]


def test_whitespace_set_matches_python():
    assert set(S.whitespace_chars()) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


NORMALISE_CASES = [
    ("- a\n- b", "a. b."),
    ("", ""),
    ("  \n\t", ""),
    ("---", "."),
    ("a.\n\nb", "a.. b."),
    ("-\tfoo", "foo."),
    ("\t- foo", "- foo."),
    ("- a -", "a."),
    ("a\r\nb\r", "a. b."),
    ("- a-b -c-", "a-b -c."),
]


def test_normalise_golden(spark):
    got = _one(spark, T.normalise_lines, [c[0] for c in NORMALISE_CASES])
    assert got == [c[1] for c in NORMALISE_CASES]
    assert [py_normalise(c[0]) for c in NORMALISE_CASES] == [c[1] for c in NORMALISE_CASES]


SECTION_CASES = [
    ("<keywords> x </keywords>", [("keywords", "x")]),
    ("<keywords>a", []),
    ("<codes>a\n<codes>b</codes>", [("codes", "a\n<codes>b")]),
    ("<problems>a <results>r</results></problems>", [("problems", "a <results>r</results>")]),
    ("<results>1</results><results>2</results>", [("results", "1"), ("results", "2")]),
    ("<Codes>x</Codes>", []),
    ("<codes>a</code_groups></codes>", [("codes", "a</code_groups>")]),
    ("<code_groups_subtopics>s</code_groups_subtopics>", []),
    ("<codes>open in step 1\n<code_groups>g</code_groups></codes>",
     [("codes", "open in step 1\n<code_groups>g</code_groups>")]),
    ("<codes></codes>", [("codes", "")]),
]


def test_sections_golden(spark):
    got = _one(spark, T.extract_sections, [c[0] for c in SECTION_CASES])
    assert [[(s["tag"], s["content"]) for s in row] for row in got] == [c[1] for c in SECTION_CASES]
    assert [py_sections(c[0]) for c in SECTION_CASES] == [c[1] for c in SECTION_CASES]


_ALPHABET = st.sampled_from(
    ["<", ">", "/", "a", "-", " ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "　", ".", "x"]
    + [f"<{t}>" for t in ("codes", "keywords", "results")] + [f"</{t}>" for t in ("codes", "keywords", "results")])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(_ALPHABET, max_size=30).map("".join), min_size=1, max_size=40))
def test_sections_and_normalise_match_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    rows = df.select(T.extract_sections("v").alias("s"), T.normalise_lines("v").alias("n")).collect()
    for text, row in zip(texts, rows):
        assert [(s["tag"], s["content"]) for s in row["s"]] == py_sections(text)
        assert row["n"] == py_normalise(text)


def test_render_prompt_single_pass(spark):
    df = spark.createDataFrame([("T {raw_interview} P {previous_answers}", "see {previous_answers}", "ANS")],
                               "t string, r string, p string")
    got = df.select(T.render_prompt("t", "r", "p")).first()[0]
    assert got == "T see {previous_answers} P ANS"


def test_render_prompt_missing_value(spark):
    df = spark.createDataFrame([("A {previous_answers} B", "x", None)], "t string, r string, p string")
    assert df.select(T.render_prompt("t", "r", "p")).first()[0] == "A None B"


def test_default_temperature_keeps_zero(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.5,)], "t double")
    assert [r[0] for r in df.select(T.default_temperature("t")).collect()] == [0.25, 0.0, 0.5]


@pytest.mark.parametrize("text,expected", [
    ("a\r\nb", "a\nb"),
    ("a  \t b \nc", "a b\nc"),
    ("x\x00y\x07", "xy"),
    ("a\n\n\n\nb  ", "a\n\nb"),
])
def test_clean_text(spark, text, expected):
    assert _one(spark, T.clean_text, [text]) == [expected]


def test_anonymise_counts_and_masks(spark):
    from fieldwork.operators.insights import anonymise_documents
    text = 'mail a.b@x.example.com, ip 10.0.0.1, card 4111111111111111, tel +1 (555) 123-4567, key "0123456789abcdef0123"'
    df = spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in anonymise_documents(df).collect()}
    r = rows[1]
    assert (r["n_email"], r["n_secret"], r["n_ipv4"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1, 1)
    assert r["text"] == "mail [EMAIL], ip [IP], card [CARD], tel [PHONE], key [SECRET]"
    assert rows[2]["text"] == "nothing here" and rows[2]["n_email"] == 0


_MARK = st.sampled_from(["{raw_interview}", "{previous_answers}", "x", " ", "\n", "é", "}", "{raw", "."])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.lists(_MARK, max_size=8).map("".join),
                          st.lists(_MARK, max_size=5).map("".join),
                          st.lists(_MARK, max_size=5).map("".join)), min_size=1, max_size=20))
def test_render_prompt_matches_single_pass_substitution(spark, cases):
    def py_render(t, raw, prev):
        out, i = [], 0
        pat = re.compile(r"\{(raw_interview|previous_answers)\}")
        for m in pat.finditer(t):
            out += [t[i:m.start()], raw if m.group(1) == "raw_interview" else prev]
            i = m.end()
        return "".join(out) + t[i:]

    df = spark.createDataFrame(cases, "t string, r string, p string")
    got = [r[0] for r in df.select(T.render_prompt("t", "r", "p")).collect()]
    assert got == [py_render(*c) for c in cases]


def py_clean(t: str) -> str:
    t = re.sub(r"\r\n?", "\n", t)
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t)
    t = re.sub(r"[ \t]+", " ", t)
    t = re.sub(r" +(\n|\Z)", r"\1", t)
    return re.sub(r"\n{3,}", "\n\n", t)


_CLEAN = st.sampled_from(["a", "é", " ", "\t", "\n", "\r", "\r\n", "\x00", "\x07", "\x0b", "\x1f", "\x7f", "\xa0", "."])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(_CLEAN, max_size=30).map("".join), min_size=1, max_size=30))
def test_clean_text_matches_python(spark, texts):
    assert _one(spark, T.clean_text, texts) == [py_clean(t) for t in texts]


EXPECTED_MASKS = {
    "email": (r"[\w.%+-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+", "[EMAIL]"),
    "secret": (r"""["'][0-9a-fA-F]{16,}["']""", "[SECRET]"),
    "ipv4": (r"\d{1,3}(?:\.\d{1,3}){3}", "[IP]"),
    "card": (r"\d{16}", "[CARD]"),
    "phone": (r"\+?\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}", "[PHONE]"),
}


def py_anonymise(t: str):
    counts = {}
    for kind, (pattern, mask) in EXPECTED_MASKS.items():
        t, counts[kind] = re.subn(pattern, mask, t, flags=re.ASCII)
    return t, counts


_PII = st.sampled_from(["a", "b", "f", "0", "1", "5", "9", "@", ".", "'", '"', "+", "(", ")", "-", " ", "x.y", "@m.io",
                        "1234", "255.", "(555) ", "0123456789abcdef"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(_PII, max_size=25).map("".join), min_size=1, max_size=30))
def test_anonymise_matches_python(spark, texts):
    from fieldwork.operators.insights import anonymise_documents
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in anonymise_documents(df).collect()}
    for i, t in enumerate(texts):
        masked, counts = py_anonymise(t)
        assert got[i]["text"] == masked
        assert {k: got[i][f"n_{k}"] for k in counts} == counts
