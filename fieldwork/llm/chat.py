"""Chat formatting by schema fingerprint, with DataFrame functions only.

A table's fingerprint is a hash of its nested field paths (names and nesting, without types).  It selects a declarative mapping from
``LAYOUTS``; tables that have other columns match every layout whose paths they contain, and each row takes the first of these
(those with more paths first) whose columns it all fills, or else the first of which it fills any.  Every layout becomes canonical turns ``(conv_id, turn, role, text)``, one row per turn.

Format of a conversation: per turn ``<|im_start|>{role}\\n{text}<|im_end|>\\n``.  Inside texts a backslash is
doubled and then ``<|`` becomes ``<\\|``, so no control string can occur in a text; both
steps are undone in reverse.  In roles ``%``, line feeds and ``<`` are written as ``%25``, ``%0A`` and ``%3C``.
The loss mask is a list of ``(start, length)`` in code points of the formatted string, one per assistant turn, over its escaped text.

Defined results: null text is empty; null role is empty; a null turn number comes first.  Ties of the turn
number are ordered by role, then text; repeated rows are turns of their own.  Rows without a conversation id
form the conversation null.  Empty arrays or tables: no turns, no rows.  Clashing extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
MASKED_ROLE = "assistant"


def field_paths(schema: T.StructType) -> list[str]:
    """All nested paths, sorted; ``[]`` marks array elements."""
    out: list[str] = []

    def walk(kind: T.DataType, at: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{at}.{f.name}" if at else f.name)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, at + "[]")
        else:
            out.append(at)

    walk(schema, "")
    return sorted(out)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """``parts``: (role, column) pairs that become turns in order; a tuple of columns is joined by blank lines.
    ``rows``: (turn, role, text) columns of a table with a row per turn.
    ``messages``: (array, role field, text field)."""
    name: str
    paths: tuple[str, ...]
    rows: tuple[str, str, str] | None = None
    messages: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), rows=("turn", "role", "text")),
    Layout("messages", ("conv_id", "messages[].role", "messages[].content"), messages=("messages", "role", "content")),
    Layout("from and value", ("conv_id", "conversations[].from", "conversations[].value"),
           messages=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt and completion", ("conv_id", "prompt", "completion"),
           parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("conv_id", "prompt", "response"),
           parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("conv_id", "instruction", "output"),
           parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", ("conv_id", "instruction", "input", "output"),
           parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system, prompt and completion", ("conv_id", "system", "prompt", "completion"),
           parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
)
_BY_PRINT = {fingerprint(list(x.paths)): x for x in LAYOUTS}


def layouts_of(schema: T.StructType) -> list[Layout]:
    """All layouts that a table may hold, those with more paths first."""
    paths = field_paths(schema)
    if (exact := _BY_PRINT.get(fingerprint(paths))) is not None:
        return [exact]
    inside = [x for x in LAYOUTS if set(x.paths) <= set(paths)]
    if not inside:
        raise ValueError(f"no layout for the fields {paths}")
    return sorted(inside, key=lambda x: -len(x.paths))


def _filled(layout: Layout) -> list[Column]:
    """For each column of a layout: whether a row has something in it."""
    if layout.messages:
        return [F.coalesce(F.size(layout.messages[0]) > 0, F.lit(False))]
    cols = layout.rows[1:] if layout.rows else [c for _, cs in layout.parts for c in cs]
    return [F.coalesce(F.col(c).cast("string") != "", F.lit(False)) for c in cols]


def _mixed_turns(df: DataFrame, layouts: list[Layout]) -> DataFrame:
    """Each row in its own layout; no row is in two."""
    full = [functools.reduce(lambda a, b: a & b, _filled(x)) for x in layouts]
    some = [functools.reduce(lambda a, b: a | b, _filled(x)) for x in layouts]
    bare = [(no, F.col((x.rows or x.messages)[0]).isNotNull()) for no, x in enumerate(layouts) if x.rows or x.messages]  # empty arrays, empty turns
    which = F.lit(0)
    for no, held in reversed([*enumerate(full), *enumerate(some), *bare]):
        which = F.when(held, no).otherwise(which)
    rows = df.select(which.alias("_which"), F.struct("*").alias("_row"))
    parts = [_turns(rows.where(F.col("_which") == no).select("_row.*"), x) for no, x in enumerate(layouts)]
    return functools.reduce(DataFrame.unionByName, parts)


def _role(col: Column, layout: Layout) -> Column:
    for a, b in layout.roles:
        col = F.when(col == a, b).otherwise(col)
    return col


def canonical_turns(df: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` of a table in any known layout."""
    layouts = layouts_of(df.schema)
    return _turns(df, layouts[0]) if len(layouts) == 1 else _mixed_turns(df, layouts)


def _turns(df: DataFrame, layout: Layout) -> DataFrame:
    conv = F.col("conv_id").cast("long").alias("conv_id")
    if layout.rows:
        turn, role, text = layout.rows
        return df.select(conv, F.col(turn).cast("long").alias("turn"), _role(F.col(role), layout).alias("role"), F.col(text).alias("text"))
    if layout.messages:
        array, role, text = layout.messages
        rows = df.select(conv, F.posexplode(array).alias("turn", "m")).where(F.col("m").isNotNull())
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col(f"m.{role}"), layout).alias("role"),
                           F.col(f"m.{text}").alias("text"))
    turns = F.array(*[F.struct(F.lit(r).alias("role"), F.concat_ws("\n\n", *[F.nullif(F.col(c), F.lit("")) for c in cols]).alias("text"))
                      for r, cols in layout.parts])
    rows = df.select(conv, F.posexplode(turns).alias("turn", "m"))
    return rows.where("m.role <> 'system' or m.text <> ''").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"), F.col("m.text").alias("text"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _write_role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _read_role(role: Column) -> Column:
    for a, b in (("%3C", "<"), ("%0A", "\n"), ("%25", "%")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def format_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_mask)`` per conversation from canonical turns.

    One shuffle by conversation; places come from a running sum that streams over the sorted turns.  A conversation is one
    row in the end, as its string is."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("body", escape(F.col("text")))
    t = t.withColumn("head", F.concat(F.lit(START), _write_role(F.col("role")), F.lit("\n")))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("head") + F.length("body") + F.lit(len(END) + 1)
    t = t.withColumn("no", F.row_number().over(w)).withColumn(
        "end", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    span = F.when(F.col("role") == MASKED_ROLE, F.struct(
        (F.col("end") - F.length("body") - F.lit(len(END) + 1)).alias("start"), F.length("body").cast("long").alias("length")))
    parts = t.select("conv_id", F.struct("no", F.concat("head", "body", F.lit(END + "\n")).alias("s"), span.alias("span")).alias("x"))
    return (parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
            .select("conv_id", F.array_join(F.transform("xs", lambda x: x["s"]), "").alias("formatted"),
                    F.filter(F.transform("xs", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_mask")))


def parse_formatted(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted string."""
    def turn(part: Column) -> Column:
        cut = F.instr(part, "\n")  # roles hold no line feed
        return F.struct(_read_role(F.substring(part, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substring(part, cut + 1, F.length(part) - cut - F.lit(len(END) + 1))).alias("text"))
    pieces = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
