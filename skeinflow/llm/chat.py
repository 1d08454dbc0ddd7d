"""Relational chat formatting with Spark expressions only.

A formatted conversation is a row of blocks, one per run of turns of the same role:

    ### role:<newline>text<part/>text</turn><newline>

Turns are sorted by (turn, role, text), nulls first. Adjacent turns of one role share a block, their
texts separated by `<part/>`. Inside texts and roles the control strings can't occur: `\\` becomes
`\\\\`, `#` becomes `\\#`, and a backslash is put inside `</turn>`, `<part/>` and (in roles) `:<newline>`.
Dropping one backslash before each character restores the text. Null texts and roles are empty.
The loss mask is an array of spans (start, length, in code points of the formatted string), one per
assistant text. A conversation id may be null: its rows form one conversation. Repeated rows are turns of
their own, side by side. An empty table gives no rows; texts may be of any length, and other columns are not
read. All turns of one conversation are formatted in one row, so a conversation must fit in a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>\n"
PART = "<part/>"
HEAD_END = ":\n"
#: Turns that are gone through together.
GROUP = 256


def _replace(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def escape(x: Column) -> Column:
    x = _replace(_replace(F.coalesce(x, F.lit("")), "\\", "\\\\"), "#", "\\#")
    return _replace(_replace(x, "</turn>", "<\\/turn>"), PART, "<\\part/>")


def escape_role(x: Column) -> Column:
    return _replace(escape(x), HEAD_END, ":\\\n")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, formatted string, loss_spans array<struct<start long, length long>>)."""
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        # indices below zero wrap round in get(), so the first turn is told apart by i
        new = (i == 0) | (F.get(F.col("turns"), F.greatest(i - 1, F.lit(0)))["role"] != t["role"])
        lead = F.when(new, F.concat(F.when(i > 0, F.lit(TURN_END)).otherwise(""), F.lit("### "), escape_role(t["role"]), F.lit(HEAD_END))).otherwise(PART)
        return F.struct(lead.alias("lead"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss"))

    pieces = grouped.select("conv_id", F.transform("turns", piece).alias("pieces"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["lead"])
        size = F.char_length(p["body"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct((begin + size).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    # an array that grows one by one is copied each time, so groups of pieces get their spans first, and then the groups their places
    def moved(groups: Column) -> Column:
        before = F.aggregate(groups, F.array(F.lit(0).cast("long")), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g["at"])))
        shifted = lambda at: F.transform(groups, lambda g, k: F.transform(g["spans"], lambda s: F.struct((s["start"] + F.get(at, k)).alias("start"), s["length"].alias("length"))))
        return F.flatten(_once(before, shifted))

    spans = _once(F.col("pieces"), lambda all_of: _once(_groups(all_of, lambda some: F.aggregate(some, start, step)), moved))
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(TURN_END))
    return pieces.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def _once(x: Column, of: Callable[[Column], Column]) -> Column:
    """`of` a value that is made once, however often `of` reads it: what stands in a lambda is else made again for each entry."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def _groups(array: Column, of: Callable[[Column], Column]) -> Column:
    """`of` each run of GROUP entries of an array, which is the entry of a lambda."""
    n = F.ceil(F.size(array) / F.lit(GROUP)).cast("int")
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n), lambda k: _once(F.slice(array, k * GROUP + 1, F.lit(GROUP)), of))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, one per original turn."""
    blocks = F.split(F.substring(formatted, F.lit(1), F.char_length(formatted) - len(TURN_END)), TURN_END)

    def block(b: Column) -> Column:
        head = F.locate(HEAD_END, b)
        role = unescape(F.substring(b, F.lit(len("### ") + 1), head - 1 - len("### ")))
        body = F.substring(b, head + len(HEAD_END), F.char_length(b))
        return F.transform(F.split(body, PART), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, block))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the mask, nothing between its spans.

    Where a character stands in a string is found by counting, so the text of each group of spans is cut out first.
    """

    def within(whole: Column) -> Callable[[Column], Column]:
        def run(some: Column) -> Column:
            first, last = F.get(some, F.lit(0)), F.element_at(some, -1)
            text = F.substring(whole, (first["start"] + 1).cast("int"), (last["start"] + last["length"] - first["start"]).cast("int"))
            return _once(text, lambda t: F.transform(some, lambda s: unescape(F.substring(t, (s["start"] - first["start"] + 1).cast("int"), s["length"].cast("int")))))

        return run

    return F.array_join(F.flatten(_once(formatted, lambda whole: _once(spans, lambda all_of: _groups(all_of, within(whole))))), "")
