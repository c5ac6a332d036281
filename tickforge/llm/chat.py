"""Chat formatting: every assistant turn becomes an example of its own, with all turns before it as context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""Reversible: \ becomes \\ and <| becomes <\|, after which no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    r"""As escape(), and a line feed becomes \n, since a line feed ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Parts between doubled backslashes hold only \\n and \\| as marks."""
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(parts, "\\")


def format_chats(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as training examples, each with one trainable reply.

    Example k of a conversation holds all turns up to its k-th assistant turn; its loss mask is the
    span [loss_start, loss_end) of code points, which covers that reply's text alone. If turns follow
    the last reply, or there is none, a last example holds all turns and an empty span, so that
    nothing is lost. Null text or role: empty. Turns stand by turn (null first), ties by role and
    text; repeated rows stay. A null conv_id is a conversation of its own; an empty table gives none.
    A conversation is gathered in one row, as any example of it must be, so its length is bound by a
    row's 2 GB, and its examples take the square of its replies. Other columns, whatever their names,
    are ignored.

    Returns conv_id, example, formatted, loss_start, loss_end.
    """
    own = rows.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    turns = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    marked = turns.select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("reply"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"])).alias("open"), F.length(escape(t["text"])).alias("n"))).alias("turns"))
    last = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at("turns", i)["reply"] | (i == last))
    each = marked.select("conv_id", "turns", F.posexplode(ends).alias("example", "at"))
    shown = F.transform(F.slice("turns", F.lit(1), F.col("at")), lambda t: F.concat(t["open"], F.lit(END + "\n")))
    here = F.element_at("turns", F.col("at"))
    done = each.select("conv_id", F.col("example").cast("long").alias("example"), F.array_join(shown, "").alias("formatted"), here["reply"].alias("reply"), here["n"].alias("n"))
    stop = F.length("formatted") - len(END) - 1
    return done.select("conv_id", "example", "formatted", F.when(F.col("reply"), stop - F.col("n")).otherwise(stop).cast("long").alias("loss_start"), stop.cast("long").alias("loss_end"))


_TURN = re.escape(START) + r"(?s)(.*?)\n(.*?)" + re.escape(END) + "\n"


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example, unescaped."""
    marks = [F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(i)) for i in (1, 2)]
    return F.transform(F.arrays_zip(marks[0].alias("role"), marks[1].alias("text")), lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    return unescape(F.substring(formatted, start.cast("int") + 1, (end - start).cast("int")))
