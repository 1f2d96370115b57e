"""Chat formatting with a grammar round trip and a loss mask; built-in functions only.

A conversation is rendered as turns `<|im_start|>role\\ntext<|im_end|>\\n`.  Parsing is
deterministic: a turn begins at `<|im_start|>`, its role ends at the first line feed, its
text at the first `<|im_end|>`, which a line feed follows; then unescaping takes one
backslash out of every `<\\...\\|`.  Escaping is its inverse: it puts one backslash
between `<` and `|`, so no control string is left.  In roles a line feed is also written
`<n>`, and `<\\...n>` gains a backslash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import no_clash

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(escape(role), r"<(\\*)n>", r"<$1\\n>"), F.lit("\n"), F.lit("<n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(F.replace(role, F.lit("<n>"), F.lit("\n")), r"<\\(\\*)n>", r"<$1n>"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """Array of (ok, role, text) of a rendered conversation; ok is false where the grammar is broken."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        rest = F.substring(part, F.length(role) + 2, F.length(part))
        body = F.substring_index(rest, END, 1)
        ok = F.substring(rest, F.length(body) + 1, F.length(rest)) == F.lit(END + "\n")
        return F.struct(ok.alias("ok"), unescape_role(role).alias("role"), unescape(body).alias("text"))

    split = F.split(formatted, r"<\|im_start\|>", -1)
    turns = F.transform(F.slice(split, F.lit(2), F.greatest(F.size(split) - 1, F.lit(0))), turn)
    lead = F.element_at(split, 1)
    return F.when(lead == "", turns).otherwise(F.array_append(turns, F.struct(F.lit(False).alias("ok"), F.lit("").alias("role"), lead.alias("text"))))


def format_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each turn by itself: k, o, role, text, same, shown_role, shown and out, the rendered turn.

    Every turn is rendered as it is and parsed again; where the turn read back is not the
    one written, its role and text are escaped.  Turns are self-contained, so all this takes
    place row by row, before rows of one conversation meet.
    """
    t = turns.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    again = parse(render(F.col("role"), F.col("text")))
    same = (F.size(again) == 1) & again[0]["ok"] & (again[0]["role"] == F.col("role")) & (again[0]["text"] == F.col("text"))
    t = t.withColumn("same", F.coalesce(same, F.lit(False)))
    t = t.withColumn("shown_role", F.when(F.col("same"), F.col("role")).otherwise(escape_role(F.col("role")))).withColumn("shown", F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"))))
    return t.withColumn("out", render(F.col("shown_role"), F.col("shown")))


def format_chats(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: key, formatted, spans (the loss mask), n_escaped, identical.

    The conversation is the concatenation of its turns as format_turns() renders them; it is
    parsed once more and `identical` says that the turns recovered are the source.  A span
    covers the text of an assistant turn without its marks: start and length in code points of
    the conversation, and the number of the turn and the place in it, by which masked_text()
    reads in one pass.

    A conversation is one row, as large as its text: that is what the operator is for.  Its
    turns come to it rendered and the rest is linear in their size.  A null text or role counts
    as empty; turns go by `order`, nulls first, and ties by role and text; equal rows are turns
    of their own; rows of a null key form one conversation; no rows give no conversations.  Other
    columns are left alone; a key named like a result is a ValueError.
    """
    no_clash([key], ["formatted", "spans", "n_escaped", "identical"])
    t = format_turns(turns, key, order, role, text)
    w = Window.partitionBy("k").orderBy("o", "role", "text")
    t = t.withColumn("i", F.row_number().over(w)).withColumn("at", F.sum(F.length("out")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("out"))
    within = F.lit(len(START) + 1) + F.length("shown_role")
    span = F.struct((F.col("at") + within).cast("long").alias("start"), F.length("shown").cast("long").alias("length"), (F.col("i") - 1).cast("int").alias("turn"), (within - len(START)).cast("int").alias("within"))
    c = t.groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("i", "out", "role", "text", F.when(F.col("role") == "assistant", span).alias("span")))).alias("turns"),
        F.sum((~F.col("same")).cast("long")).alias("n_escaped"),
    )
    c = c.withColumn("formatted", F.array_join("turns.out", "")).withColumn("spans", F.filter("turns.span", lambda x: x.isNotNull()))
    source = F.transform("turns", lambda x: F.struct(F.lit(True).alias("ok"), x["role"].alias("role"), x["text"].alias("text")))
    return c.select(F.col("k").alias(key), "formatted", "spans", "n_escaped", (parse(F.col("formatted")) == source).alias("identical"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between; each span is read in its own turn."""
    turns = F.split(formatted, r"<\|im_start\|>", -1)
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.get(turns, s["turn"] + 1), s["within"] + 1, s["length"].cast("int")))), "")
