"""Chat formatting with Spark expressions.

The turns of a conversation are collected as structs, sorted, and adjacent
turns of one role merged with array functions. The template is::

    <s>[INST]role[/INST]text</s>[INST]role[/INST]text[NEXT]text</s>

with ``[NEXT]`` between the texts of merged turns. A control string inside a
text or role gets a ``~`` after its first character (``[~INST]``; one that has
some gets one more), which ``unescape`` takes out again, so the turns can be
read back from the formatted string. The loss mask is a list of segments whose
texts, put together, are the formatted string; the texts of assistant turns are
marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, OPEN, SHUT, NEXT, END = "<s>", "[INST]", "[/INST]", "[NEXT]", "</s>"
_CONTROL = r"([\[<])(~*/?(?:INST|NEXT|s)[\]>])"
_ESCAPED = r"([\[<])~(~*/?(?:INST|NEXT|s)[\]>])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "$1~$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def format_chats(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, formatted, segments)`` of each conversation of
    ``turns(conv_id, turn, role, text)``.

    ``segments`` is an array of structs (text, loss). Rows are ordered by turn,
    then role and text, so repeated rows and equal turns have a place; null
    turns come first, null roles and texts count as empty, rows with a null
    conv_id are one conversation. Empty and very long texts are kept whole.
    An empty table gives an empty one; other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    chats = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    role = lambda i: F.get("t", i)["role"]
    # Places where a run of one role begins, and the runs.
    begins = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    chats = chats.withColumn("b", begins)
    runs = F.transform("b", lambda s, k: F.struct(role(s).alias("role"), F.transform(F.sequence(s, F.coalesce(F.get("b", k + 1), F.size("t")) - 1), lambda i: escape(F.get("t", i)["text"])).alias("texts")))
    chats = chats.select("conv_id", runs.alias("runs"))
    mark = lambda s, loss=F.lit(False): F.struct(s.alias("text"), loss.alias("loss"))
    learned = lambda r: r["role"].isin(*learn)
    of_run = lambda r: F.concat(
        F.array(mark(F.concat(F.lit(OPEN), escape(r["role"]), F.lit(SHUT)))),
        F.flatten(F.transform(r["texts"], lambda x, i: F.when(i == 0, F.array(mark(x, learned(r)))).otherwise(F.array(mark(F.lit(NEXT)), mark(x, learned(r)))))),
        F.array(mark(F.lit(END))))
    chats = chats.select("conv_id", F.concat(F.array(mark(F.lit(BEGIN))), F.flatten(F.transform("runs", of_run))).alias("segments"))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: an array of structs (role, text), one
    for each text of each merged turn."""
    part = lambda s: s.replace("[", r"\[").replace("]", r"\]")
    runs = F.filter(F.split(F.substring(formatted, len(BEGIN) + 1, 2147483647), END), lambda r: r != "")
    return F.flatten(F.transform(runs, lambda r: F.transform(
        F.split(F.get(F.split(r, rf"{part(OPEN)}|{part(SHUT)}"), 2), part(NEXT)),
        lambda x: F.struct(unescape(F.get(F.split(r, rf"{part(OPEN)}|{part(SHUT)}"), 1)).alias("role"), unescape(x).alias("text")))))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
