import hashlib

import pytest
from pyspark.sql import functions as F

from newslake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments int, t string"


def build(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def read(out):
    return {r["conv_id"]: r for r in out.select("conv_id", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss")).collect()}


ROWS = [
    (1, 2, "assistant", "third"), (1, 0, "user", "first"), (1, 1, "user", "second </s>[INST]"), (1, 3, "assistant", "[NEXT] ~ [~NEXT] <~~s>"), (1, 4, "user", ""),
    (2, None, None, None), (2, 0, "assistant", None), (None, 0, "user", "null id"), (3, 0, "user", "x" * 200_000), (3, 1, "assistant", "日本 😀 \\ $1 [INST][/INST]"),
    (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "tie"), (5, 0, "[INST]", "odd role [/INST"), (5, 1, "assistant", "]<s"), (5, 2, "assistant", ">")]


def test_turns_and_loss_are_read_back(spark):
    got = read(chat.format_chats(build(spark, ROWS).repartition(4)))
    want = {}
    for c, t, r, x in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(x for r, x in turns if r == "assistant")
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]


def test_adjacent_turns_of_a_role_are_merged(spark):
    got = read(chat.format_chats(build(spark, ROWS)))
    assert got[1]["formatted"] == ("<s>[INST]user[/INST]first[NEXT]second <~/s>[~INST]</s>[INST]assistant[/INST]third[NEXT][~NEXT] ~ [~~NEXT] <~~~s></s>[INST]user[/INST]</s>")


def test_long_conversation_and_empty_table(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(3000)]
    got = read(chat.format_chats(build(spark, rows)))
    assert [tuple(t) for t in got[1]["turns"]] == [(r, x) for _, _, r, x in rows]
    assert chat.format_chats(build(spark, rows).limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.format_chats(build(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
