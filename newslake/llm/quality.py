"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it, so the order of the rules changes the
cost and not the result. Cost (seconds a character) and selectivity (share of
rows rejected) of each rule are estimated on a bounded sample; the rules then
run in the order of rejections per cost, each on the rows that all rules before
it let pass.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from newslake.llm import wordhash as W
from newslake.llm.common import row_blocks, text_buffers

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
LINE = np.zeros(256, bool)
LINE[10] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows of the sample on which rules are measured.
SAMPLE = 2000


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Texts:
    """A block of texts with what the base statistics found."""

    data: np.ndarray
    offsets: np.ndarray
    base: dict[str, np.ndarray]
    words: W.Words
    lines: W.Words
    line_words: np.ndarray  # words in each line

    def some(self, rows: np.ndarray) -> "Texts":
        column = pa.StringArray.from_buffers(len(self.offsets) - 1, pa.py_buffer(self.offsets.astype(np.int32).tobytes()), pa.py_buffer(self.data.tobytes()))
        return measure(*text_buffers(column.take(pa.array(rows))))


def measure(data: np.ndarray, offsets: np.ndarray) -> Texts:
    """Words are runs without ASCII white space, as they stand."""
    words, lines = W.Words(data, offsets, lower=False), W.Words(data, offsets, lower=False, space=LINE)
    rows = len(offsets) - 1
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    n = np.diff(words.at)
    base = {"n_words": n, "word_chars": np.bincount(words.row, lead[words.end] - lead[words.start], rows).astype(np.int64), "n_symbols": _per_row(SYMBOL[data], offsets)}
    line_words = np.searchsorted(words.start, lines.end) - np.searchsorted(words.start, lines.start)
    some = np.flatnonzero(line_words > 0)
    h = lines.hashes()[some]
    by = np.lexsort((some, h, lines.row[some]))
    again = np.zeros(len(some), bool)
    again[1:] = (h[by][1:] == h[by][:-1]) & (lines.row[some][by][1:] == lines.row[some][by][:-1])
    base["n_dup_lines"] = np.bincount(lines.row[some][by][again], minlength=rows)
    # Words covered by 3-word windows that occur more than once in the row.
    row, g = W.shingles(words, 3, whole_if_short=False)
    first = np.flatnonzero(np.arange(len(words.start)) < words.at[1:][words.row] - 2) if len(words.start) else np.zeros(0, np.int64)
    by = np.lexsort((g, row))
    same = (g[by][1:] == g[by][:-1]) & (row[by][1:] == row[by][:-1])
    twice = np.zeros(len(g), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    covered = np.zeros(len(words.start) + 2, bool)
    for j in range(3):
        covered[first[twice] + j] = True
    base["n_repeat_words"] = np.bincount(words.row[covered[: len(words.start)]], minlength=rows)
    return Texts(data, offsets, {k: base[k].astype(np.int64) for k in BASE}, words, lines, line_words)


def base_failed(b: dict[str, np.ndarray]) -> np.ndarray:
    return (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])


# Rules: True where a row is rejected. Rows without words or lines are rejected by none.
def odd_word_length(t: Texts) -> np.ndarray:
    """Words of fewer than 2 or more than 20 characters on average."""
    n, c = t.base["n_words"], t.base["word_chars"]
    return (c < 2 * n) | (c > 20 * n)


def many_symbols(t: Texts) -> np.ndarray:
    """More than one of ``#*$%&|<>`` for each 4 words."""
    return 4 * t.base["n_symbols"] > t.base["n_words"]


def repeated_lines(t: Texts) -> np.ndarray:
    """More than 30 % of the lines with words equal an earlier line."""
    return 10 * t.base["n_dup_lines"] > 3 * np.bincount(t.lines.row[t.line_words > 0], minlength=t.words.rows)


def few_letters(t: Texts) -> np.ndarray:
    """Fewer than 60 % of the words hold a letter (ASCII or beyond)."""
    letters = np.concatenate([[0], np.cumsum(_LETTER[t.data] | (t.data >= 128))])
    return 10 * np.bincount(t.words.row[letters[t.words.end] > letters[t.words.start]], minlength=t.words.rows) < 6 * t.base["n_words"]


def shouting(t: Texts) -> np.ndarray:
    """More than half of the ASCII letters are capitals."""
    return 2 * _per_row(_UPPER[t.data], t.offsets) > _per_row(_LETTER[t.data], t.offsets)


def cut_lines(t: Texts) -> np.ndarray:
    """More than 30 % of at least 3 lines end with three dots."""
    n = len(t.data)
    dots = np.zeros(n + 1, bool)
    if n > 2:
        dots[3:] = (t.data[2:] == 46) & (t.data[1:-1] == 46) & (t.data[:-2] == 46)
    lines = np.bincount(t.lines.row, minlength=t.words.rows)
    return (lines >= 3) & (10 * np.bincount(t.lines.row[dots[t.lines.end] & (t.lines.end - t.lines.start >= 3)], minlength=t.words.rows) > 3 * lines)


def one_word(t: Texts) -> np.ndarray:
    """One word is more than 30 % of all words."""
    h = t.words.hashes()
    by = np.lexsort((h, t.words.row))
    row, h = t.words.row[by], h[by]
    begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(row) else np.zeros(0, np.int64)
    most = np.zeros(t.words.rows, np.int64)
    np.maximum.at(most, row[begin], np.diff(np.append(begin, len(row))))
    return 10 * most > 3 * t.base["n_words"]


RULES: tuple[Callable[[Texts], np.ndarray], ...] = (odd_word_length, many_symbols, repeated_lines, few_letters, shouting, cut_lines, one_word)


def plan(sample: pa.Array, rules=RULES) -> list[tuple[str, float, float]]:
    """``(rule, seconds a character, share rejected)`` in the order in which the
    rules run: by rejections per cost. Ties and an empty sample keep the given order."""
    data, offsets = text_buffers(sample)
    t = measure(data, offsets)
    live = ~base_failed(t.base)
    measured = []
    for rule in rules:
        began = time.process_time()
        for _ in range(3):
            rejected = rule(t)
        cost = max(time.process_time() - began, 1e-6) / 3 / max(len(data), 1)
        measured.append((rule.__name__, cost, float(rejected[live].mean()) if live.any() else 0.0))
    return sorted(measured, key=lambda m: -m[2] / m[1])


def assess(docs: DataFrame, text_col: str = "text", rules=RULES, order: list[str] | None = None) -> DataFrame:
    """``docs`` with the base statistics, ``base_failed`` and ``kept``.

    Null texts count as empty; they have no words, so the base fails and they
    aren't kept. Equal texts get equal results; an empty table gives an empty
    one. ``order`` names the rules in the order to run; without it they are
    measured on a sample of 2000 rows by hash of the text (the only bounded
    part; it sets the order and not the result). Raises ValueError if a new
    column exists.
    """
    new = [*BASE, "base_failed", "kept"]
    if set(new) & set(docs.columns):
        raise ValueError(f"one of the columns {new} exists")
    if order is None:
        some = docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null").withColumn("h", F.xxhash64("t"))
        # The texts of the smallest hashes: hashes are ranked first, so that only the sample's texts move.
        last = some.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
        some = some.where(F.col("h") <= F.lit(last)).limit(SAMPLE)
        # The sample's texts are measured in one task; only figures come back.
        def measured(batches):
            texts = pa.concat_arrays([pa.array([], pa.string()), *(b.column("t").cast(pa.string()) for b in batches)])
            found = plan(texts, rules)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array(list(range(len(found))))], ["rule", "place"])
        order = [r["rule"] for r in some.select("t").repartition(1).mapInArrow(measured, "rule string, place long").orderBy("place").collect()] or [r.__name__ for r in rules]
    by_name = {r.__name__: r for r in rules}
    cascade = [by_name[n] for n in order]

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(text_col).cast(pa.string()))
            found: list[dict[str, np.ndarray]] = []
            for lo, hi in row_blocks(offsets):
                t = measure(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                failed = base_failed(t.base)
                live, of = ~failed, np.arange(hi - lo)
                part = t
                for rule in cascade:
                    alive = live[of]
                    if not alive.any():
                        break
                    if alive.mean() < 0.5:  # rows that are out cost nothing more
                        of = of[alive]
                        part = part.some(np.flatnonzero(alive))
                    live[of[rule(part)]] = False
                found.append(t.base | {"base_failed": failed, "kept": live})
            cols = [pa.array(np.concatenate([f[c] for f in found]) if found else [], pa.bool_() if c in ("base_failed", "kept") else pa.int64()) for c in new]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *new])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(c, BooleanType() if c in ("base_failed", "kept") else LongType()) for c in new)]))
