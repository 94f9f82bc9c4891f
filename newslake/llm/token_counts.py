"""Token counts from an exact histogram of encoded lengths.

Each document is encoded once and only its length kept; documents are grouped
by length. Suffix sums over the histogram, whose size is bounded by the longest
document and not by their number, answer for every context limit how many
documents and tokens there are, how many tokens stay when documents are cut at
the limit, and all quantiles.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# The pattern that splits a text before merging; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths in one block of the two-step suffix sums.
BLOCK = 1024
#: Characters without white space from which a text goes to the encoder whose merging is not quadratic.
LONG_RUN = 2000
_LONG = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")


def _encoder(ranks: dict[bytes, int], tokenizer: str):
    """The number of tokens of a text by two encoders of one vocabulary: a fast
    one, and one for long runs without a break, where merging must not be
    quadratic."""
    import tiktoken
    from tokenizers import Tokenizer

    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    steady = []

    def count(text: str) -> int:
        if not _LONG.search(text):
            return len(fast.encode_ordinary(text))
        if not steady:
            steady.append(Tokenizer.from_str(tokenizer))
            steady[0].encode_special_tokens = True
        return len(steady[0].encode(text, add_special_tokens=False).ids)
    return count


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoded_lengths(docs: DataFrame, vocabulary: str, tokenizer: str, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text (0 for null and
    empty ones). The rank file and the tokenizer file of the same vocabulary are read
    on the driver and sent to the tasks. Raises ValueError if the new column exists."""
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    with open(tokenizer, encoding="utf-8") as f:
        files = docs.sparkSession.sparkContext.broadcast((load_ranks(vocabulary), f.read()))

    def run(batches):
        count = _encoder(*files.value)
        for b in batches:
            n = np.array([count(t) if t else 0 for t in b.column(text_col).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], [*b.schema.names, into])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, LongType())]))


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """``(n_tokens, n_docs)``; rows without a length are left out."""
    return lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For each length L of a histogram, taken as a context limit:

    ``docs_at_least`` (documents of L tokens or more), ``docs_over``,
    ``tokens_whole`` (tokens of the documents that fit), ``tokens_truncated``
    (all documents cut at L), ``tokens_lost`` and ``quantile`` (share of
    documents of L tokens or fewer). Between two lengths all answers are those
    of the lower one plus ``(limit - L) * docs_over``. Sums run first inside
    blocks of lengths, then over the blocks, so no task gets the whole histogram.
    An empty histogram gives an empty table.
    """
    block = (F.col("n_tokens") / BLOCK).cast("long")
    h = hist.withColumn("block", block).withColumn("t", F.col("n_tokens") * F.col("n_docs"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("d_in", F.sum("n_docs").over(inside)).withColumn("t_in", F.sum("t").over(inside))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("t").alias("t_all"))
    # One row for 1024 lengths: the longest document bounds this table.
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = blocks.select("block", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t_all").over(over), F.lit(0)).alias("t_above"),
                          F.sum("d").over(every).alias("docs"), F.sum("t_all").over(every).alias("tokens"))
    s = h.join(above, "block").withColumn("docs_at_least", F.col("d_in") + F.col("d_above")).withColumn("tokens_at_least", F.col("t_in") + F.col("t_above"))
    over_docs = F.col("docs_at_least") - F.col("n_docs")
    cut = F.col("tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return s.select("n_tokens", "n_docs", "docs_at_least", over_docs.alias("docs_over"), (F.col("tokens") - F.col("tokens_at_least") + F.col("t")).alias("tokens_whole"),
                    cut.alias("tokens_truncated"), (F.col("tokens") - cut).alias("tokens_lost"), F.round((F.col("docs") - over_docs) / F.col("docs"), 9).alias("quantile"))


def quantile(hist: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of the documents don't exceed; None for an empty histogram."""
    r = limits(hist).where(F.col("quantile") >= share - 1e-9).agg(F.min("n_tokens")).first()
    return r[0]


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``."""
    return hist.agg(F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0))).first()[0]
