"""Set operations (H1-H5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newslake.functions._util import EMPTY_STRINGS, as_col
from newslake.operators import windows


def merge_tags(stored, new) -> Column:
    """H1: stored tags followed by the new tags not stored yet (distinct,
    sorted for determinism)."""
    a = F.coalesce(as_col(stored), F.array().cast(EMPTY_STRINGS))
    b = F.coalesce(as_col(new), F.array().cast(EMPTY_STRINGS))
    return F.concat(a, F.array_sort(F.array_except(b, a)))


def dedup_by_id(df: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """H3: one row per id, the latest by ``seq`` (same link -> same id ->
    replaced)."""
    return windows.latest_per_key(df, key, seq)
