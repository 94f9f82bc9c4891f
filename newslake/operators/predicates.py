"""Predicates and projections.

Each function returns a Column (to compose) or a filtered DataFrame. Plain
comparisons on stored columns reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newslake.functions import dates, urls
from newslake.functions._util import as_col
from newslake.functions.text import NEWS_MIN_TEXT_SIZE, OVERALL_SCORE_THRESHOLD


def of_type(df: DataFrame, t: str, col: str = "type") -> DataFrame:
    """Objects of one type (only for a mixed registry table)."""
    return df.filter(F.col(col) == t)


def has(field) -> Column:
    """The field exists: not null and, for arrays, not empty."""
    c = as_col(field)
    # The type test is constant, so only array fields are looked into.
    return c.isNotNull() & (~F.startswith(F.typeof(c), F.lit("array")) | (F.to_json(F.array(c)) != "[[]]"))


def has_values(field) -> Column:
    """C2 for array fields: an empty array counts as missing."""
    c = as_col(field)
    return c.isNotNull() & (F.size(c) > 0)


def missing(field) -> Column:
    return ~has(field)


def with_ids(df: DataFrame, ids, col: str = "id") -> DataFrame:
    """Ids given as a list or a comma-separated string."""
    if isinstance(ids, str):
        ids = [i.strip() for i in ids.split(",") if i.strip()]
    return df.filter(F.col(col).isin(list(ids)))


def term(field, value) -> Column:
    """C4: exact match on a keyword field or on any element of an array."""
    c = as_col(field)
    return c == F.lit(value)


def term_in_array(field, value) -> Column:
    return F.coalesce(F.array_contains(as_col(field), F.lit(value)), F.lit(False))


def has_topic(label: str | None = None, topics="topics") -> Column:
    """Nested exists on topics, optionally with an exact label."""
    t = as_col(topics)
    if label is None:
        return F.coalesce(F.exists(t, lambda x: x["label"].isNotNull()), F.lit(False))
    return F.coalesce(F.exists(t, lambda x: x["label"] == F.lit(label)), F.lit(False))


def has_any_topic(labels: list[str], topics="topics") -> Column:
    t = as_col(topics)
    if not labels:
        return F.lit(False)
    return F.coalesce(F.exists(t, lambda x: x["label"].isin(labels)), F.lit(False))


def in_range(ts, gte: str | None, lt: str | None, now) -> Column:
    """``[gte, lt)`` with date math relative to ``now``."""
    return dates.in_range(ts, gte, lt, now)


def bool_query(must=(), should=(), must_not=(), filter=()) -> Column:  # noqa: A002
    """Boolean composition; ``should`` is required (at least one) only
    when there is no ``must``/``filter`` clause."""
    cond = F.lit(True)
    for c in list(must) + list(filter):
        cond = cond & c
    should = list(should)
    if should:
        any_should = should[0]
        for c in should[1:]:
            any_should = any_should | c
        if not list(must) and not list(filter):
            cond = cond & any_should
    for c in must_not:
        cond = cond & ~F.coalesce(c, F.lit(False))
    return cond


def docs_of(df: DataFrame, source_id: str, col: str = "origin") -> DataFrame:
    """Children of a parent source (partition pruning when the table is
    partitioned by origin)."""
    return df.filter(F.col(col) == source_id)


def constant_score(df: DataFrame, cond: Column, score: str = "score") -> DataFrame:
    """Filter with a constant 1.0 score."""
    return df.filter(cond).withColumn(score, F.lit(1.0))


def is_valid_url(c) -> Column:
    """C11."""
    return urls.is_valid_url(c)


def not_excluded_uri(c, patterns=None) -> Column:
    """C12."""
    return urls.not_excluded_uri(c, patterns)


def not_excluded_type(url, content_type=None, patterns=None) -> Column:
    """C13."""
    return urls.not_excluded_type(url, content_type, patterns)


def long_enough(text, n: int = NEWS_MIN_TEXT_SIZE) -> Column:
    """C14: strictly longer than ``n`` characters."""
    return F.coalesce(F.length(as_col(text)) > n, F.lit(False))


def above(score, thr: float = OVERALL_SCORE_THRESHOLD) -> Column:
    """Overall score at least the threshold."""
    return F.coalesce(as_col(score) >= thr, F.lit(False))


def project(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """C17: stored fields / source include-exclude."""
    out = df.select(*include) if include else df
    return out.drop(*exclude) if exclude else out


def sample_cap(df: DataFrame, n: int) -> DataFrame:
    """Early-stop cap (``terminate_after``): a feature of the query."""
    return df.limit(n)


def predict_enabled(source_flag="predict", global_flag: bool = True) -> Column:
    """Predict only if the source and the global switch allow it."""
    return F.coalesce(as_col(source_flag), F.lit(True)) & F.lit(bool(global_flag))


def exclude(df: DataFrame, cond: Column) -> DataFrame:
    """H5: ``must_not``."""
    return df.filter(~F.coalesce(cond, F.lit(False)))
