"""User-facing reports (L1, L2, L5, L6, L10, L11): one DataFrame plan each.

``now`` is the report clock: a ``datetime`` (folded to literals, so time
bounds reach the Parquet scan as pushed filters), a Column, or a one-column
DataFrame (bounds become scalar subqueries).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newslake.functions import dates, text as T, urls as U
from newslake.operators import joins as J, postings as PO, search as S, windows as W
from newslake.operators.predicates import above, in_range

ATOM_SIZE = 4000
SEARCH_FIELDS = ["title", "summary", "text"]


def categories_text(cats: Column) -> Column:
    return F.array_join(F.transform(cats, lambda c: F.concat(c["term"], F.lit("|"), c["label"])), ";")


def ranked_feed(docs: DataFrame, models: DataFrame, now: Column, q: str | None = None,
                model: str | None = None, topic: str | None = None, gte: str = "now-7d",
                lt: str = "now", offset: int = 0, size: int = ATOM_SIZE,
                formula: str = S.DEFAULT_OVERALL_SCORE,
                threshold: float = T.OVERALL_SCORE_THRESHOLD, index: PO.Index | None = None) -> DataFrame:
    """L1: the ranked feed. Docs in ``[gte, lt)``, optionally selected by
    model/topic (D3) and a query string (C9 + BM25, from a stored ``index``
    where there is one), newest first then by
    relevance, paged, then scored (I24) and cut at the threshold (C16); rows
    are shaped as feed entries (I9-I11, I29)."""
    d = docs.filter(in_range("updated", gte, lt, now))
    if model or topic:
        d = d.filter(J.model_filter(models, model, topic))
    d = PO.search_docs(d, docs, q, SEARCH_FIELDS, index)
    ordered = d.orderBy(F.col("updated").desc_nulls_last(), F.col("score").desc(), F.col("id"))
    paged = W.page(ordered, offset, size)
    scored = S.with_overall_score(paged, "score", "topics", formula)
    return scored.filter(above("overall_score", threshold)).select(
        "id",
        T.title_or("title", "summary").alias("title"),
        T.summary_or("summary").alias("summary"),
        T.content_or("summary").alias("content"),
        T.author_or("author").alias("author"),
        U.unquote("link").alias("link"),
        dates.to_iso_z("updated").alias("updated"),
        F.round("overall_score", 6).alias("overall_score"),
        categories_text(T.categories("topics", "tags")).alias("categories"),
        T.rights_text("topics").alias("rights"),
    )


def recent_docs(docs: DataFrame, models: DataFrame, now: Column, q: str | None = None,
                model: str | None = None, topic: str | None = None, filter_cond: Column | None = None,
                exclude_cond: Column | None = None, gte: str = "now-4h", lt: str = "now",
                offset: int = 0, size: int = 1, index: PO.Index | None = None) -> DataFrame:
    """L2: docs with text in ``[gte, lt)``, best topic first (G2), then
    newest, then relevance; optional model/topic/text/filter/exclude (N3)."""
    d = docs.filter(in_range("updated", gte, lt, now) & F.col("text").isNotNull())
    if model or topic:
        d = d.filter(J.model_filter(models, model, topic))
    if filter_cond is not None:
        d = d.filter(_cond(filter_cond))
    if exclude_cond is not None:
        d = d.filter(~F.coalesce(_cond(exclude_cond), F.lit(False)))
    d = PO.search_docs(d, docs, q, SEARCH_FIELDS, index)
    ordered = d.orderBy(W.best_topic_key().desc_nulls_last(), F.col("updated").desc_nulls_last(),
                        F.col("score").desc(), F.col("id"))
    return W.page(ordered, offset, size)


def _cond(c) -> Column:
    """A Column, or SQL condition text."""
    return F.expr(c) if isinstance(c, str) else c


def docs_of_source(docs: DataFrame, now: Column, source_id: str | None, gte: str = "now-7d",
                   lt: str = "now", offset: int = 0, size: int = -1) -> DataFrame:
    """Docs of one source (C8) in a time window, best topic first."""
    d = docs.filter(in_range("updated", gte, lt, now))
    if source_id:
        d = d.filter(F.col("origin") == source_id)
    d = d.withColumn("score", F.lit(1.0))
    ordered = d.orderBy(W.best_topic_key().desc_nulls_last(), F.col("updated").desc_nulls_last(),
                        F.col("score").desc(), F.col("id"))
    return W.page(ordered, offset, size)


def csv_rows(df: DataFrame, formula: str = S.DEFAULT_OVERALL_SCORE) -> DataFrame:
    """B6 columns: collector_id, news_id, updated_date, link, title, summary,
    overall_score, _score, then the label/score pairs (one joined column)."""
    scored = S.with_overall_score(df, "score", "topics", formula)
    pairs = F.array_join(F.flatten(F.transform(
        F.coalesce("topics", F.array().cast("array<struct<label:string,score:double>>")),
        lambda t: F.array(t["label"], t["score"].cast("string")))), "|")
    return scored.select(
        F.col("origin").alias("collector_id"),
        F.col("id").alias("news_id"),
        dates.to_iso_z("updated").alias("updated_date"),
        U.unquote("link").alias("link"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.round("overall_score", 6).alias("overall_score"),
        F.col("score").alias("_score"),
        pairs.alias("topic_pairs"),
    )


def digest(docs: DataFrame, models: DataFrame, now: Column, n: int = 5, gte: str = "now-1d/d") -> DataFrame:
    """The best ``n`` of the day as digest entries."""
    best = recent_docs(docs, models, now, gte=gte, size=n)
    return best.select("id", W.best_topic_key().alias("best_score"),
                       T.digest_entry("title", "summary", "link", "tags", "topics").alias("entry"))


def pick_one(docs: DataFrame, models: DataFrame, now: Column, seed: int, gte: str = "now-1d") -> DataFrame:
    """One of today's best at a seeded offset 1..10."""
    import random
    offset = random.Random(seed).randint(1, 10)
    return recent_docs(docs, models, now, gte=gte, offset=offset, size=1)
