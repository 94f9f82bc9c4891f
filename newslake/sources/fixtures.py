"""Driver tables -> the news model tables (docs, sources, topics, models,
votes, pages, chat messages, labels, now).

The mapping is fixed (FIXTURES.md §3) and has a DuckDB twin in
``newslake.plans.oracle``. Everything is lazy: a report that needs only
``origin`` and ``topics`` never reads ``text``, because Catalyst prunes the
unused derived columns before the scan.

Scale notes
-----------
* ``docs`` joins ``documents`` with two per-doc tables derived from
  ``events``: both are aggregated on ``doc_id`` first (map-side partial
  aggregation), so the shuffles carry at most one row per (doc, label).
* All three sides are hash-partitioned on ``doc_id``; the sort-merge joins
  reuse that partitioning, no extra exchange between them.
* ``count(documents)`` and ``now`` are scalar subqueries, not collects.
"""

from __future__ import annotations

import os
import string
import uuid
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newslake.functions import urls
from newslake.session import ensure_checkpoint_dir, read_table

# Fixed values of the fixture mapping.
ORPHAN_SOURCE = "src19"
TOPIC_DEFS = [("articles", ["the", "that", "was"]), ("joins", ["and", "for"]),
              ("german", ["der", "die", "und"]), ("empty", ["zzz"])]
MODEL_DEFS = [("alpha", ["articles", "joins"], 50, "en"), ("beta", ["german", "empty"], 30, "de")]
VOTE_SCORES = {"click": 0, "view": 1, "purchase": 2}
TOKEN_SEP = r"[ \t\n\r]+"
TOPIC_SCHEMA = "array<struct<label:string,score:double>>"


@lru_cache(maxsize=1)
def _tagger():
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tags(texts: pd.Series) -> pd.Series:
        from collections import Counter
        space, letters = b" \t\n\r", string.ascii_letters.encode()
        lower = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
        others = bytes(c for c in range(128) if c not in space + letters)
        out = []
        for text in texts:
            counts = Counter((text or "").encode("ascii", "ignore").translate(lower, others).split())
            top = sorted((-n, w) for w, n in counts.items() if len(w) > 2)[:8]
            out.append(sorted(w.decode() for _, w in top))
        return pd.Series(out, dtype=object)
    return tags


def fixture_tags(text) -> F.Column:
    """The 8 most frequent words of the whole text (white-space tokens, letters
    A-Z only, lower case, longer than 2; of equal counts the first by name), sorted."""
    return _tagger()(text)


def fixture_title(text) -> F.Column:
    """The one-sentence summary (J2) of the whole text."""
    from newslake.operators.text import best_sentence, best_sentences
    return best_sentence(best_sentences(text, 1))


def doc_count(documents: DataFrame):
    """``count(documents)`` as a scalar-subquery Column."""
    return documents.select(F.count(F.lit(1))).scalar()


# Materialised doc stores (base dir -> parquet path), see ``materialize_docs``.
_STORES: dict[str, str] = {}


def materialize_docs(spark: SparkSession, base: str, path: str) -> str:
    """Write the doc table once (partitioned by source, as the store is kept
    in production) and serve later ``docs(spark, base)`` calls from it, so
    reports read a stored table instead of re-deriving it from events."""
    materialize_docs_sorted(build_docs(spark, base), path)
    _STORES[base] = path
    return path


def forget_store(base: str) -> None:
    _STORES.pop(base, None)
    for key in [k for k in _INDEXES if k[1] == base]:
        del _INDEXES[key]


# Stored search indexes ((application, base dir) -> path), see ``search_index``.
_INDEXES: dict[tuple[str, str], str] = {}
SEARCH_FIELDS = ["title", "summary", "text"]


def search_index(spark: SparkSession, base: str):
    """The stored postings of the doc store: written under the shared checkpoint
    dir on first use and read by every search after it."""
    from newslake.operators import postings as PO
    from newslake.operators.partitioning import spread
    key = (spark.sparkContext.applicationId, base)
    if key not in _INDEXES:
        path = os.path.join(ensure_checkpoint_dir(spark), "indexes", f"docs-{uuid.uuid4().hex[:12]}")
        # The searched fields need no events: without a stored table they come
        # from the documents alone, no text is shuffled.
        fields = docs(spark, base) if base in _STORES else _contents(spread(read_table(spark, base, "documents")))
        PO.write_index(fields, path, SEARCH_FIELDS)
        _INDEXES[key] = path
    return PO.read_index(spark, _INDEXES[key])


def docs(spark: SparkSession, base: str) -> DataFrame:
    """The ``doc`` table of the model (the materialised store when one was
    registered for ``base``)."""
    if base in _STORES:
        return spark.read.parquet(_STORES[base])
    return build_docs(spark, base)


def _contents(documents: DataFrame, *more: str) -> DataFrame:
    """The fields of a doc that its own row gives, and the columns ``more``."""
    link = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"),
                    F.lit("/"), F.col("doc_id").cast("string"))
    return documents.select(
        "doc_id", "text", "lang",
        F.col("source").alias("origin"),
        link.alias("link"),
        urls.doc_id(link).alias("id"),
        fixture_title(F.col("text")).alias("title"),
        F.when(F.col("doc_id") % 5 != 0,
               F.concat(F.lit("author"), (F.col("doc_id") % 11).cast("string"))).alias("author"),
        fixture_tags(F.col("text")).alias("tags"),
        F.lit(None).cast("string").alias("summary"),
        F.lit("rss").alias("format"),
        F.lit("rss").alias("source_type"),
        *more,
    )


def build_docs(spark: SparkSession, base: str) -> DataFrame:
    """Derive the ``doc`` table from the driver tables. Titles and tags come after
    the joins, so that a report's time window or semi join is applied before them."""
    from newslake.operators.partitioning import spread
    documents = spread(read_table(spark, base, "documents"))
    events = read_table(spark, base, "events")
    n_docs = doc_count(documents)
    updated = events.groupBy(F.expr("event_id div 5").alias("doc_id")).agg(F.max("ts").alias("updated"))
    per_label = (events
                 .select((F.col("event_id") % n_docs).alias("doc_id"),
                         F.col("event_type").alias("label"),
                         F.least(F.col("value"), F.lit(100.0)).alias("score"))
                 .filter(F.col("doc_id") % 7 != 0)
                 .groupBy("doc_id", "label").agg(F.max("score").alias("score")))
    topics = (per_label.groupBy("doc_id")
              .agg(F.array_sort(F.collect_list(F.struct("label", "score"))).alias("topics")))
    return _contents(documents.join(updated, "doc_id", "left").join(topics, "doc_id", "left"), "updated", "topics")


def sources(spark: SparkSession, base: str) -> DataFrame:
    """Registered sources: every documents.source but the orphan one."""
    documents = read_table(spark, base, "documents")
    return (documents.select(F.col("source").alias("id")).distinct()
            .filter(F.col("id") != ORPHAN_SOURCE)
            .select("id",
                    F.concat(F.lit("Source "), F.col("id")).alias("title"),
                    F.concat(F.lit("https://"), F.col("id"), F.lit(".example.com/feed")).alias("link"),
                    F.lit("rss").alias("format"),
                    F.lit(10000).alias("limit"), F.lit(10000).alias("step"),
                    F.lit(2).alias("depth"), F.lit(30).alias("freq"),
                    F.lit(True).alias("predict"), F.lit(True).alias("enable_content"),
                    F.lit(True).alias("active")))


def topics(spark: SparkSession) -> DataFrame:
    """The topic registry (a handful of rows: broadcast-sized by definition)."""
    return spark.createDataFrame(
        [(urls_id_py("topic", t), t, tags) for t, tags in TOPIC_DEFS],
        "id string, title string, tags array<string>")


def models(spark: SparkSession) -> DataFrame:
    """The model registry."""
    return spark.createDataFrame(
        [(urls_id_py("model", t), t, rel, lim, lang) for t, rel, lim, lang in MODEL_DEFS],
        "id string, title string, related_topics array<string>, limit int, lang string")


def urls_id_py(kind: str, title: str) -> str:
    """Registry ids are plain ``kind:title`` strings (readable and stable)."""
    return f"{kind}:{title}"


def votes(spark: SparkSession, base: str) -> DataFrame:
    """Votes from click/view/purchase events: (doc_id, voter, name, score, ts)."""
    documents = read_table(spark, base, "documents")
    events = read_table(spark, base, "events")
    n_docs = doc_count(documents)
    score = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return (events.filter(F.col("event_type").isin(list(VOTE_SCORES)))
            .select("event_id",
                    (F.col("event_id") % n_docs).alias("doc_id"),
                    F.col("user_id").cast("string").alias("voter"),
                    F.col("user_id").cast("string").alias("name"),
                    score.alias("score"),
                    F.col("ts")))


def pages(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "pages").select("page_id", F.col("url").alias("link"), "html")


def chat_messages(spark: SparkSession, base: str) -> DataFrame:
    """User turns of ``conversations`` with a command prefix chosen by turn."""
    conv = read_table(spark, base, "conversations").filter(F.col("role") == "user")
    cid = F.col("conv_id").cast("string")
    prefix = (F.when(F.col("turn") % 3 == 0,
                     F.concat(F.lit("/teach https://x.example.com/"), cid, F.lit(" a,b ")))
              .when(F.col("turn") % 3 == 1, F.concat(F.lit("/follow @u"), cid, F.lit(" ")))
              .otherwise(F.concat(F.lit("/watch q"), cid, F.lit(" "))))
    return conv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.col("conv_id").alias("chat_id"),
        "turn",
        F.concat(prefix, F.col("text")).alias("text"),
        F.col("conv_id").alias("from_id"),
        F.concat(F.lit("u"), cid).alias("first_name"),
        F.lit(None).cast("string").alias("last_name"),
    )


def labels(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "labels")


def now_of(docs_df: DataFrame) -> DataFrame:
    """The fixture clock ``date_trunc('day', max(updated)) + 1 day`` as a
    one-row DataFrame; time bounds built from it become scalar subqueries
    (see ``dates.bound``)."""
    return docs_df.select(
        F.timestamp_add("DAY", F.lit(1), F.date_trunc("day", F.max("updated")).cast("timestamp_ntz")).alias("now"))


_CLOCKS: dict[str, object] = {}


def clock(docs_df: DataFrame):
    """The fixture clock as a Python ``datetime`` (one scalar fetched once):
    report time bounds then fold to literals, reach the Parquet scan as
    pushed filters and skip row groups by their min/max ``updated``. In
    production the clock is the current time, also a literal."""
    return now_of(docs_df).first()[0]


def clock_for(spark: SparkSession, base: str):
    """``clock(docs(spark, base))``, fetched once per base directory."""
    if base not in _CLOCKS:
        _CLOCKS[base] = clock(docs(spark, base))
    return _CLOCKS[base]


def materialize_docs_sorted(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write a doc table partitioned by source, every file sorted by time.

    Rows are hash-partitioned on (origin, salt) where the salt is a hash of
    the id modulo ``partitions // 4``: a hot source (a third of the corpus)
    is spread over several writer tasks, each source still lands in a
    bounded number of files, and no sampling pass is needed (unlike a range
    partitioning). Sorted files give tight min/max ``updated`` per row group,
    so time-range filters skip row groups."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("id"), F.lit(max(1, n // 4)))
    (df.repartition(n, F.col("origin"), salt).sortWithinPartitions("origin", "updated")
     .write.mode("overwrite").partitionBy("origin").parquet(path))