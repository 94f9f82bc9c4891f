"""Aggregations (E1-E11) and the joins they need.

Every aggregation is a hash aggregate with a map-side partial step, so a hot
key (one source holding a third of the corpus) is combined inside each task
before the shuffle and never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newslake.functions._util import as_col
from newslake.operators import windows
from newslake.operators.broadcast import MAX_BROADCAST_ROWS, bounded_broadcast

ES_DEFAULT_BUCKETS = 10


def tag_counts(docs: DataFrame, size: int = ES_DEFAULT_BUCKETS, tags: str = "tags") -> DataFrame:
    """Docs per tag, the ``size`` most frequent (count desc, tag asc)."""
    per_tag = (docs.select(F.explode(F.array_distinct(F.col(tags))).alias("tag"))
               .groupBy("tag").agg(F.count(F.lit(1)).alias("doc_count")))
    return windows.top_k_per(per_tag, [], [F.col("doc_count").desc(), F.col("tag")], size)


def topic_stats(docs: DataFrame, n_sources: int = ES_DEFAULT_BUCKETS,
                n_topics: int = ES_DEFAULT_BUCKETS) -> DataFrame:
    """For the ``n_sources`` sources with most predicted docs: their doc
    count, and per label (top ``n_topics``) the number of topic entries and
    their mean score. Only docs having a topic count."""
    predicted = docs.filter(F.exists("topics", lambda t: t["label"].isNotNull()))
    per_origin = predicted.groupBy("origin").agg(F.count(F.lit(1)).alias("doc_count"))
    top_origins = windows.top_k_per(per_origin, [], [F.col("doc_count").desc(), F.col("origin")], n_sources)
    # top_origins has at most n_sources rows, a number that the caller sets.
    small = n_sources <= MAX_BROADCAST_ROWS
    bounded = F.broadcast if small else (lambda df: df)
    entries = (predicted.join(bounded(top_origins.select("origin")), "origin", "left_semi")
               .select("origin", F.explode("topics").alias("t"))
               .select("origin", F.col("t.label").alias("label"), F.col("t.score").alias("score")))
    per_label = entries.groupBy("origin", "label").agg(
        F.count(F.lit(1)).alias("label_count"), F.avg("score").alias("avg_score"))
    top_labels = windows.top_k_per(per_label, ["origin"], [F.col("label_count").desc(), F.col("label")], n_topics)
    return top_labels.join(bounded(top_origins), "origin")


def default_topic_size(sources: DataFrame) -> DataFrame:
    """The default number of buckets is the number of sources."""
    return sources.select(F.count(F.lit(1)).alias("n_sources"))


def topic_tags(topics: DataFrame) -> DataFrame:
    """(topic, tag) pairs of the topic registry."""
    return topics.select(F.col("title").alias("topic"), F.explode("tags").alias("tag"))


def docs_per_tag(docs: DataFrame, wanted_tags: DataFrame, cond: Column | None = None) -> DataFrame:
    """Docs (with text) per tag, restricted to ``wanted_tags`` before the
    shuffle (broadcast semi join on the small registry tag set)."""
    d = docs.filter(F.col("text").isNotNull() if cond is None else cond)
    exploded = d.select(F.explode(F.array_distinct("tags")).alias("tag"))
    wanted = bounded_broadcast(wanted_tags.select("tag").distinct())
    return (exploded.join(wanted, "tag", "left_semi")
            .groupBy("tag").agg(F.count(F.lit(1)).alias("n_docs")))


def training_stats(topics: DataFrame, docs: DataFrame) -> DataFrame:
    """Per topic, the sum over its tags of the docs with text carrying the
    tag (a doc with two tags of the topic counts twice); topics with no such
    doc keep a zero."""
    tt = topic_tags(topics)
    counts = docs_per_tag(docs, tt)
    per_topic = (tt.join(counts, "tag", "left")
                 .groupBy("topic").agg(F.sum(F.coalesce("n_docs", F.lit(0))).cast("bigint").alias("n_docs")))
    all_topics = topics.select(F.col("title").alias("topic"))
    return all_topics.join(per_topic, "topic", "left").select(
        "topic", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"))


def tag_inventory(topics: DataFrame, docs: DataFrame) -> DataFrame:
    """E5: per (topic, tag) the docs with text and the tag, in ascending
    (count, tag) order as ``tag_order``."""
    tt = topic_tags(topics)
    counts = docs_per_tag(docs, tt)
    inv = tt.join(counts, "tag", "left").select(
        "topic", "tag", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"))
    return inv.withColumn("tag_order", F.row_number().over(Window.partitionBy("topic").orderBy("n_docs", "tag")))


def count_matching(df: DataFrame, cond: Column | None = None) -> DataFrame:
    """Total hits (one row)."""
    d = df if cond is None else df.filter(cond)
    return d.select(F.count(F.lit(1)).alias("total"))


def count_if(cond: Column) -> Column:
    """Filtered count as an aggregate expression."""
    return F.count_if(cond)


def max_id_per_source(df: DataFrame, origin: str = "origin", id_col: str = "status_id") -> DataFrame:
    """Highest (numeric) id per source."""
    return df.groupBy(origin).agg(F.max(F.col(id_col).try_cast("bigint")).alias("max_id"))


def cooccurrence(docs: DataFrame, k_topic: int = ES_DEFAULT_BUCKETS, k_tag: int = ES_DEFAULT_BUCKETS,
                 k_link: int = ES_DEFAULT_BUCKETS) -> DataFrame:
    """Topic -> tag -> link buckets with one representative doc.

    Level 1 counts topic entries (nested), level 2 docs having the topic and
    the tag, level 3 docs per link. Each level keeps its top-k (count desc,
    key asc) before the next explode, so the fan-out is bounded by k, not by
    the data.
    """
    labels = F.transform("topics", lambda t: t["label"])
    per_topic = (docs.select(F.explode(labels).alias("topic"))
                 .groupBy("topic").agg(F.count(F.lit(1)).alias("topic_count")))
    top_topics = windows.top_k_per(per_topic, [], [F.col("topic_count").desc(), F.col("topic")], k_topic)
    # One row per (doc, topic) for the reverse-nested levels; top_topics has
    # at most k_topic rows, so the broadcast is bounded.
    doc_topic = (docs.select("id", "link", "tags", F.explode(F.array_distinct(labels)).alias("topic"))
                 .join(F.broadcast(top_topics.select("topic")), "topic", "left_semi"))
    doc_topic_tag = doc_topic.select("topic", "id", "link", F.explode(F.array_distinct("tags")).alias("tag"))
    per_tag = doc_topic_tag.groupBy("topic", "tag").agg(F.count(F.lit(1)).alias("tag_count"))
    top_tags = windows.top_k_per(per_tag, ["topic"], [F.col("tag_count").desc(), F.col("tag")], k_tag)
    visits = doc_topic_tag.join(F.broadcast(top_tags), ["topic", "tag"])
    per_link = visits.groupBy("topic", "tag", "link").agg(
        F.count(F.lit(1)).alias("link_count"), F.min("id").alias("hit_id"))
    top_links = windows.top_k_per(per_link, ["topic", "tag"], [F.col("link_count").desc(), F.col("link")], k_link)
    # top_tags and top_topics hold at most k_topic * k_tag rows: bounded broadcasts.
    return top_links.join(F.broadcast(top_tags), ["topic", "tag"]).join(F.broadcast(top_topics), "topic")


def outcome_counts(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Rows per outcome."""
    return df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def model_topics(models: DataFrame, topics: DataFrame) -> DataFrame:
    """Model.related_topics joined to topic.title (both registries)."""
    rel = models.select(F.col("title").alias("model"), "limit", "lang",
                        F.posexplode("related_topics").alias("class_index", "topic"))
    return rel.join(bounded_broadcast(topics.select(F.col("title").alias("topic"), "tags")), "topic")


def mean_score(col) -> Column:
    return F.avg(as_col(col))
