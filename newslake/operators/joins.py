"""Joins of the model.

Only equi joins occur. Registry sides (sources, topics, models) go through
``bounded_broadcast``; doc-to-doc joins are sort-merge on the id (AQE turns
them into broadcasts at runtime when one side turns out small, and splits
skewed partitions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newslake.operators.broadcast import bounded_broadcast
from newslake.operators.sets import merge_tags
from newslake.functions.text import NEWS_MIN_TEXT_SIZE


def with_source_title(stats: DataFrame, sources: DataFrame, key: str = "origin") -> DataFrame:
    """Stats left-joined to source titles; unknown -> ``Orphan News for <key>``."""
    titles = sources.select(F.col("id").alias(key), F.col("title").alias("__title"))
    out = stats.join(bounded_broadcast(titles), key, "left")
    return out.withColumn("title", F.coalesce("__title", F.concat(F.lit("Orphan News for "), F.col(key)))).drop("__title")


def docs_with_source(docs: DataFrame, sources: DataFrame, how: str = "left_semi") -> DataFrame:
    """Parent-child join on ``origin``."""
    s = sources.select(F.col("id").alias("origin"), *( [] if how in ("left_semi", "left_anti")
                                                       else [F.col("title").alias("source_title")]))
    # The registry is small or is not broadcast; then AQE splits a hot source.
    return docs.join(bounded_broadcast(s), "origin", how)


def model_labels(models: DataFrame, model: str | None = None, topic: str | None = None) -> DataFrame:
    """The related topics of the model (title compared ignoring case), or of
    every model; with a topic, only related topics equal to it ignoring case."""
    m = models
    if model is not None:
        m = m.filter(F.lower("title") == F.lit(model.lower()))
    rel = m.select(F.explode("related_topics").alias("label"))
    if topic is not None:
        rel = rel.filter(F.lower("label") == F.lit(topic.lower()))
    return rel.distinct()


def model_filter(models: DataFrame, model: str | None = None, topic: str | None = None,
                 topics_col: str = "topics"):
    """D3 as a Column: a topic argument requires that exact label; a model
    alone requires any of its related topics; an unknown model selects
    nothing.

    The label set comes from the (small) model registry as one scalar
    subquery (``collect_set``), so the docs are filtered in place: no
    explode, no join, no shuffle of the docs."""
    labels = F.transform(topics_col, lambda t: t["label"])
    if topic is not None:
        return F.coalesce(F.array_contains(labels, F.lit(topic)), F.lit(False))
    if model is None:
        return F.lit(True)
    wanted = model_labels(models, model).select(F.collect_set("label")).scalar()
    return F.coalesce(F.arrays_overlap(labels, wanted), F.lit(False))


def docs_for_model(docs: DataFrame, models: DataFrame, model: str | None = None,
                   topic: str | None = None) -> DataFrame:
    """D3: docs selected by the model/topic arguments."""
    return docs.filter(model_filter(models, model, topic))


def topic_docs(topics: DataFrame, docs: DataFrame) -> DataFrame:
    """(topic, tag, doc) for every doc tag that belongs to a topic."""
    tt = topics.select(F.col("title").alias("topic"), F.explode("tags").alias("tag"))
    dt = docs.select("*", F.explode(F.array_distinct("tags")).alias("tag"))
    return dt.join(bounded_broadcast(tt), "tag")


def apply_votes(docs: DataFrame, votes: DataFrame, key: str = "id") -> DataFrame:
    """The latest vote per (doc, voter) (F5) joined to the docs by
    ``key``; a vote on an unknown doc is a failed outcome. Returns one row
    per vote with ``outcome``."""
    from newslake.operators.windows import latest_per_key
    latest = latest_per_key(votes, [key, "voter"], F.struct("ts", "event_id") if "event_id" in votes.columns
                            else F.col("ts"))
    known = docs.select(key).distinct().withColumn("__known", F.lit(True))
    out = latest.join(known, key, "left")
    return out.withColumn("outcome", F.when(F.col("__known"), F.lit("successful"))
                          .otherwise(F.lit("failed: unknown doc"))).drop("__known")


def votes_map(votes: DataFrame, key: str = "id") -> DataFrame:
    """The ``votes`` field of a doc: voter -> {name, score, id}."""
    return votes.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(
        "voter", F.struct(F.coalesce("name", "voter").alias("name"), F.col("score").cast("int").alias("score"),
                          F.col("voter").alias("id"))))).alias("votes"))


def apply_content(docs: DataFrame, content: DataFrame, min_size: int = NEWS_MIN_TEXT_SIZE) -> DataFrame:
    """Overlay extracted content on stored docs (join on id): text,
    title, summary, html, lang and content type replace the stored values
    when present; tags are merged (H1). A text of ``min_size`` characters or
    less is flagged ``failed: text too small`` (the doc is kept)."""
    c = content.select(
        "id",
        *[F.col(x).alias(f"__new_{x}") for x in ("text", "title", "summary", "html", "lang", "content_type", "tags")])
    out = docs.join(c, "id", "left")
    has_new = F.col("__new_text").isNotNull()
    for x in ("text", "title", "summary", "html", "lang", "content_type"):
        if x in docs.columns:
            out = out.withColumn(x, F.coalesce(F.col(f"__new_{x}"), F.col(x)))
        else:
            out = out.withColumn(x, F.col(f"__new_{x}"))
    out = out.withColumn("tags", F.when(F.col("__new_tags").isNotNull(),
                                        merge_tags("tags", "__new_tags")).otherwise(F.col("tags")))
    outcome = (F.when(~has_new, F.lit("unchanged"))
               .when(F.length("__new_text") > min_size, F.lit("successful"))
               .otherwise(F.lit("failed: text too small")))
    return out.withColumn("outcome", outcome).drop(*[f"__new_{x}" for x in
                                                     ("text", "title", "summary", "html", "lang", "content_type", "tags")])


def not_yet_collected(new: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """New items whose id is not stored with a text yet."""
    done = stored.filter(F.col("text").isNotNull()).select(key)
    return new.join(done, key, "left_anti")
