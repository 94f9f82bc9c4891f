"""Weighted co-occurrence graph of topics, tags, links, sources and authors
(K1-K4).

The bucket tree (E10) is bounded by its top-k levels (at most
k_topic * k_tag * k_link visits), so everything after it is small; the docs
are read once for the tree and once, through a broadcast semi join on the
representative ids, for the link metadata.

"First occurrence wins" is expressed as ``min_by(attributes, visit order)``
per node/edge id -- one aggregation, no window and no driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newslake.functions import urls as U
from newslake.functions.dates import in_range
from newslake.operators import aggregates as A
from newslake.operators import windows
from newslake.operators.postings import search_docs

# Node kinds and edge weights.
TOPIC_NODE = ("star", 3)
TAG_NODE = ("cross", 1)
LINK_NODE_SIZE = 2
SOURCE_NODE = ("diamond", 1)
AUTHOR_NODE = ("square", 1)
EDGE_INCREMENT = {"source_author": 1, "source_link": 1, "author_link": 1, "topic_link": 10, "tag_link": 1}
EDGE_FIRST = {"source_author": 1, "source_link": 1, "author_link": 1, "topic_link": 10, "tag_link": 5}


def graph_scope(docs: DataFrame, now: Column, gte: str = "now-1M/d", lt: str = "now/d",
                q: str | None = None, index=None) -> DataFrame:
    """K1: docs with text in ``[gte, lt)`` (and matching the query string
    ``q``, by the stored ``index`` where there is one)."""
    d = docs.filter(F.col("text").isNotNull() & in_range("updated", gte, lt, now))
    if q:
        d = search_docs(d, docs, q, ["title", "summary", "text"], index)
    return d


def bucket_tree(scope: DataFrame, k_topic: int = 10, k_tag: int = 10, k_link: int = 10) -> DataFrame:
    """K2: E10 with ranks and the representative doc's fields."""
    tree = A.cooccurrence(scope, k_topic, k_tag, k_link)
    tree = (tree.withColumn("topic_rank", F.dense_rank().over(
                windows.Window.orderBy(F.col("topic_count").desc(), "topic")))
            .withColumn("tag_rank", F.dense_rank().over(
                windows.Window.partitionBy("topic").orderBy(F.col("tag_count").desc(), "tag")))
            .withColumn("link_rank", F.row_number().over(
                windows.Window.partitionBy("topic", "tag").orderBy(F.col("link_count").desc(), "link"))))
    # At most k_topic * k_tag * k_link representative ids: a bounded broadcast.
    source = F.col("source") if "source" in scope.columns else F.lit(None).cast("string")
    hits = scope.select(F.col("id").alias("hit_id"), "title", "author", "source_type", "summary",
                        source.alias("source"))
    # The tree has at most k_topic * k_tag * k_link rows: broadcasting it is
    # bounded, and the docs are scanned once for the representatives.
    return hits.join(F.broadcast(tree), "hit_id")


def _visits(tree: DataFrame) -> DataFrame:
    src = U.domain("link", "source")
    link_id = F.coalesce(F.col("title"), F.col("hit_id"))
    return tree.select("topic", "tag", "link", "topic_rank", "tag_rank", "link_rank", "author",
                       "source_type", "summary", src.alias("src"), link_id.alias("link_id"),
                       link_id.alias("link_label"))


def _order(r4: int) -> Column:
    return F.struct(F.col("topic_rank").cast("int").alias("r1"), F.col("tag_rank").cast("int").alias("r2"),
                    F.col("link_rank").cast("int").alias("r3"), F.lit(r4).alias("r4"))


def _topic_order() -> Column:
    return F.struct(F.col("topic_rank").cast("int").alias("r1"), F.lit(0).alias("r2"),
                    F.lit(0).alias("r3"), F.lit(0).alias("r4"))


def _tag_order() -> Column:
    return F.struct(F.col("topic_rank").cast("int").alias("r1"), F.col("tag_rank").cast("int").alias("r2"),
                    F.lit(0).alias("r3"), F.lit(0).alias("r4"))


def graph_nodes(tree: DataFrame) -> DataFrame:
    """K3: topic, tag, link, source and author nodes (link nodes carry their
    metadata: category, url, source, summary, author); first occurrence (in
    bucket order) wins. Each visit row emits its nodes as one array that is
    exploded, so the tree is read once."""
    v = _visits(tree)
    none = F.lit(None).cast("string")

    def node(id_, label, type_, size, category, url, order, meta=(none, none, none)):
        return F.struct(id_.alias("id"), label.alias("label"), type_.alias("type"), F.lit(size).alias("size"),
                        category.alias("category"), url.alias("url"), meta[0].alias("source"),
                        meta[1].alias("summary"), meta[2].alias("author"), order.alias("o"))
    topic = node(F.col("topic"), F.col("topic"), F.lit(TOPIC_NODE[0]), TOPIC_NODE[1], F.lit("topic"), none,
                 _topic_order())
    tag = node(F.col("tag"), F.col("tag"), F.lit(TAG_NODE[0]), TAG_NODE[1], F.lit("tag"), none, _tag_order())
    link = node(F.col("link_id"), F.col("link_label"), none, LINK_NODE_SIZE, F.col("source_type"),
                F.col("link"), _order(1), (F.col("src"), F.coalesce(F.col("summary"), F.lit("")), F.col("author")))
    source = node(F.col("src"), F.col("src"), F.lit(SOURCE_NODE[0]), SOURCE_NODE[1], F.lit("source"), none,
                  _order(2))
    author = F.when(F.col("author").isNotNull(),
                    node(F.col("author"), F.col("author"), F.lit(AUTHOR_NODE[0]), AUTHOR_NODE[1],
                         F.lit("author"), none, _order(3)))
    nodes = v.select(F.explode(F.array(topic, tag, link, source, author)).alias("n")).filter(
        F.col("n").isNotNull()).select("n.*")
    # topic and tag nodes are emitted once per visit; count them once.
    visits = F.count_distinct(F.col("o"))
    attrs = F.struct("label", "type", "size", "category", "url", "source", "summary", "author")
    first = nodes.groupBy("id").agg(F.min_by(attrs, "o").alias("a"), visits.alias("visits"))
    return first.select("id", "a.label", "a.type", "a.size", "a.category", "a.url", "a.source", "a.summary",
                        "a.author", "visits")


def graph_edges(tree: DataFrame) -> DataFrame:
    """K4: weighted edges ``src_dst``. Per visit: source-author +1 (or
    source-link when there is no author), author-link +1, topic-link +10,
    tag-link 5 the first time then +1. One explode of the visit's edges,
    one aggregation per edge id."""
    v = _visits(tree)

    def edge(src: Column, dst: Column, kind: str, r4: int) -> Column:
        return F.struct(F.concat(src, F.lit("_"), dst).alias("id"), src.alias("source"), dst.alias("target"),
                        F.lit(kind).alias("kind"), F.lit(EDGE_INCREMENT[kind]).alias("inc"),
                        _order(r4).alias("o"))
    has_author = F.col("author").isNotNull()
    first_edge = F.when(has_author, edge(F.col("src"), F.col("author"), "source_author", 1)).otherwise(
        edge(F.col("src"), F.col("link_id"), "source_link", 1))
    author_edge = F.when(has_author, edge(F.col("author"), F.col("link_id"), "author_link", 2))
    events = v.select(F.explode(F.array(
        first_edge, author_edge, edge(F.col("topic"), F.col("link_id"), "topic_link", 3),
        edge(F.col("tag"), F.col("link_id"), "tag_link", 4))).alias("e")).filter(F.col("e").isNotNull()).select("e.*")
    bonus = F.lit(0)
    for kind in EDGE_FIRST:
        if EDGE_FIRST[kind] != EDGE_INCREMENT[kind]:
            bonus = F.when(F.col("first.kind") == kind, F.lit(EDGE_FIRST[kind] - EDGE_INCREMENT[kind])).otherwise(bonus)
    agg = events.groupBy("id").agg(F.sum("inc").alias("inc"),
                                   F.min_by(F.struct("source", "target", "kind"), "o").alias("first"))
    return agg.select("id", F.col("first.source").alias("source"), F.col("first.target").alias("target"),
                      (F.col("inc") + bonus).cast("bigint").alias("weight"))
