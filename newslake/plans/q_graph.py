"""Registered queries: the co-occurrence graph."""

from __future__ import annotations

from newslake.operators import graph as G
from newslake.plans.catalog import register
from newslake.plans.oracle import with_fixtures
from newslake.sources import fixtures as FX

_SCOPE = """
scope AS (SELECT docs.* FROM docs, now_t WHERE text IS NOT NULL
          AND updated >= date_trunc('day', now_t.now - INTERVAL 1 MONTH) AND updated < date_trunc('day', now_t.now)),"""
_TOK = ("list_filter(regexp_split_to_array(lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), "
        "coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 0)")
_SCOPE_Q = f"""
scope AS (SELECT docs.* FROM docs, now_t WHERE text IS NOT NULL
          AND updated >= date_trunc('day', now_t.now - INTERVAL 1 MONTH) AND updated < date_trunc('day', now_t.now)
          AND (list_contains({_TOK}, 'anea') OR list_contains({_TOK}, 'attion'))),"""
_TREE_BODY = """
t1 AS (SELECT topic, count(*) AS topic_count,
              row_number() OVER (ORDER BY count(*) DESC, topic) AS topic_rank
       FROM (SELECT unnest(list_transform(topics, lambda x: x.label)) AS topic FROM scope) GROUP BY topic
       QUALIFY topic_rank <= 10),
dt AS (SELECT id, link, tags, topic
       FROM (SELECT id, link, tags, unnest(list_distinct(list_transform(topics, lambda x: x.label))) AS topic FROM scope)
       WHERE topic IN (SELECT topic FROM t1)),
dtt AS (SELECT topic, id, link, unnest(list_distinct(tags)) AS tag FROM dt),
t2 AS (SELECT topic, tag, count(*) AS tag_count,
              row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, tag) AS tag_rank
       FROM dtt GROUP BY topic, tag QUALIFY tag_rank <= 10),
t3 AS (SELECT v.topic, v.tag, v.link, count(*) AS link_count, min(v.id) AS hit_id,
              row_number() OVER (PARTITION BY v.topic, v.tag ORDER BY count(*) DESC, v.link) AS link_rank
       FROM dtt v JOIN t2 USING (topic, tag) GROUP BY v.topic, v.tag, v.link QUALIFY link_rank <= 10),
tree AS (SELECT t3.*, t2.tag_rank, t2.tag_count, t1.topic_rank, t1.topic_count, d.title, d.author, d.source_type, d.summary,
                coalesce(NULLIF(regexp_extract(t3.link, 'https?://([^/]+)', 1), ''), NULL) AS src,
                coalesce(d.title, t3.hit_id) AS link_id
         FROM t3 JOIN t2 USING (topic, tag) JOIN t1 USING (topic) JOIN scope d ON d.id = t3.hit_id)
"""
_TREE = _SCOPE + _TREE_BODY


def _tree(spark, base, q=None):
    docs = FX.docs(spark, base)
    scope = G.graph_scope(docs, FX.clock_for(spark, base), q=q, index=FX.search_index(spark, base) if q else None)
    return G.bucket_tree(scope, 10, 10, 10)


@register("cooccurrence", with_fixtures(_TREE + """
SELECT topic, topic_count, tag, tag_count, link, link_count, hit_id FROM tree
""", "docs", "now_t"))
def q_cooccurrence(spark, base):
    """E10 / K1 / K2 (+F1, F2): topic -> tag -> link buckets (top 10 each)
    of the last month's docs with one representative doc per link."""
    return _tree(spark, base).select("topic", "topic_count", "tag", "tag_count", "link", "link_count", "hit_id")


@register("graph_nodes", with_fixtures(_TREE + """,
ev AS (
  SELECT topic AS id, topic AS label, 'star' AS type, 3 AS size, 'topic' AS category, NULL AS url,
         CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS author,
         topic_rank AS r1, 0 AS r2, 0 AS r3, 0 AS r4 FROM (SELECT DISTINCT topic, topic_rank FROM tree)
  UNION ALL SELECT tag, tag, 'cross', 1, 'tag', NULL, NULL, NULL, NULL, topic_rank, tag_rank, 0, 0
         FROM (SELECT DISTINCT topic_rank, tag, tag_rank FROM tree)
  UNION ALL SELECT link_id, link_id, NULL, 2, source_type, link, src, coalesce(summary, ''), author,
         topic_rank, tag_rank, link_rank, 1 FROM tree
  UNION ALL SELECT src, src, 'diamond', 1, 'source', NULL, NULL, NULL, NULL, topic_rank, tag_rank, link_rank, 2 FROM tree
  UNION ALL SELECT author, author, 'square', 1, 'author', NULL, NULL, NULL, NULL, topic_rank, tag_rank, link_rank, 3
         FROM tree WHERE author IS NOT NULL)
SELECT id, label, type, size, category, url, source, summary, author,
       count(*) OVER (PARTITION BY id) AS visits FROM ev
QUALIFY row_number() OVER (PARTITION BY id ORDER BY r1, r2, r3, r4) = 1
""", "docs", "now_t"))
def q_graph_nodes(spark, base):
    """K3: graph nodes (first occurrence wins; equal titles merge)."""
    return G.graph_nodes(_tree(spark, base))


@register("graph_edges", with_fixtures(_TREE + """,
ev AS (
  SELECT src || '_' || author AS id, src AS source, author AS target, 'source_author' AS kind, 1 AS inc,
         topic_rank AS r1, tag_rank AS r2, link_rank AS r3, 1 AS r4 FROM tree WHERE author IS NOT NULL
  UNION ALL SELECT src || '_' || link_id, src, link_id, 'source_link', 1, topic_rank, tag_rank, link_rank, 1
         FROM tree WHERE author IS NULL
  UNION ALL SELECT author || '_' || link_id, author, link_id, 'author_link', 1, topic_rank, tag_rank, link_rank, 2
         FROM tree WHERE author IS NOT NULL
  UNION ALL SELECT topic || '_' || link_id, topic, link_id, 'topic_link', 10, topic_rank, tag_rank, link_rank, 3 FROM tree
  UNION ALL SELECT tag || '_' || link_id, tag, link_id, 'tag_link', 1, topic_rank, tag_rank, link_rank, 4 FROM tree)
SELECT id, source, target,
       CAST(sum(inc) OVER (PARTITION BY id) + CASE WHEN kind = 'tag_link' THEN 4 ELSE 0 END AS BIGINT) AS weight
FROM ev QUALIFY row_number() OVER (PARTITION BY id ORDER BY r1, r2, r3, r4) = 1
""", "docs", "now_t"))
def q_graph_edges(spark, base):
    """K4: weighted edges (topic-link 10 per visit, tag-link 5 then +1)."""
    return G.graph_edges(_tree(spark, base))


_EDGES = """,
ev AS (
  SELECT src || '_' || author AS id, src AS source, author AS target, 'source_author' AS kind, 1 AS inc,
         topic_rank AS r1, tag_rank AS r2, link_rank AS r3, 1 AS r4 FROM tree WHERE author IS NOT NULL
  UNION ALL SELECT src || '_' || link_id, src, link_id, 'source_link', 1, topic_rank, tag_rank, link_rank, 1
         FROM tree WHERE author IS NULL
  UNION ALL SELECT author || '_' || link_id, author, link_id, 'author_link', 1, topic_rank, tag_rank, link_rank, 2
         FROM tree WHERE author IS NOT NULL
  UNION ALL SELECT topic || '_' || link_id, topic, link_id, 'topic_link', 10, topic_rank, tag_rank, link_rank, 3 FROM tree
  UNION ALL SELECT tag || '_' || link_id, tag, link_id, 'tag_link', 1, topic_rank, tag_rank, link_rank, 4 FROM tree)
SELECT id, source, target,
       CAST(sum(inc) OVER (PARTITION BY id) + CASE WHEN kind = 'tag_link' THEN 4 ELSE 0 END AS BIGINT) AS weight
FROM ev QUALIFY row_number() OVER (PARTITION BY id ORDER BY r1, r2, r3, r4) = 1
"""


@register("graph_edges_search", with_fixtures(_SCOPE_Q + _TREE_BODY + _EDGES, "docs", "now_t"))
def q_graph_edges_search(spark, base):
    """K1 (text query) + K2 + K4: the graph of the month's docs that match
    ``anea attion`` (any term)."""
    return G.graph_edges(_tree(spark, base, q="anea attion"))
