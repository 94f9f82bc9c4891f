"""Registered queries: ids and URLs, tags, statistics, training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslake.functions import text as T
from newslake.functions import urls as U
from newslake.operators import aggregates as A
from newslake.operators import joins as J
from newslake.operators import sets as S
from newslake.operators import windows as W
from newslake.plans.catalog import register
from newslake.plans.oracle import sql_doc_id, sql_id_basis, sql_quote, sql_quote_plus, with_fixtures
from newslake.sources import fixtures as FX


def r6(c):
    return F.round(c, 6)


def joined(c, sep=","):
    """Arrays leave a query as one string (sorted by the caller when order is
    not part of the result)."""
    return F.array_join(c, sep)


# ---------------------------------------------------------------------------
# I1, I2, I7, C11-C13 on page URLs
# ---------------------------------------------------------------------------
@register("doc_ids", with_fixtures(f"""
SELECT page_id, url AS link,
       {sql_id_basis('url')} AS id_basis,
       {sql_doc_id('url')} AS id,
       {sql_quote('url')} AS quoted,
       {sql_quote_plus('url')} AS quoted_plus,
       regexp_extract(url, 'https?://([^/]+)', 1) AS domain,
       regexp_matches(url, '(?i)^(?:http|ftp)s?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{{0,61}}[A-Z0-9])?\\.)+(?:[A-Z]{{2,6}}\\.?|[A-Z0-9-]{{2,}}\\.?)|localhost|\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})(?::\\d+)?(?:/?|[/?]\\S+)$') AS valid_url,
       NOT regexp_matches(url, '(sourceforge\\.net)') AS uri_allowed,
       NOT regexp_matches(url, '((\\.iso)|(\\.mp3)|(\\.mp4)|(\\.bin)|(\\.rom)|(\\.zip)|(\\.tar)|(\\.tgz)|(\\.xz)|(\\.img))([?#].*)?$') AS type_allowed
FROM pages
"""))
def q_doc_ids(spark, base):
    """Ids, quoting, host and URL gates of every page URL."""
    p = FX.pages(spark, base)
    return p.select(
        "page_id", "link",
        U.id_basis("link").alias("id_basis"),
        U.doc_id("link").alias("id"),
        U.quote("link").alias("quoted"),
        U.quote_plus("link").alias("quoted_plus"),
        F.regexp_extract("link", r"https?://([^/]+)", 1).alias("domain"),
        U.is_valid_url("link").alias("valid_url"),
        U.not_excluded_uri("link").alias("uri_allowed"),
        U.not_excluded_type("link").alias("type_allowed"),
    )


@register("url_parts", with_fixtures("""
SELECT page_id, url AS link,
       regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)', 2) AS netloc,
       regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)', 3) AS path,
       NULLIF(regexp_extract(url, '/([0-9]+)/?', 1), '') AS status_id,
       url_decode(replace(replace(url_encode(url), '%2F', '/'), '~', '%7E')) AS round_trip
FROM pages
"""))
def q_url_parts(spark, base):
    """I1 parts, I6 status id, I2 quote/unquote round trip."""
    p = FX.pages(spark, base)
    return p.select("page_id", "link",
                    U.url_netloc("link").alias("netloc"),
                    F.regexp_extract("link", r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)", 3).alias("path"),
                    U.status_id("link").alias("status_id"),
                    U.unquote(U.quote("link")).alias("round_trip"))


@register("dedup_by_id", with_fixtures(f"""
SELECT id, count(*) AS n_versions, max(page_id) AS kept_page_id
FROM (SELECT page_id, {sql_doc_id('url')} AS id FROM pages) GROUP BY id
"""))
def q_dedup_by_id(spark, base):
    """H3: pages reached through URLs that differ only in query/fragment
    share an id; the latest (highest page_id) version is kept."""
    p = FX.pages(spark, base).select("page_id", U.doc_id("link").alias("id"))
    kept = S.dedup_by_id(p, "id", "page_id")
    counts = p.groupBy("id").agg(F.count(F.lit(1)).alias("n_versions"))
    return kept.select("id", F.col("page_id").alias("kept_page_id")).join(counts, "id")


# ---------------------------------------------------------------------------
# tags: I3, H1, E1
# ---------------------------------------------------------------------------
_RAW = "regexp_split_to_array(text, '[ \\t\\n\\r]+')"
_NORM = ("lambda t: regexp_replace(replace(replace(lower(trim(t)), 'news', ''), ' ', '_'), "
         "'[^\\x00-\\x7F]', '', 'g')")


@register("normalize_tags", with_fixtures(f"""
SELECT doc_id, array_to_string(list_transform({_RAW}, {_NORM}), ',') AS tags
FROM documents
"""))
def q_normalize_tags(spark, base):
    """All tokens of every text as normalised tags."""
    d = FX.read_table(spark, base, "documents")
    raw = F.split("text", FX.TOKEN_SEP)
    return d.select("doc_id", joined(T.normalize_tags(raw)).alias("tags"))


@register("merge_tags", with_fixtures(f"""
SELECT doc_id,
       array_to_string(list_concat(tags, list_sort(list_distinct(list_filter(
           list_transform(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda t: lower(regexp_replace(t, '[^A-Za-z]', '', 'g'))),
           lambda x: length(x) > 2 AND NOT list_contains(tags, x))))), ',') AS merged
FROM docs
""", "docs"))
def q_merge_tags(spark, base):
    """H1: stored tags + (new - stored), new part distinct and sorted. The
    new tags are all words of the text."""
    d = FX.docs(spark, base)
    nxt = F.split("text", FX.TOKEN_SEP)
    new = F.filter(F.transform(nxt, lambda t: F.lower(F.regexp_replace(t, "[^A-Za-z]", ""))),
                   lambda t: F.length(t) > 2)
    return d.select("doc_id", joined(S.merge_tags("tags", new)).alias("merged"))


@register("tag_counts", with_fixtures("""
SELECT tag, count(*) AS doc_count
FROM (SELECT unnest(list_distinct(tags)) AS tag FROM docs)
GROUP BY tag ORDER BY doc_count DESC, tag LIMIT 10
""", "docs"))
def q_tag_counts(spark, base):
    """The 10 most frequent tags."""
    return A.tag_counts(FX.docs(spark, base), 10)


@register("tag_counts_all", with_fixtures("""
SELECT tag, count(*) AS doc_count
FROM (SELECT unnest(list_distinct(tags)) AS tag FROM docs)
GROUP BY tag ORDER BY doc_count DESC, tag LIMIT 10000
""", "docs"))
def q_tag_counts_all(spark, base):
    """E1 with the topic page's size (10000)."""
    return A.tag_counts(FX.docs(spark, base), 10000)


# ---------------------------------------------------------------------------
# Per-source topic statistics
# ---------------------------------------------------------------------------
_TOPIC_STATS_SQL = """
predicted AS (SELECT * FROM docs WHERE len(list_filter(topics, lambda t: t.label IS NOT NULL)) > 0),
per_origin AS (SELECT origin, count(*) AS doc_count FROM predicted GROUP BY origin),
top_origins AS (SELECT * FROM per_origin ORDER BY doc_count DESC, origin LIMIT 10),
entries AS (SELECT origin, struct_extract(t, 'label') AS label, struct_extract(t, 'score') AS score
            FROM (SELECT origin, unnest(topics) AS t FROM predicted
                  WHERE origin IN (SELECT origin FROM top_origins))),
per_label AS (SELECT origin, label, count(*) AS label_count, avg(score) AS avg_score
              FROM entries GROUP BY origin, label
              QUALIFY row_number() OVER (PARTITION BY origin ORDER BY count(*) DESC, label) <= 10)
"""


@register("topic_stats", with_fixtures(_TOPIC_STATS_SQL + """
SELECT p.origin, o.doc_count, p.label, p.label_count, round(p.avg_score, 6) AS avg_score
FROM per_label p JOIN top_origins o USING (origin)
""", "docs"))
def q_topic_stats(spark, base):
    """E2 + F1: per-source topic statistics (top 10 sources, top 10 labels)."""
    s = A.topic_stats(FX.docs(spark, base), 10, 10)
    return s.select("origin", "doc_count", "label", "label_count", r6("avg_score").alias("avg_score"))


@register("source_overview", with_fixtures(_TOPIC_STATS_SQL + """
SELECT p.origin, coalesce(s.title, 'Orphan News for ' || p.origin) AS title, o.doc_count,
       p.label, p.label_count, round(p.avg_score, 6) AS avg_score
FROM per_label p JOIN top_origins o USING (origin) LEFT JOIN sources s ON s.id = p.origin
""", "docs", "sources"))
def q_source_overview(spark, base):
    """L4: E2 with the source titles (D1); unknown sources are orphans."""
    s = A.topic_stats(FX.docs(spark, base), 10, 10)
    s = J.with_source_title(s, FX.sources(spark, base))
    return s.select("origin", "title", "doc_count", "label", "label_count", r6("avg_score").alias("avg_score"))


@register("topic_stats_all_sources", with_fixtures("""
per_origin AS (SELECT origin, count(*) AS doc_count FROM docs
               WHERE len(list_filter(topics, lambda t: t.label IS NOT NULL)) > 0 GROUP BY origin),
n_src AS (SELECT count(*) AS n FROM sources)
SELECT origin, doc_count FROM per_origin
QUALIFY row_number() OVER (ORDER BY doc_count DESC, origin) <= (SELECT n FROM n_src)
""", "docs", "sources"))
def q_topic_stats_all_sources(spark, base):
    """The number of source buckets defaults to the number of sources."""
    docs = FX.docs(spark, base)
    n = A.default_topic_size(FX.sources(spark, base)).first()["n_sources"]
    predicted = docs.filter(F.exists("topics", lambda t: t["label"].isNotNull()))
    per_origin = predicted.groupBy("origin").agg(F.count(F.lit(1)).alias("doc_count"))
    return per_origin.orderBy(F.col("doc_count").desc(), "origin").limit(n)


@register("count_matching", with_fixtures("""
SELECT count(*) AS total,
       count(*) FILTER (WHERE topics IS NOT NULL) AS with_topics,
       count(*) FILTER (WHERE author IS NULL) AS without_author
FROM docs
""", "docs"))
def q_count_matching(spark, base):
    """Totals and filtered counts."""
    d = FX.docs(spark, base)
    return d.agg(F.count(F.lit(1)).alias("total"),
                 A.count_if(F.col("topics").isNotNull()).alias("with_topics"),
                 A.count_if(F.col("author").isNull()).alias("without_author"))


@register("mean_topic_score", with_fixtures("""
SELECT doc_id, round(list_sum(list_transform(topics, lambda t: t.score)) / len(topics), 6) AS mean_score,
       round(list_max(list_transform(topics, lambda t: t.score)), 6) AS best_score
FROM docs WHERE topics IS NOT NULL
""", "docs"))
def q_mean_topic_score(spark, base):
    """E7 (and the G2 sort key)."""
    d = FX.docs(spark, base).filter(F.col("topics").isNotNull())
    return d.select("doc_id", r6(T.mean_topic_score("topics")).alias("mean_score"),
                    r6(W.best_topic_key("topics")).alias("best_score"))
