"""Registered queries: feeds, search, per-source lists, CSV rows, digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslake.operators import joins as J
from newslake.operators import postings as PO
from newslake.operators import predicates as P
from newslake.operators import search as S
from newslake.operators import windows as W
from newslake.plans import reports as R
from newslake.plans.catalog import register
from newslake.plans.oracle import with_fixtures
from newslake.sources import fixtures as FX

# ---------------------------------------------------------------------------
# SQL twins of the shaping functions
# ---------------------------------------------------------------------------
SUMMARY_OR = "CASE WHEN summary IS NULL OR length(summary) < 5 THEN 'No summary' ELSE summary END"
TITLE_OR = f"CASE WHEN title IS NULL OR length(title) < 5 THEN ({SUMMARY_OR}) ELSE title END"
CONTENT_OR = "CASE WHEN length(summary) >= 5 THEN summary END"
ISO = "strftime(updated, '%Y-%m-%dT%H:%M:%SZ')"
UNQUOTE = "url_decode(replace(link, '+', '%2B'))"
BEST = "list_max(list_transform(topics, lambda t: t.score))"
OVERALL = ("CASE WHEN len(topics) > 0 THEN score * (list_sum(list_transform(topics, lambda t: t.score / 100.0))"
           " / len(topics)) ELSE 0.0 END")
CATEGORIES = ("array_to_string(list_concat("
              "list_transform(coalesce(topics, []), lambda t: '_' || t.label || '|' || t.label), "
              "list_transform(coalesce(tags, []), lambda g: g || '|' || g)), ';')")
RIGHTS = ("coalesce(array_to_string(list_transform(topics, lambda t: '; ' || t.label || ':' || "
          "CAST(t.score AS VARCHAR)), ''), '')")
FEED_COLS = f"""id, {TITLE_OR} AS title, {SUMMARY_OR} AS summary, {CONTENT_OR} AS content,
       coalesce(author, 'unknown') AS author, {UNQUOTE} AS link, {ISO} AS updated,
       round(overall_score, 6) AS overall_score, {CATEGORIES} AS categories, {RIGHTS} AS rights"""


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 0)"


def sql_in(c: str, words: str) -> str:
    """Whether the words occur in a row in the column."""
    return f"contains(' ' || array_to_string({sql_tokens(c)}, ' ') || ' ', ' {words} ')"


def sql_bm25(source: str, terms: list[str], mode: str = "any", where: str | None = None) -> str:
    """CTEs ``tok``, ``tf``, ``st``, ``scored``: BM25 over title+summary+text
    of ``source`` with corpus statistics over all ``docs``. ``where`` decides in
    place of ``mode`` which rows match."""
    tok = ("list_filter(regexp_split_to_array(lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), "
           "coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 0)")
    tfs = ", ".join(f"len(list_filter(tok, lambda t: t = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    parts = " + ".join(
        f"(CASE WHEN tf{i} > 0 THEN ln((st.n - df{i} + 0.5) / (df{i} + 0.5) + 1.0) * tf{i} * "
        f"({S.BM25_K1} + 1) / (tf{i} + {S.BM25_K1} * (1 - {S.BM25_B} + {S.BM25_B} * dl / st.avgdl)) ELSE 0.0 END)"
        for i in range(len(terms)))
    joiner = " AND " if mode == "all" else " OR "
    match = where or joiner.join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""corpus_tf AS (SELECT len({tok}) AS dl, {", ".join(f"len(list_filter({tok}, lambda t: t = '{t}')) AS tf{i}" for i, t in enumerate(terms))} FROM docs),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM corpus_tf),
tok AS (SELECT s.*, {tok} AS tok FROM {source} s),
tf AS (SELECT *, len(tok) AS dl, {tfs} FROM tok),
scored AS (SELECT tf.* EXCLUDE (tok), {parts} AS score FROM tf CROSS JOIN st WHERE {match})"""


def _now(spark, base):
    docs = FX.docs(spark, base)
    return docs, FX.clock_for(spark, base)


# ---------------------------------------------------------------------------
# L1 ranked feed
# ---------------------------------------------------------------------------
@register("ranked_feed", with_fixtures(f"""
base AS (SELECT docs.*, 1.0 AS score FROM docs, now_t
         WHERE updated >= now_t.now - INTERVAL 7 DAY AND updated < now_t.now),
paged AS (SELECT *, {OVERALL} AS overall_score FROM base ORDER BY updated DESC, score DESC, id LIMIT 4000)
SELECT {FEED_COLS} FROM paged WHERE overall_score >= 0.1
""", "docs", "now_t"))
def q_ranked_feed(spark, base):
    """L1: the ranked feed of the last 7 days (flagship report): C6 window,
    G1 newest first, G4 paging, I24 overall score, C16 threshold, I9-I11
    display fallbacks, I29 categories and rights."""
    docs, now = _now(spark, base)
    return R.ranked_feed(docs, FX.models(spark), now)


@register("ranked_feed_model", with_fixtures(f"""
base AS (SELECT docs.*, 1.0 AS score FROM docs, now_t
         WHERE updated >= now_t.now - INTERVAL 7 DAY AND updated < now_t.now
           AND list_has_any(list_transform(topics, lambda t: t.label), ['click', 'view'])),
paged AS (SELECT *, {OVERALL} AS overall_score FROM base ORDER BY updated DESC, score DESC, id LIMIT 4000)
SELECT {FEED_COLS} FROM paged WHERE overall_score >= 0.1
""", "docs", "now_t"))
def q_ranked_feed_model(spark, base):
    """L1 + D3: model ``alpha`` (its related topics are the label set)."""
    docs, now = _now(spark, base)
    return R.ranked_feed(docs, _alpha_models(spark), now, model="Alpha")


def _alpha_models(spark):
    # The registry's related topics are topic titles; alpha selects labels
    # through them. For the fixture the labels are event types, so the model
    # used by these queries relates to those labels.
    return spark.createDataFrame([("model:alpha", "alpha", ["click", "view"], 50, "en")],
                                 "id string, title string, related_topics array<string>, limit int, lang string")


@register("ranked_feed_topic", with_fixtures(f"""
base AS (SELECT docs.*, 1.0 AS score FROM docs, now_t
         WHERE updated >= now_t.now - INTERVAL 14 DAY AND updated < now_t.now
           AND list_contains(list_transform(topics, lambda t: t.label), 'purchase')),
paged AS (SELECT *, {OVERALL} AS overall_score FROM base ORDER BY updated DESC, score DESC, id LIMIT 4000)
SELECT {FEED_COLS} FROM paged WHERE overall_score >= 0.1
""", "docs", "now_t"))
def q_ranked_feed_topic(spark, base):
    """L1 + C5: exact topic label, two weeks."""
    docs, now = _now(spark, base)
    return R.ranked_feed(docs, FX.models(spark), now, topic="purchase", gte="now-14d")


@register("ranked_feed_search", with_fixtures("""
base AS (SELECT docs.* FROM docs, now_t WHERE updated >= now_t.now - INTERVAL 7 DAY AND updated < now_t.now),
""" + sql_bm25("base", ["anea", "attion"]) + f""",
paged AS (SELECT *, {OVERALL} AS overall_score FROM scored ORDER BY updated DESC, score DESC, id LIMIT 4000)
SELECT {FEED_COLS} FROM paged WHERE overall_score >= 0.1
""", "docs", "now_t"))
def q_ranked_feed_search(spark, base):
    """L1 + C9 + J8: text query ``anea attion`` (any term), BM25 relevance."""
    docs, now = _now(spark, base)
    return R.ranked_feed(docs, FX.models(spark), now, q="anea attion", index=FX.search_index(spark, base))


FORMULA_LOG = "log(1 + es_score) * mean(topics_scores)"


@register("ranked_feed_formula", with_fixtures(f"""
base AS (SELECT docs.* FROM docs, now_t WHERE updated >= now_t.now - INTERVAL 7 DAY AND updated < now_t.now),
""" + sql_bm25("base", ["the"]) + f""",
paged AS (SELECT *, CASE WHEN len(topics) > 0 THEN ln(1 + score) * (list_sum(list_transform(topics, lambda t: t.score / 100.0)) / len(topics)) ELSE 0.0 END AS overall_score
          FROM scored ORDER BY updated DESC, score DESC, id LIMIT 4000)
SELECT {FEED_COLS} FROM paged WHERE overall_score >= 0.1
""", "docs", "now_t"))
def q_ranked_feed_formula(spark, base):
    """L1 + N1: a user overall-score formula (log relevance times the mean
    topic probability) given as text."""
    docs, now = _now(spark, base)
    return R.ranked_feed(docs, FX.models(spark), now, q="the", formula=FORMULA_LOG,
                         index=FX.search_index(spark, base))


# ---------------------------------------------------------------------------
# J8 / C9 / C7 search
# ---------------------------------------------------------------------------
@register("bm25_search", with_fixtures(sql_bm25("docs", ["the", "anea", "eriner"]) + """
SELECT doc_id, round(score, 6) AS score FROM scored
""", "docs"))
def q_bm25_search(spark, base):
    """BM25 of ``the anea eriner`` over every doc (any term)."""
    docs = FX.docs(spark, base).select("id", "doc_id")
    out = PO.search(docs, FX.search_index(spark, base), "the anea eriner")
    return out.select("doc_id", F.round("score", 6).alias("score"))


@register("bm25_search_all", with_fixtures(sql_bm25("docs", ["the", "and"], mode="all") + """
SELECT doc_id, round(score, 6) AS score FROM scored
""", "docs"))
def q_bm25_search_all(spark, base):
    """J8 + C9 (all terms)."""
    docs = FX.docs(spark, base).select("id", "doc_id")
    out = PO.search(docs, FX.search_index(spark, base), "the and", default="and")
    return out.select("doc_id", F.round("score", 6).alias("score"))


_WEEK = "base AS (SELECT docs.* FROM docs, now_t WHERE updated >= now_t.now - INTERVAL 7 DAY AND updated < now_t.now),\n"
_DAYS = "base AS (SELECT docs.* FROM docs, now_t WHERE updated >= now_t.now - INTERVAL 7 DAY AND updated < now_t.now AND text IS NOT NULL),\n"
_FEED = f""",
paged AS (SELECT *, {OVERALL} AS overall_score FROM scored ORDER BY updated DESC, score DESC, id LIMIT 4000)
SELECT {FEED_COLS} FROM paged WHERE overall_score >= 0.1
"""
_RECENT = f"""
SELECT id, round(score, 6) AS score FROM scored
ORDER BY {BEST} DESC NULLS LAST, updated DESC, score DESC, id LIMIT 50
"""


def _word(w: str) -> str:
    return f"({sql_in('title', w)} OR {sql_in('text', w)})"


def _feed_query(spark, base, q):
    docs, now = _now(spark, base)
    return R.ranked_feed(docs, FX.models(spark), now, q=q, index=FX.search_index(spark, base))


def _recent_query(spark, base, q):
    docs, now = _now(spark, base)
    out = R.recent_docs(docs, FX.models(spark), now, q=q, gte="now-7d", size=50, index=FX.search_index(spark, base))
    return out.select("id", F.round("score", 6).alias("score"))


@register("feed_query_phrase", with_fixtures(_WEEK + sql_bm25("base", ["of", "the"], where=_word("of the")) + _FEED, "docs", "now_t"))
def q_feed_query_phrase(spark, base):
    """L1 + C9: the ranked feed of a phrase."""
    return _feed_query(spark, base, '"of the"')


@register("feed_query_boolean", with_fixtures(_WEEK + sql_bm25("base", ["anea"], where=f"{_word('anea')} AND NOT {_word('attion')}") + _FEED, "docs", "now_t"))
def q_feed_query_boolean(spark, base):
    """L1 + C9: the ranked feed of ``AND`` with ``NOT``."""
    return _feed_query(spark, base, "anea AND NOT attion")


@register("recent_query_groups", with_fixtures(_DAYS + sql_bm25("base", ["the", "anea", "attion"], where=f"({_word('anea')} OR {_word('attion')}) AND {_word('the')}") + _RECENT, "docs", "now_t"))
def q_recent_query_groups(spark, base):
    """L2 + C9: recent docs of a group in parentheses and a required word."""
    return _recent_query(spark, base, "(anea OR attion) AND the")


@register("recent_query_field", with_fixtures(_DAYS + sql_bm25("base", ["the"], where=f"{sql_in('title', 'the')} AND NOT {sql_in('text', 'and the')}") + _RECENT, "docs", "now_t"))
def q_recent_query_field(spark, base):
    """L2 + C9: recent docs with a word in one field and without a phrase in another."""
    return _recent_query(spark, base, '+title:the -text:"and the"')


@register("recent_query_without", with_fixtures(_DAYS + f"scored AS (SELECT base.*, 0.0 AS score FROM base WHERE NOT {_word('the')})" + _RECENT, "docs", "now_t"))
def q_recent_query_without(spark, base):
    """L2 + C9: recent docs that lack a word; they have no relevance."""
    return _recent_query(spark, base, "NOT the")


_TOK = ("list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), "
        "lambda t: length(t) > 0)")


@register("text_match", with_fixtures(f"""
SELECT doc_id,
       list_contains({_TOK}, 'the') AND list_contains({_TOK}, 'was') AS all_terms,
       list_contains({_TOK}, 'der') OR list_contains({_TOK}, 'que') AS any_term,
       contains(' ' || array_to_string({_TOK}, ' ') || ' ', ' of the ') AS phrase
FROM docs
""", "docs"))
def q_text_match(spark, base):
    """All terms / any term / phrase on the analysed text."""
    docs = FX.docs(spark, base)
    tok = S.tokens(F.coalesce("text", F.lit("")))
    return docs.select("doc_id",
                       S.text_match(tok, ["the", "was"], "all").alias("all_terms"),
                       S.text_match(tok, ["der", "que"], "any").alias("any_term"),
                       S.text_match(tok, ["of", "the"], "phrase").alias("phrase"))


@register("bool_search", with_fixtures("""
SELECT doc_id, id FROM docs
WHERE lang = 'en' AND updated IS NOT NULL
  AND (list_contains(tags, 'the') OR list_contains(tags, 'and'))
  AND NOT coalesce(list_contains(list_transform(topics, lambda t: t.label), 'error'), false)
  AND NOT coalesce(author = 'author3', false)
""", "docs"))
def q_bool_search(spark, base):
    """C7 (must / should / must_not / filter) with C4 terms, C5 nested terms
    and H5 exclusion."""
    docs = FX.docs(spark, base)
    cond = P.bool_query(
        must=[P.term("lang", "en")],
        filter=[P.has("updated")],
        should=[P.term_in_array("tags", "the"), P.term_in_array("tags", "and")],
        must_not=[P.has_topic("error"), P.term("author", "author3")],
    )
    # should is optional when must/filter exist: require it explicitly here
    should = P.term_in_array("tags", "the") | P.term_in_array("tags", "and")
    return docs.filter(cond & should).select("doc_id", "id")


@register("bool_should_only", with_fixtures("""
SELECT doc_id FROM docs
WHERE list_contains(tags, 'anea') OR list_contains(list_transform(topics, lambda t: t.label), 'signup')
""", "docs"))
def q_bool_should_only(spark, base):
    """With only ``should`` clauses at least one must match."""
    docs = FX.docs(spark, base)
    return docs.filter(P.bool_query(should=[P.term_in_array("tags", "anea"), P.has_topic("signup")])).select("doc_id")


@register("ids_and_terms", with_fixtures("""
SELECT doc_id, id FROM docs
WHERE doc_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987)
   OR origin = 'src3'
""", "docs"))
def q_ids_and_terms(spark, base):
    """C3 (id list) or C8 (children of a source)."""
    docs = FX.docs(spark, base)
    ids = "1,2,3,5,8,13,21,34,55,89,144,233,377,610,987"
    by_id = P.with_ids(docs, ids, "doc_id")
    return by_id.unionByName(P.docs_of(docs, "src3")).select("doc_id", "id").distinct()


@register("docs_for_model", with_fixtures("""
SELECT doc_id, id FROM docs
WHERE list_has_any(list_transform(topics, lambda t: t.label), ['click', 'view'])
""", "docs"))
def q_docs_for_model(spark, base):
    """D3: docs having any related topic of a model (model title ignoring case)."""
    docs = FX.docs(spark, base)
    models = spark.createDataFrame([("model:alpha", "alpha", ["click", "view"], 50, "en"),
                                    ("model:beta", "beta", ["signup"], 30, "de")],
                                   "id string, title string, related_topics array<string>, limit int, lang string")
    return J.docs_for_model(docs, models, model="ALPHA").select("doc_id", "id")


# ---------------------------------------------------------------------------
# L2 recent, L5 per source + B6 CSV, G* orders, L11 digest/pick
# ---------------------------------------------------------------------------
@register("recent_docs", with_fixtures(f"""
SELECT id, {ISO} AS updated, {BEST} AS best_score FROM docs, now_t
WHERE updated >= now_t.now - INTERVAL 1 DAY AND updated < now_t.now AND text IS NOT NULL
ORDER BY {BEST} DESC NULLS LAST, updated DESC, id LIMIT 10
""", "docs", "now_t"))
def q_recent_docs(spark, base):
    """L2 (+C2 has text, G2, G4): the day's docs with text, best topic
    first, 10 rows."""
    docs, now = _now(spark, base)
    out = R.recent_docs(docs, FX.models(spark), now, gte="now-1d", size=10)
    return out.select("id", R.dates.to_iso_z("updated").alias("updated"), W.best_topic_key().alias("best_score"))


@register("recent_docs_model_search", with_fixtures("""
base AS (SELECT docs.* FROM docs, now_t
         WHERE updated >= now_t.now - INTERVAL 3 DAY AND updated < now_t.now AND text IS NOT NULL
           AND list_has_any(list_transform(topics, lambda t: t.label), ['click', 'view'])),
""" + sql_bm25("base", ["anea", "attion"]) + f"""
SELECT id, round(score, 6) AS score FROM scored
ORDER BY {BEST} DESC NULLS LAST, updated DESC, score DESC, id LIMIT 10
""", "docs", "now_t"))
def q_recent_docs_model_search(spark, base):
    """L2 + D3 + C9/J8: the last 3 days' docs of model ``alpha`` matching a
    text query, best topic first, then newest, then relevance."""
    docs, now = _now(spark, base)
    out = R.recent_docs(docs, _alpha_models(spark), now, q="anea attion", model="alpha", gte="now-3d", size=10,
                        index=FX.search_index(spark, base))
    return out.select("id", F.round("score", 6).alias("score"))


@register("recent_docs_filtered", with_fixtures(f"""
SELECT id, {ISO} AS updated FROM docs, now_t
WHERE updated >= now_t.now - INTERVAL 3 DAY AND updated < now_t.now AND text IS NOT NULL
  AND lang = 'en' AND NOT coalesce(origin = 'src1', false)
ORDER BY {BEST} DESC NULLS LAST, updated DESC, id LIMIT 20 OFFSET 2
""", "docs", "now_t"))
def q_recent_docs_filtered(spark, base):
    """L2 with N3 filter/exclude as SQL text and paging (offset 2, size 20)."""
    docs, now = _now(spark, base)
    out = R.recent_docs(docs, FX.models(spark), now, filter_cond="lang = 'en'",
                        exclude_cond="origin = 'src1'", gte="now-3d", offset=2, size=20)
    return out.select("id", R.dates.to_iso_z("updated").alias("updated"))


@register("docs_of_source", with_fixtures(f"""
SELECT id, origin, {ISO} AS updated FROM docs, now_t
WHERE updated >= now_t.now - INTERVAL 7 DAY AND updated < now_t.now AND origin = 'src2'
""", "docs", "now_t"))
def q_docs_of_source(spark, base):
    """L5 (+C8, C6): one source's docs of the last week."""
    docs, now = _now(spark, base)
    out = R.docs_of_source(docs, now, "src2")
    return out.select("id", "origin", R.dates.to_iso_z("updated").alias("updated"))


@register("csv_rows", with_fixtures(f"""
SELECT origin AS collector_id, id AS news_id, {ISO} AS updated_date, {UNQUOTE} AS link,
       coalesce(title, '') AS title, coalesce(summary, '') AS summary,
       round(CASE WHEN len(topics) > 0 THEN 1.0 * (list_sum(list_transform(topics, lambda t: t.score / 100.0)) / len(topics)) ELSE 0.0 END, 6) AS overall_score,
       CAST(1.0 AS DOUBLE) AS _score,
       array_to_string(flatten(list_transform(coalesce(topics, []), lambda t: [t.label, CAST(t.score AS VARCHAR)])), '|') AS topic_pairs
FROM docs, now_t
WHERE updated >= now_t.now - INTERVAL 30 DAY AND updated < now_t.now
""", "docs", "now_t"))
def q_csv_rows(spark, base):
    """CSV export rows of every source for 30 days."""
    docs, now = _now(spark, base)
    return R.csv_rows(R.docs_of_source(docs, now, None, gte="now-30d"))


@register("date_math_windows", with_fixtures("""
SELECT
  count(*) FILTER (WHERE updated >= now_t.now - INTERVAL 4 HOUR AND updated < now_t.now) AS last_4h,
  count(*) FILTER (WHERE updated >= date_trunc('day', now_t.now - INTERVAL 1 DAY) AND updated < now_t.now) AS yesterday_on,
  count(*) FILTER (WHERE updated >= date_trunc('day', now_t.now - INTERVAL 1 MONTH) AND updated < date_trunc('day', now_t.now)) AS last_month,
  count(*) FILTER (WHERE updated >= date_trunc('day', now_t.now - INTERVAL 1 YEAR)) AS last_year,
  count(*) FILTER (WHERE updated >= now_t.now - INTERVAL 7 DAY) AS last_week
FROM docs, now_t
""", "docs", "now_t"))
def q_date_math_windows(spark, base):
    """The date-math presets (now-4h, now-1d/d, now-1M/d..now/d,
    now-1y/d, now-7d)."""
    docs, now = _now(spark, base)
    return docs.agg(
        F.count_if(P.in_range("updated", "now-4h", "now", now)).alias("last_4h"),
        F.count_if(P.in_range("updated", "now-1d/d", "now", now)).alias("yesterday_on"),
        F.count_if(P.in_range("updated", "now-1M/d", "now/d", now)).alias("last_month"),
        F.count_if(P.in_range("updated", "now-1y/d", None, now)).alias("last_year"),
        F.count_if(P.in_range("updated", "now-7d", None, now)).alias("last_week"),
    )


@register("oldest_first", with_fixtures(f"""
SELECT id, {ISO} AS updated FROM docs WHERE text IS NOT NULL
ORDER BY updated ASC NULLS LAST, {BEST} DESC NULLS LAST, id LIMIT 25
""", "docs"))
def q_oldest_first(spark, base):
    """G3 + G4: oldest first, best topic next, first 25."""
    docs = FX.docs(spark, base).filter(F.col("text").isNotNull())
    out = W.page(W.oldest(docs), 0, 25)
    return out.select("id", R.dates.to_iso_z("updated").alias("updated"))


@register("sort_by_topic_page", with_fixtures(f"""
SELECT id, {BEST} AS best_score FROM docs
ORDER BY {BEST} DESC NULLS LAST, updated DESC NULLS LAST, id LIMIT 30 OFFSET 15
""", "docs"))
def q_sort_by_topic_page(spark, base):
    """G7 (topic mode) + G4 paging (offset 15, size 30)."""
    docs = FX.docs(spark, base)
    out = W.page(W.sort_mode(docs, "topic"), 15, 30)
    return out.select("id", W.best_topic_key().alias("best_score"))


@register("digest", with_fixtures(f"""
SELECT id, {BEST} AS best_score,
       '[' || coalesce(title, summary) || '](' || link || ')' || chr(10) || 'Tags: ' ||
       array_to_string(list_transform(coalesce(tags, []), lambda x: '#' || x || ' '), '') || chr(10) || 'Topics: ' ||
       array_to_string(list_transform(coalesce(list_transform(topics, lambda t: t.label), []), lambda x: '#' || x || ' '), '') ||
       chr(10) || chr(10) AS entry
FROM docs, now_t
WHERE updated >= date_trunc('day', now_t.now - INTERVAL 1 DAY) AND updated < now_t.now AND text IS NOT NULL
ORDER BY {BEST} DESC NULLS LAST, updated DESC, id LIMIT 5
""", "docs", "now_t"))
def q_digest(spark, base):
    """The best 5 since yesterday 00:00 as digest entries."""
    docs, now = _now(spark, base)
    return R.digest(docs, FX.models(spark), now, 5)


@register("digest_cards", with_fixtures(f"""
SELECT id,
       coalesce(title, array_to_string(string_split_regex(translate(trim(substr(text, 1, 120)), '()[]$', ''), '\\r\\n|\\r|\\n'), ' ')) AS card_title,
       array_to_string(list_transform(tags, lambda t: ' #' || regexp_replace(t, '[^A-Za-z0-9]+', '', 'g')), '') AS hashtags,
       array_to_string(list_transform(topics, lambda t: t.label), ' and ') AS topics_text
FROM docs, now_t
WHERE updated >= date_trunc('day', now_t.now - INTERVAL 1 DAY) AND updated < now_t.now AND text IS NOT NULL
ORDER BY {BEST} DESC NULLS LAST, updated DESC, id LIMIT 5
""", "docs", "now_t"))
def q_digest_cards(spark, base):
    """L11 (G6 + I22, I27): the digest's best 5 docs as message cards."""
    docs, now = _now(spark, base)
    best = R.recent_docs(docs, FX.models(spark), now, gte="now-1d/d", size=5)
    c = R.T.card("title", "text", "link", "tags", "topics")
    return best.select("id", c["title"].alias("card_title"), c["hashtags"].alias("hashtags"),
                       c["topics_text"].alias("topics_text"))


@register("pick_one", with_fixtures(f"""
SELECT id FROM docs, now_t
WHERE updated >= now_t.now - INTERVAL 3 DAY AND updated < now_t.now AND text IS NOT NULL
ORDER BY {BEST} DESC NULLS LAST, updated DESC, id LIMIT 1 OFFSET 6
""", "docs", "now_t"))
def q_pick_one(spark, base):
    """Seeded pick at offset 1..10 of the last 3 days (seed 7 draws 6)."""
    docs, now = _now(spark, base)
    return R.pick_one(docs, FX.models(spark), now, seed=7, gte="now-3d").select("id")
