"""Registered queries: page extraction, text functions, language detection,
summaries and keywords, the content pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslake.functions import text as T
from newslake.functions import urls as U
from newslake.operators import language as L
from newslake.operators import text as X
from newslake.plans.catalog import register
from newslake.plans.oracle import sql_doc_id, with_fixtures
from newslake.sources import fixtures as FX

# ---------------------------------------------------------------------------
# SQL twins of the HTML functions
# ---------------------------------------------------------------------------
CRLF = "chr(13) || chr(10)"


def sql_decode(e: str) -> str:
    out = e
    # The references that occur in the driver's pages, for engines without a decoder.
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"),
                    ("&middot;", "·"), ("&amp;", "&")]:
        q = ch.replace("'", "''")
        out = f"replace({out}, '{ent}', '{q}')"
    return out


def sql_strip(h: str) -> str:
    h = f"regexp_replace({h}, '(?s)<!--.*?-->', '', 'g')"
    return rf"regexp_replace({h}, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>|<title\b[^>]*>.*?</title\s*>', '', 'g')"


def sql_nodes(h: str) -> str:
    s = f"regexp_replace({sql_strip(h)}, '(?s)<[^>]*>', chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({s}, chr(1)), lambda x: trim({sql_decode('x')})), "
            f"lambda x: length(x) > 0)")


def sql_visible(h: str) -> str:
    return f"array_to_string({sql_nodes(h)}, {CRLF})"


def sql_plain(c: str) -> str:
    return f"trim(regexp_replace({sql_decode(f'regexp_replace({c}, {chr(39)}(?s)<[^>]*>{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, '\\s+', ' ', 'g'))"


def sql_blocks(h: str) -> str:
    split = "(?i)<(?:" + "|".join(X.BLOCK_TAGS) + ")\\b[^>]*>"
    blocks = f"regexp_split_to_array({sql_strip(h)}, '{split}')"
    links = "array_to_string(regexp_extract_all(b, '(?is)<a\\b[^>]*>(.*?)</a>', 1), ' ')"
    return f"list_transform({blocks}, lambda b: {{'text': {sql_plain('b')}, 'link_chars': length({sql_plain(links)})}})"


def sql_pages(min_size: int = T.NEWS_MIN_TEXT_SIZE) -> str:
    """CTEs up to ``main(page_id, url, html, dense, article, visible, main)``: the steps of J4 side by side."""
    few = f"x.link_chars <= length(x.text) * {X.MAX_LINK_DENSITY}"
    lines = "array_to_string(list_transform({}, lambda x: x.text), chr(10))"
    smooth = f"coalesce(w[i - 1], 0) + 2 * w[i] + coalesce(w[i + 1], 0) >= {4 * X.MIN_BLOCK_CHARS}"
    dense = f"list_filter(blocks, lambda x: length(x.text) >= {X.MIN_BLOCK_CHARS} AND {few})"
    weights = "list_transform(full_, lambda x: length(x.text) - 2 * x.link_chars)"
    return f"""
blk AS (SELECT page_id, url, html, {sql_blocks('html')} AS blocks, {sql_visible('html')} AS visible FROM pages),
full_blk AS (SELECT *, list_filter(blocks, lambda x: length(x.text) > 0) AS full_ FROM blk),
weighed AS (SELECT *, {weights} AS w FROM full_blk),
steps AS (SELECT page_id, url, html, visible, {lines.format(dense)} AS dense,
          {lines.format(f"list_filter(full_, lambda x, i: {few} AND {smooth})")} AS article FROM weighed),
main AS (SELECT *, CASE WHEN length(article) >= {min_size} THEN article WHEN length(visible) >= {min_size} OR length(dense) = 0 THEN visible ELSE dense END AS main FROM steps)"""


def sql_clean(e: str) -> str:
    return f"replace(replace({e}, chr(10) || chr(10), chr(10)), '....', ' ')"


def sql_title(h: str) -> str:
    t = f"NULLIF(trim(regexp_extract({h}, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)), '')"
    meta = (f"NULLIF(regexp_extract({h}, '(?is)<meta[^>]*(?:name|property)=.(?:og:)?title.[^>]*content=.([^\"'']*)', 1), '')")
    return sql_decode(f"coalesce({t}, {meta})")


def sql_words(e: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({e}), '[^\\p{{L}}]+'), lambda t: length(t) > 0)"


# ---------------------------------------------------------------------------
# I12-I17, I26, I32, I36 on pages
# ---------------------------------------------------------------------------
@register("visible_text", with_fixtures(f"""
SELECT page_id, md5({sql_visible('html')}) AS text_md5, CAST(length({sql_visible('html')}) AS INTEGER) AS text_len,
       CAST(len({sql_nodes('html')}) AS INTEGER) AS n_nodes
FROM pages
"""))
def q_visible_text(spark, base):
    """Visible text nodes of every page."""
    p = FX.pages(spark, base)
    vt = T.visible_text("html")
    return p.select("page_id", F.md5(vt).alias("text_md5"), F.length(vt).alias("text_len"),
                    F.size(T.text_nodes("html")).alias("n_nodes"))


@register("html_title", with_fixtures(f"""
SELECT page_id, {sql_title('html')} AS title,
       array_to_string(list_filter(list_transform(string_split(regexp_extract(html, '(?is)<meta[^>]*name=.keywords.[^>]*content=.([^"'']*)', 1), ','), lambda x: trim(x)), lambda x: length(x) > 0), ',') AS keywords,
       NULLIF(regexp_extract(html, '(?is)<meta[^>]*http-equiv=.?refresh[^>]*content=.?[0-9]*;\\s*url=([^"''>\\s]+)', 1), '') AS refresh,
       md5(to_base64(encode(html))) AS html_b64_md5,
       CASE WHEN contains(url, '.pdf') THEN 'application/pdf' ELSE 'text/html' END AS content_type
FROM pages
"""))
def q_html_title(spark, base):
    """Title, keywords meta, refresh target,
    base64 page, content type."""
    p = FX.pages(spark, base)
    return p.select("page_id", T.html_title("html").alias("title"),
                    F.array_join(T.meta_keywords("html"), ",").alias("keywords"),
                    U.meta_refresh_target("html").alias("refresh"),
                    F.md5(T.b64_html("html")).alias("html_b64_md5"),
                    T.content_type_of("link", F.lit("text/html")).alias("content_type"))


@register("html_tokens", with_fixtures(f"""
SELECT page_id, CAST(len(list_filter(regexp_split_to_array(lower(replace(array_to_string({sql_nodes('html')}, ' '), '&', ' and ')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 0)) AS INTEGER) AS n_tokens
FROM pages
"""))
def q_html_tokens(spark, base):
    """The html analyser (tokens of the page text, ``&`` as ``and``)."""
    p = FX.pages(spark, base)
    return p.select("page_id", F.size(T.html_tokens("html")).alias("n_tokens"))


@register("main_text", with_fixtures(sql_pages() + f"""
SELECT page_id, md5({sql_clean('main')}) AS text_md5, CAST(length({sql_clean('main')}) AS INTEGER) AS text_len,
       CAST(length(article) AS INTEGER) AS article_len, CAST(length(dense) AS INTEGER) AS dense_len
FROM main
"""))
def q_main_text(spark, base):
    """J4 (+I17): the article by smoothed density, then the visible text, then the dense blocks."""
    p = FX.pages(spark, base)
    t = T.clean_extracted(X.extract_main_text("html"))
    return p.select("page_id", F.md5(t).alias("text_md5"), F.length(t).alias("text_len"),
                    F.length(X.article_text("html")).alias("article_len"), F.length(X.dense_text("html")).alias("dense_len"))


STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
# Extracted text, summary and tags of each page.
_EXT = sql_pages() + f""",
ext AS (SELECT page_id, url, html, {sql_clean('main')} AS text FROM main),
sents AS (SELECT page_id, pos, trim(s) AS sentence FROM (SELECT page_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos
          FROM (SELECT page_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS ss FROM ext)) WHERE length(trim(s)) > 0),
toks AS (SELECT page_id, pos, unnest({sql_words('sentence')}) AS token FROM sents),
tf AS (SELECT page_id, token, count(*) AS c FROM toks GROUP BY 1, 2),
best AS (SELECT t.page_id, t.pos, row_number() OVER (PARTITION BY t.page_id ORDER BY avg(tf.c) DESC, t.pos) AS rn FROM toks t JOIN tf USING (page_id, token) GROUP BY 1, 2),
summ AS (SELECT page_id, string_agg(sentence, ' ' ORDER BY pos) AS summary, max(sentence) FILTER (WHERE rn = 1) AS first_sentence
         FROM best JOIN sents USING (page_id, pos) WHERE rn <= 3 GROUP BY page_id),
words AS (SELECT page_id, unnest({sql_words('text')}) AS token FROM ext),
topw AS (SELECT page_id, token FROM words WHERE length(token) >= 3 AND token NOT IN ({STOPS})
         GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, token) <= 10),
tags AS (SELECT page_id, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (
         SELECT page_id, regexp_replace(replace(replace(lower(trim(token)), 'news', ''), ' ', '_'), '[^\\x00-\\x7F]', '', 'g') AS t FROM topw)
         WHERE length(t) > 0 GROUP BY page_id)"""


@register("extract_docs", with_fixtures(_EXT + f"""
SELECT page_id, {sql_doc_id('url')} AS id,
       coalesce({sql_title('html')}, first_sentence) AS title,
       NULLIF(lower(regexp_extract(html, '(?is)<html[^>]*\\blang=.([A-Za-z-]+)', 1)), '') AS lang,
       CAST(length(text) AS INTEGER) AS text_len, length(text) > 1000 AS long_enough,
       md5(summary) AS summary_md5, coalesce(tags, '') AS tags,
       CASE WHEN contains(url, '.pdf') THEN 'application/pdf' ELSE 'text/html' END AS content_type
FROM ext LEFT JOIN summ USING (page_id) LEFT JOIN tags USING (page_id)
"""))
def q_extract_docs(spark, base):
    """J5 (+C14, J2, J3, I32): pages to doc fields."""
    d = X.extract_docs(FX.pages(spark, base))
    return d.select("page_id", "id", "title", "lang", F.length("text").alias("text_len"),
                    F.coalesce(F.length("text") > 1000, F.lit(False)).alias("long_enough"),
                    F.md5("summary").alias("summary_md5"), F.array_join(F.array_sort("tags"), ",").alias("tags"), "content_type")


@register("url_filters", with_fixtures("""
SELECT page_id,
       coalesce(regexp_matches(url, '(?i)^(?:http|ftp)s?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\\.)+(?:[A-Z]{2,6}\\.?|[A-Z0-9-]{2,}\\.?)|localhost|\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3})(?::\\d+)?(?:/?|[/?]\\S+)$'), false)
       AND NOT regexp_matches(url, '(cheap-pills)|(spam-farm)')
       AND NOT regexp_matches(url, '((\\.html))([?#].*)?$') AS crawlable
FROM pages
"""))
def q_url_filters(spark, base):
    """C11-C13 + N4: configured exclusion lists (spam hosts, ``.html``
    pages) instead of the defaults."""
    p = FX.pages(spark, base)
    ok = (U.is_valid_url("link") & U.not_excluded_uri("link", [r"cheap-pills", r"spam-farm"])
          & U.not_excluded_type("link", None, [r"\.html"]))
    return p.select("page_id", ok.alias("crawlable"))


_GATE = ("coalesce(regexp_matches(url, '(?i)^(?:http|ftp)s?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\\.)+"
         "(?:[A-Z]{2,6}\\.?|[A-Z0-9-]{2,}\\.?)|localhost|\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3})"
         "(?::\\d+)?(?:/?|[/?]\\S+)$'), false) AND NOT regexp_matches(url, '(sourceforge\\.net)') "
         "AND NOT regexp_matches(url, '((\\.iso)|(\\.mp3)|(\\.mp4)|(\\.bin)|(\\.rom)|(\\.zip)|(\\.tar)|"
         "(\\.tgz)|(\\.xz)|(\\.img))([?#].*)?$')")


@register("extract_rules", with_fixtures("""
SELECT doc_id,
       array_to_string(regexp_extract_all(text, '(?im)(CVE-[0-9]{4}-[0-9]{4,})', 1), ',') AS cve,
       array_to_string(regexp_extract_all(text, '(?im)([a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,})', 1), ',') AS email,
       array_to_string(regexp_extract_all(text, '(?im)(token = "[0-9a-f]+")', 1), ',') AS token,
       array_to_string(regexp_extract_all(text, '(?im)(released under the [a-z0-9 .-]+ license)', 1), ',') AS license
FROM documents
"""))
def q_extract_rules(spark, base):
    """Configured extraction rules (name -> regex) on whole texts."""
    rules = {"cve": r"CVE-[0-9]{4}-[0-9]{4,}", "email": r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}",
             "token": r"token = \"[0-9a-f]+\"", "license": r"released under the [a-z0-9 .-]+ license"}
    d = FX.read_table(spark, base, "documents")
    cols = [F.array_join(c, ",").alias(name) for name, c in
            zip(rules, [T.extract_rule("text", p) for p in rules.values()])]
    return d.select("doc_id", *cols)


@register("prediction_input", with_fixtures("""
SELECT doc_id, md5(regexp_replace(concat_ws(chr(13) || chr(10), title, summary, text), 'https?://\\S+', '', 'g')) AS input_md5
FROM docs
""", "docs"))
def q_prediction_input(spark, base):
    """The classifier input (title, summary, text; every URL removed)."""
    d = FX.docs(spark, base)
    return d.select("doc_id", F.md5(T.prediction_input("title", "summary", "text")).alias("input_md5"))


@register("card_fields", with_fixtures("""
SELECT doc_id,
       coalesce(title, array_to_string(string_split_regex(translate(trim(substr(text, 1, 120)), '()[]$', ''), '\\r\\n|\\r|\\n'), ' ')) AS card_title,
       array_to_string(string_split_regex(translate(trim(substr(text, 1, 250)), '()[]$', ''), '\\r\\n|\\r|\\n'), ' ') AS extract,
       array_to_string(list_transform(tags, lambda t: ' #' || regexp_replace(t, '[^A-Za-z0-9]+', '', 'g')), '') AS hashtags,
       array_to_string(list_transform(topics, lambda t: t.label), ' and ') AS topics_text,
       round(coalesce(list_sum(list_transform(topics, lambda t: t.score)) / len(topics), 0.0), 6) AS score,
       replace(translate(origin, '-', '_'), 'src', 'source_') AS sanitized
FROM docs
""", "docs"))
def q_card_fields(spark, base):
    """Message card of every doc."""
    d = FX.docs(spark, base)
    c = T.card("title", "text", "link", "tags", "topics")
    return d.select("doc_id", c["title"].alias("card_title"), c["extract"].alias("extract"),
                    c["hashtags"].alias("hashtags"), c["topics_text"].alias("topics_text"),
                    F.round(c["score"], 6).alias("score"),
                    F.replace(T.sanitize_topic_title("origin"), F.lit("src"), F.lit("source_")).alias("sanitized"))


@register("share_links", with_fixtures("""
SELECT doc_id,
       'https://twitter.com/intent/tweet?text=' || replace(replace(url_encode(title), '%20', '+'), '~', '%7E') || '%20' ||
           replace(replace(url_encode(link), '%20', '+'), '~', '%7E') AS twitter,
       'https://www.reddit.com/submit?url=' || replace(replace(url_encode(link), '%20', '+'), '~', '%7E') AS reddit
FROM docs
""", "docs"))
def q_share_links(spark, base):
    """I23 (+I2 ``quote_plus``): share URLs of every doc."""
    d = FX.docs(spark, base)
    s = U.share_links("title", "link", F.lit(""), "tags")
    return d.select("doc_id", s["twitter"].alias("twitter"), s["reddit"].alias("reddit"))


@register("language_names", with_fixtures("""
SELECT lang, count(*) AS n,
       CASE lang WHEN 'de' THEN 'german' WHEN 'en' THEN 'english' WHEN 'es' THEN 'spanish'
                 WHEN 'fr' THEN 'french' ELSE lang END AS language
FROM documents GROUP BY lang
"""))
def q_language_names(spark, base):
    """Language code -> summariser language name."""
    d = FX.read_table(spark, base, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(
        "lang", "n", T.language_name("lang").alias("language"))


@register("fetch_outcomes", with_fixtures("""
SELECT CASE WHEN status < 300 THEN 'found' WHEN status = 429 THEN 'retry'
            WHEN status >= 400 AND status <= 427 THEN 'refused' WHEN status >= 500 THEN 'server error'
            ELSE 'other' END AS outcome, count(*) AS n
FROM (SELECT CAST(round(value * 10) AS INTEGER) % 600 AS status FROM events) GROUP BY 1
"""))
def q_fetch_outcomes(spark, base):
    """I36 on a fetch log (status codes derived from the events)."""
    ev = FX.read_table(spark, base, "events")
    log = ev.select((F.round(F.col("value") * 10).cast("int") % 600).alias("status"))
    return log.groupBy(T.fetch_outcome("status").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# J1 language detection, J2 summaries, J3 keywords
# ---------------------------------------------------------------------------
_W = sql_words("text")


def sql_cells(text: str) -> str:
    """The cells of a text's n-grams (J1), a list."""
    norm = f"string_split(' ' || trim(regexp_replace(lower({text}), '{L.NOT_LETTERS}', ' ', 'g')) || ' ', '')"
    def grams(n):
        terms = " + ".join(f"c[i + {k}] * {L.FACTORS[n - 1 - k]}" for k in range(n))
        return f"list_transform(range(1, len(c) - {n} + 2), lambda i: ({terms} + {n * 7919}) % {L.CELLS})"
    found = " || ".join(grams(n) for n in range(1, L.ORDERS + 1))
    return f"(SELECT CASE WHEN len(c) < 3 THEN [] ELSE {found} END FROM (SELECT list_transform({norm}, lambda x: unicode(x)::BIGINT) AS c))"


def sql_language(target: str) -> str:
    """CTEs up to ``language(id, detected)`` for the rows of ``target(id, text)``, by the profile of ``documents``."""
    return f"""
lab AS (SELECT doc_id, lang, unnest({sql_cells('text')}) AS cell FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
prof AS (SELECT lang, cell, count(*) AS n FROM lab GROUP BY 1, 2),
langs AS (SELECT d.lang, ln(d.docs / sum(d.docs) OVER ()) AS prior, ln(coalesce(g.grams, 0) + {L.CELLS}) AS denom
          FROM (SELECT lang, count(*) AS docs FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang) d
          LEFT JOIN (SELECT lang, sum(n) AS grams FROM prof GROUP BY lang) g USING (lang)),
cnt AS (SELECT id, cell, count(*) AS c FROM (SELECT id, unnest({sql_cells("coalesce(text, '')")}) AS cell FROM {target}) GROUP BY 1, 2),
total AS (SELECT id, sum(c) AS m FROM cnt GROUP BY id),
seen AS (SELECT id, lang, sum(c * ln(n + 1)) AS s FROM cnt JOIN prof USING (cell) GROUP BY 1, 2),
sc AS (SELECT total.id, langs.lang, prior + coalesce(seen.s, 0) - m * denom AS score FROM total CROSS JOIN langs LEFT JOIN seen ON seen.id = total.id AND seen.lang = langs.lang),
won AS (SELECT id, lang FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) = 1),
language AS (SELECT t.id, coalesce(won.lang, '') AS detected FROM {target} t LEFT JOIN won ON won.id = t.id)"""


def language_profile(spark, base):
    """The profile fitted on the labelled documents, stored under the checkpoint dir, once a session."""
    import os
    import uuid
    from newslake.session import ensure_checkpoint_dir
    key = (spark.sparkContext.applicationId, base)
    if key not in _PROFILES:
        path = os.path.join(ensure_checkpoint_dir(spark), "models", f"lang-{uuid.uuid4().hex[:12]}")
        L.fit_language_profiles(FX.read_table(spark, base, "documents"), path=path)
        _PROFILES[key] = path
    return L.read_language_profiles(spark, _PROFILES[key])


_PROFILES: dict[tuple[str, str], str] = {}


@register("language_detect", with_fixtures(f"""
target AS (SELECT page_id AS id, {sql_visible('html')} AS text FROM pages),""" + sql_language("target") + """
SELECT id AS page_id, detected FROM language
"""))
def q_language_detect(spark, base):
    """Character n-gram profiles fitted on the labelled documents and stored,
    applied to the visible text of every page."""
    from newslake.operators.partitioning import spread
    target = spread(FX.pages(spark, base)).select("page_id", T.visible_text("html").alias("text"))
    return L.detect_language(target, *language_profile(spark, base), "page_id")


@register("summaries", with_fixtures(f"""
ex AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS ss FROM documents),
sents AS (SELECT doc_id, pos, trim(s) AS sentence
          FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM ex)
          WHERE length(trim(s)) > 0),
toks AS (SELECT doc_id, pos, unnest({sql_words('sentence')}) AS token FROM sents),
tf AS (SELECT doc_id, token, count(*) AS c FROM toks GROUP BY 1, 2),
ss2 AS (SELECT t.doc_id, t.pos, avg(tf.c) AS score FROM toks t JOIN tf USING (doc_id, token) GROUP BY 1, 2),
top AS (SELECT * FROM ss2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) <= 3)
SELECT doc_id, md5(string_agg(sentence, ' ' ORDER BY pos)) AS summary_md5 FROM top JOIN sents USING (doc_id, pos)
GROUP BY doc_id
"""))
def q_summaries(spark, base):
    """3-sentence extractive summary of every document (whole texts)."""
    d = FX.read_table(spark, base, "documents")
    s = X.summarize(d, "doc_id", "text", 3)
    return s.select("doc_id", F.md5("summary").alias("summary_md5"))


@register("keywords", with_fixtures(f"""
toks AS (SELECT doc_id, unnest({_W}) AS token FROM documents),
cnt AS (SELECT doc_id, token, count(*) AS n FROM toks
        WHERE length(token) >= 3 AND token NOT IN ({", ".join(repr(w) for w in X.STOP_WORDS)})
        GROUP BY 1, 2)
SELECT doc_id, token, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS INTEGER) AS rank
FROM cnt QUALIFY rank <= 10
"""))
def q_keywords(spark, base):
    """The 10 most frequent non-stop words of every document."""
    d = FX.read_table(spark, base, "documents")
    return X.keywords(d, "doc_id", "text", 10)
