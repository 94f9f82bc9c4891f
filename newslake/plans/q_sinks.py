"""Registered queries: sinks written and read back (B6-B9), dispatch (A7),
projections and switches (C10, C17-C19), registry helpers (I28, I30, I34,
I35), and the prediction / one-source passes (L8, L9).

Sinks write under the cluster's checkpoint dir (shared storage), one fresh
folder per run.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from newslake.functions import text as T
from newslake.functions import urls as U
from newslake.operators import language as L
from newslake.operators import passes as PS
from newslake.operators import predicates as P
from newslake.operators import writes as WR
from newslake.operators.store import Store
from newslake.plans import reports as R
from newslake.plans import catalog, q_topics  # noqa: F401 - registers training_set
from newslake.plans.catalog import register
from newslake.plans.oracle import sql_doc_id, with_fixtures
from newslake.session import ensure_checkpoint_dir
from newslake.sources import feeds as FD
from newslake.sources import fixtures as FX
from newslake.plans.q_text import _EXT, _GATE, language_profile, sql_clean, sql_language, sql_title, sql_visible
from newslake.plans.q_topics import SQL_LABELS, SQL_SCORES, fixed_models, score_columns, sql_fixed_scores

ISO = "strftime(updated, '%Y-%m-%dT%H:%M:%SZ')"


def _scratch(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "sinks", f"{name}-{uuid.uuid4().hex[:12]}")


@register("atom_export", with_fixtures(f"""
SELECT link AS id, coalesce(author, 'unknown') AS author, {ISO} AS updated,
       CAST(len(coalesce(topics, [])) + len(tags) AS INTEGER) AS n_categories
FROM docs, now_t WHERE updated >= now_t.now - INTERVAL 7 DAY AND updated < now_t.now
""", "docs", "now_t"))
def q_atom_export(spark, base):
    """B7 + A1: the week's docs written as Atom entries (XML) and read back
    with the entry schema."""
    docs = FX.docs(spark, base)
    week = docs.filter(P.in_range("updated", "now-7d", "now", FX.clock_for(spark, base)))
    path = _scratch(spark, "atom")
    WR.export_atom(week, path)
    schema = ("id string, author struct<name:string>, updated string, "
              "category array<struct<_term:string,_label:string>>")
    back = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return back.select("id", F.col("author.name").alias("author"), "updated",
                       F.size(F.coalesce("category", F.array())).alias("n_categories"))


@register("csv_export", with_fixtures(f"""
SELECT origin AS collector_id, id AS news_id, {ISO} AS updated_date,
       array_to_string(flatten(list_transform(coalesce(topics, []), lambda t: [t.label, CAST(t.score AS VARCHAR)])), '|') AS topic_pairs
FROM docs, now_t WHERE updated >= now_t.now - INTERVAL 7 DAY AND updated < now_t.now
""", "docs", "now_t"))
def q_csv_export(spark, base):
    """CSV with ``|`` separators and back-quote quoting, read back."""
    docs = FX.docs(spark, base)
    rows = R.csv_rows(R.docs_of_source(docs, FX.clock_for(spark, base), None))
    path = _scratch(spark, "csv")
    WR.export_csv(rows, path)
    back = (spark.read.option("sep", "|").option("quote", "`").option("header", True)
            .option("multiLine", True).schema(rows.schema).csv(path))
    return back.select("collector_id", "news_id", "updated_date",
                       F.coalesce("topic_pairs", F.lit("")).alias("topic_pairs"))


@register("json_export", with_fixtures("""
SELECT doc_id, id, lang FROM docs WHERE lang = 'de'
""", "docs"))
def q_json_export(spark, base):
    """Hits as JSON lines, read back with a schema."""
    docs = FX.docs(spark, base).filter(F.col("lang") == "de").select("doc_id", "id", "lang")
    path = _scratch(spark, "json")
    WR.export_json(docs, path)
    return spark.read.schema(docs.schema).json(path)


@register("training_files", "SELECT model, topic, count(*) AS n FROM (" + catalog.ORACLES["training_set"] + ") GROUP BY model, topic")
def q_training_files(spark, base):
    """The training set written as one folder per model/topic (target
    replaced), read back as counts per folder."""
    from newslake.operators import topics as TP
    ts = TP.training_set(FX.docs(spark, base), FX.models(spark), FX.topics(spark))
    path = _scratch(spark, "training")
    TP.write_training_set(ts, path)
    back = spark.read.parquet(path)
    return back.groupBy("model", "topic").agg(F.count(F.lit(1)).alias("n"))


@register("landed_documents", with_fixtures(f"""
r AS (SELECT 'https://land.example/page/' || page_id AS link, 'text/html' AS content_type, {sql_clean(sql_visible('html'))} AS text FROM pages
      UNION ALL SELECT 'https://land.example/doc/' || doc_id || '.txt', 'text/plain', {sql_clean('text')} FROM documents
      UNION ALL SELECT 'https://land.example/label/' || doc_id, 'application/json', 'quality ' || quality || chr(10) || 'a "b" ' || toxic FROM labels
      UNION ALL SELECT 'https://land.example/nation/' || n_nationkey || '.csv', 'text/csv', 'key name' || chr(10) || n_nationkey || ' ' || n_name FROM nation
      UNION ALL SELECT 'https://land.example/supplier/' || s_suppkey || '.pdf', 'application/pdf', 'Supplier (' || s_name || ')' || chr(10) || 'of nation ' || s_nationkey FROM supplier
      UNION ALL SELECT 'https://land.example/region/' || r_regionkey || '.zip', 'application/zip', NULL FROM region)
SELECT link, content_type, CAST(length(text) AS INTEGER) AS text_len, md5(text) AS text_md5,
       CASE WHEN content_type = 'application/zip' THEN 'refused: archive' WHEN length(trim(text)) > 0 THEN 'successful' ELSE 'error: empty text' END AS outcome
FROM r
"""))
def q_landed_documents(spark, base):
    """Landed responses of five types, many in a file, typed by their bytes,
    headers and links, turned into text and cleaned (I17), with an outcome for each."""
    table = lambda name: FX.read_table(spark, base, name)

    def record(df, key, path, end, body, header=None):
        return df.select(F.concat(F.lit(f"https://land.example/{path}/"), F.col(key).cast("string"), F.lit(end)).alias("link"),
                         F.lit(header).cast("string").alias("header"), F.encode(body, "UTF-8").alias("body"))
    text = lambda *cs: F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in cs])
    number = lambda c: F.col(c).cast("string")
    shown = text("BT (Supplier \\(", F.col("s_name"), "\\)) Tj T* [(of na) -20 (tion ", number("s_nationkey"), ")] TJ ET")
    landed = record(table("pages"), "page_id", "page", "", F.col("html"), "text/html")
    for part in (record(table("documents"), "doc_id", "doc", ".txt", F.col("text"), "text/plain; charset=utf-8"),
                 record(table("labels"), "doc_id", "label", "", text('{"q": "quality ', number("quality"), '", "n": 1, "t": ["a \\"b\\" ', number("toxic"), '"]}')),
                 record(table("nation"), "n_nationkey", "nation", ".csv", text('key,"name"\r\n', number("n_nationkey"), ",", F.col("n_name"))),
                 record(table("supplier"), "s_suppkey", "supplier", ".pdf", text("%PDF-1.4\n1 0 obj <<>> stream\n", shown, "\nendstream endobj")),
                 record(table("region"), "r_regionkey", "region", ".zip", text("PK\x03\x04", F.col("r_name")))):
        landed = landed.unionByName(part)
    path = _scratch(spark, "landed")
    landed.write.parquet(path)
    docs = FD.response_texts(spark.read.parquet(path), header="header")
    return docs.select("link", "content_type", F.length("text").alias("text_len"), F.md5("text").alias("text_md5"), "outcome")


@register("ingest_all", with_fixtures(f"""
SELECT format, count(*) AS n FROM (
  SELECT 'rss' AS format FROM docs
  UNION ALL SELECT 'telegram' FROM chat WHERE turn % 3 = 0
  UNION ALL SELECT 'twitter' FROM conversations)
GROUP BY format
""", "docs", "chat"))
def q_ingest_all(spark, base):
    """Every reader's output (feed items, chat posts, tweets) in one
    table by column name."""
    from newslake.plans.q_writes import _tweets_json
    docs = FX.docs(spark, base).select("id", "link", "title", "origin", "format")
    chat = FD.messages_to_docs(FX.chat_messages(spark, base), F.lit(None).cast("timestamp_ntz"))
    tw = _tweets_json(spark, base).select(F.from_json("json", FD.TWEET_SCHEMA).alias("t")).select("t.*")
    tweets = FD.tweets_to_docs(tw, "twitter-source")
    allv = FD.ingest_all({"rss": docs, "telegram": chat, "twitter": tweets})
    return allv.groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@register("projections", with_fixtures("""
SELECT doc_id, CAST(1.0 AS DOUBLE) AS score, origin, lang FROM docs WHERE author IS NULL
""", "docs"))
def q_projections(spark, base):
    """C10 (constant score filter on C2 ``missing(author)``) + C17 (include /
    exclude fields)."""
    docs = FX.docs(spark, base)
    kept = P.constant_score(docs, P.missing("author"))
    return P.project(kept, ["doc_id", "score", "origin", "lang", "text"], exclude=["text"])


@register("sample_cap", with_fixtures("""
SELECT count(*) AS n FROM (SELECT 1 FROM docs LIMIT 25)
""", "docs"))
def q_sample_cap(spark, base):
    """Early-stop cap (``terminate_after`` / limit filter) -- the limit is
    the feature; only the row count is deterministic."""
    docs = FX.docs(spark, base)
    return P.sample_cap(docs, 25).agg(F.count(F.lit(1)).alias("n"))


@register("source_switches", with_fixtures("""
SELECT id, CASE WHEN id IN ('src1', 'src2') THEN false ELSE true END AS predict_on,
       CASE WHEN id = 'src3' THEN false ELSE true END AS active, true AS enable_content
FROM sources
""", "sources"))
def q_source_switches(spark, base):
    """C19 + I30: source flags with their null defaults; prediction runs only
    when the source flag and the global switch allow it."""
    src = FX.sources(spark, base).select(
        "id",
        F.when(F.col("id").isin("src1", "src2"), F.lit(False)).alias("predict"),
        F.when(F.col("id") != "src3", F.lit(True)).alias("active"),
        F.lit(None).cast("boolean").alias("enable_content"))
    src = FD.with_defaults(src, "source")
    return src.select("id", P.predict_enabled("predict", True).alias("predict_on"), "active", "enable_content")


@register("registry_links", with_fixtures(f"""
SELECT id, '/api/source/' || {sql_doc_id("'source:' || title")} AS link FROM sources
""", "sources"))
def q_registry_links(spark, base):
    """Registry id links of the sources."""
    s = FX.sources(spark, base)
    return s.select("id", U.registry_link("source", "title").alias("link"))


@register("tag_links", with_fixtures("""
SELECT doc_id, array_to_string(list_transform(tags, lambda t: '[' || t || '](https://nvd.nist.gov/vuln/detail/' || t || ')'), ', ') AS links
FROM docs
""", "docs"))
def q_tag_links(spark, base):
    """One markdown link per extracted value (here the doc tags)."""
    d = FX.docs(spark, base)
    return d.select("doc_id", U.cve_links("tags").alias("links"))


@register("document_labels", with_fixtures("""
SELECT conv_id, turn, 'conv_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) || '.txt  type: text/plain size: '
       || CAST(strlen(text) AS VARCHAR) || ' bytes' AS caption
FROM conversations WHERE role = 'assistant'
"""))
def q_document_labels(spark, base):
    """Chat document captions (name, type, size in bytes)."""
    conv = FX.read_table(spark, base, "conversations").filter(F.col("role") == "assistant")
    name = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"),
                    F.lit(".txt"))
    return conv.select("conv_id", "turn", T.document_label(name, F.lit("text/plain"),
                                                           F.octet_length("text")).alias("caption"))


def _store(spark, name: str, df) -> Store:
    store = Store(spark, _scratch(spark, name))
    store.create(df)
    return store


_EMPTY_TOPICS = "array<struct<label:string,score:double>>"


@register("prediction_pass", with_fixtures(f"""
target AS (SELECT id, title, summary, text FROM docs),
{sql_fixed_scores('target')}
SELECT d.id, d.origin, CASE WHEN d.text IS NULL THEN NULL ELSE {SQL_LABELS[:-len(" AS labels")]} END AS labels, {SQL_SCORES} FROM docs d JOIN fixed_scores USING (id)
""", "docs"))
def q_prediction_pass(spark, base):
    """L8 on a stored doc table: docs with text -> classifier input (I19) ->
    topics (J9) -> upsert (B1), read back."""
    docs = FX.docs(spark, base).select("id", "origin", "title", "summary", "text", F.lit(None).cast(_EMPTY_TOPICS).alias("topics"))
    out = PS.prediction_pass(_store(spark, "predict", docs), fixed_models(spark))
    return out.select("id", "origin", *score_columns())


# The landed pages as docs of three feeds (their language part) that wait for text.
_FEED = r"^https?://[^/]+/([a-z]{2})/"


def _stubs(spark, base):
    pages = FX.pages(spark, base)
    stubs = pages.select(U.doc_id("link").alias("id"), F.regexp_extract("link", _FEED, 1).alias("origin"), "link", F.lit(None).cast("string").alias("text"),
                         F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast(_EMPTY_TOPICS).alias("topics"), F.col("page_id").alias("seq"))
    return pages, WR.upsert(stubs.limit(0), stubs, "id", "seq").drop("seq")


_CONTENT = _EXT + f""",
last AS (SELECT {sql_doc_id('url')} AS id, ext.*, coalesce({sql_title('html')}, first_sentence) AS title, summary, coalesce(tags, '') AS tags, {_GATE} AS gate,
                regexp_extract(url, '{_FEED}', 1) AS origin,
                NULLIF(lower(regexp_extract(html, '(?is)<html\\b[^>]*\\blang\\s*=\\s*["'']?([A-Za-z-]+)', 1)), '') AS attribute
         FROM ext LEFT JOIN summ USING (page_id) LEFT JOIN tags USING (page_id)
         QUALIFY row_number() OVER (PARTITION BY {sql_doc_id('url')} ORDER BY page_id DESC) = 1),
target AS (SELECT id, title, summary, text FROM last),
{sql_fixed_scores('target')},""" + sql_language("target") + f""",
passed AS (SELECT last.id, origin, CASE WHEN NOT gate THEN 'unchanged' WHEN length(text) > 1000 THEN 'successful' ELSE 'failed: text too small' END AS outcome,
       CAST(CASE WHEN gate THEN length(text) END AS INTEGER) AS text_len, CASE WHEN gate THEN md5(summary) END AS summary_md5, CASE WHEN gate THEN tags END AS tags,
       CASE WHEN gate THEN coalesce(NULLIF(detected, ''), attribute) END AS language, CASE WHEN gate THEN {SQL_LABELS[:-len(" AS labels")]} END AS labels,
       {", ".join(f"CASE WHEN gate THEN round(s{k}, 6) END AS score_{k}" for k in range(3))}
  FROM last JOIN fixed_scores USING (id) JOIN language ON language.id = last.id)
"""


def _passed(out):
    return out.select("id", F.coalesce("outcome", F.lit("unchanged")).alias("outcome"), F.length("text").alias("text_len"), F.md5("summary").alias("summary_md5"),
                      F.array_join(F.array_sort("tags"), ",").alias("tags"), F.col("lang").alias("language"), *score_columns())


@register("content_pass", with_fixtures(_CONTENT + "SELECT * EXCLUDE (origin) FROM passed"))
def q_content_pass(spark, base):
    """L7 (+D7, C11-C14, J1-J5, J9, B1, B11) on a stored doc table: docs without
    text are filled from the landed pages (text, summary, tags, language), small
    texts flagged (the doc is kept), topics predicted, and what changed upserted."""
    pages, stubs = _stubs(spark, base)
    store = _store(spark, "content", stubs)
    return _passed(PS.content_pass(store, pages, language=L.language_of(*language_profile(spark, base)), models=fixed_models(spark)))


@register("source_refresh", with_fixtures(_CONTENT + "SELECT * EXCLUDE (origin) FROM passed WHERE origin = 'de'"))
def q_source_refresh(spark, base):
    """One feed of the store collected from the landed entries (new ones
    are added) and its children's content pass; other feeds are not touched."""
    pages, entries = _stubs(spark, base)
    store = _store(spark, "refresh", entries.filter("origin <> 'de'"))
    return _passed(PS.source_refresh(store, "de", entries, pages, language=L.language_of(*language_profile(spark, base)), models=fixed_models(spark)))


@register("store_upsert", with_fixtures("""
allv AS (SELECT id, origin, title, 0 AS seq FROM docs
         UNION ALL SELECT id, origin, 'new: ' || title, 1 FROM docs WHERE origin IN ('src1', 'src2', 'src19')
         UNION ALL SELECT 'extra' || id, 'src2', title, 1 FROM docs WHERE origin = 'src3'),
kept AS (SELECT * FROM allv QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT origin, count(*) AS n, count(*) FILTER (WHERE title LIKE 'new: %') AS n_new, md5(string_agg(id || coalesce(title, ''), ',' ORDER BY id)) AS rows_md5,
       origin IN ('src1', 'src2', 'src19') AS rewritten FROM kept GROUP BY origin
""", "docs"))
def q_store_upsert(spark, base):
    """B1 on a stored doc table: a batch for three sources replaces and adds rows;
    read back by source, with whether its files are new ones."""
    docs = FX.docs(spark, base).select("id", "origin", "title")
    store = _store(spark, "upsert", docs)
    before = store.folders()
    batch = docs.filter(F.col("origin").isin("src1", "src2", "src19")).withColumn("title", F.concat(F.lit("new: "), "title")).unionByName(
        docs.filter("origin = 'src3'").select(F.concat(F.lit("extra"), "id").alias("id"), F.lit("src2").alias("origin"), "title"))
    store.upsert(batch)
    moved = [p for p, f in store.folders().items() if before.get(p) != f]  # one for each source
    line = F.concat("id", F.coalesce("title", F.lit("")))
    return store.read().groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("title").startswith("new: ")).alias("n_new"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), ",")).alias("rows_md5")).withColumn("rewritten", F.col("origin").isin(moved))
