"""Registered queries: streaming operators run with ``availableNow`` over the
driver tables as file streams; the final store view is returned. Where the
final state equals a batch query, that query's SQL is the oracle."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from newslake.functions import text as T
from newslake.functions import urls as U
from newslake.operators import text as X
from newslake.operators.store import Store
from newslake.plans.catalog import register
from newslake.plans.oracle import sql_doc_id, with_fixtures
from newslake.plans.q_text import _GATE, sql_clean, sql_pages
from newslake.plans.q_topics import SQL_LABELS, SQL_SCORES, fixed_models, score_columns, sql_fixed_scores
from newslake.sources import fixtures as FX
from newslake.streaming import streams as S


ARRIVALS = 4


def _stream(spark, base, name, key):
    """The whole table as a stream of several arrivals: rows land in ``ARRIVALS``
    folders one after the other (``key`` modulo their number) and are read a folder
    at a time, so state, updates and resuming cross micro-batches, whose number
    does not grow with the table. (If folders differ in their number of files:
    a file at a time.)"""
    static = FX.read_table(spark, base, name).withColumn("arrival", F.pmod(F.col(key), F.lit(ARRIVALS)).cast("int"))
    # One arrival a day.
    static = static.withColumn("landed", F.timestamp_seconds(F.col("arrival") * 86400))
    path = S.checkpoint_path(spark, f"landed-{name}")
    for i in range(ARRIVALS):
        static.filter(F.col("arrival") == i).write.parquet(os.path.join(path, f"{i}"))
    files = {len(spark.read.schema(static.schema).parquet(os.path.join(path, f"{i}")).inputFiles()) for i in range(ARRIVALS)}
    return S.file_stream(spark, os.path.join(path, "*"), static.schema, "parquet", max(files) if len(files) == 1 else 1)


@register("stream_votes", with_fixtures("""
SELECT doc_id, voter, score FROM votes
QUALIFY row_number() OVER (PARTITION BY doc_id, voter ORDER BY event_id % 4 DESC, event_id DESC) = 1
""", "votes"))
def q_stream_votes(spark, base):
    """M5 (+M8): votes as a stream; the last vote per (doc, voter) is
    streaming state of the last days (update mode), upserted into a stored
    table and read back; arrival order wins."""
    n_docs = FX.read_table(spark, base, "documents").count()
    ev = _stream(spark, base, "events", "event_id")
    votes = (ev.filter(F.col("event_type").isin(list(FX.VOTE_SCORES)))
             .select("event_id", "arrival", "landed", (F.col("event_id") % n_docs).alias("doc_id"),
                     F.col("user_id").cast("string").alias("voter"),
                     F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1)
                     .otherwise(2).alias("score")))
    latest = S.latest_per_key_stream(votes, ["doc_id", "voter"], ["arrival", "event_id"], ["score"], arrival="landed")
    ck = S.checkpoint_path(spark, "votes")
    # A vote's folder is a share of the docs; its key is the doc and the voter.
    keyed = latest.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(8))).withColumn("id", F.concat_ws("/", "doc_id", "voter"))
    store = Store(spark, ck + "/store", part="share")
    S.run_into_store(keyed, store, "votes", ck + "/ckpt")
    return store.read().select("doc_id", "voter", "score")


@register("stream_resume_points", with_fixtures("""
SELECT user_id, max(event_id) AS since_id FROM events GROUP BY user_id
"""))
def q_stream_resume_points(spark, base):
    """M6: per-account high-water marks: streaming state of the last days,
    upserted into a stored table where the higher mark stays."""
    ev = _stream(spark, base, "events", "event_id")
    marks = S.resume_points(ev, "user_id", "event_id", arrival="landed").withColumn("share", F.pmod(F.xxhash64("user_id"), F.lit(4)))
    ck = S.checkpoint_path(spark, "resume")
    store = Store(spark, ck + "/store", part="share", key="user_id")
    S.run_into_store(marks, store, "marks", ck + "/ckpt")
    return store.read().select("user_id", "since_id")


@register("stream_dedup", with_fixtures("""
SELECT user_id, min(event_id % 4)::INTEGER AS arrival FROM events GROUP BY user_id
"""))
def q_stream_dedup(spark, base):
    """M4: drop repeated keys within the watermark: one row per key, from its
    first arrival."""
    ev = _stream(spark, base, "events", "event_id")
    first = S.dedup_first_seen(ev.select("user_id", "ts", "arrival"), "user_id", "ts", "3650 days")
    ck = S.checkpoint_path(spark, "dedup")
    S.run_available(first, ck + "/out", ck + "/ckpt", output_mode="append")
    return S.read_batches(spark, ck + "/out").select("user_id", "arrival")


@register("stream_content", with_fixtures(sql_pages() + f"""
SELECT {sql_doc_id('url')} AS id,
       CASE WHEN length({sql_clean('main')}) > 1000 THEN 'successful' ELSE 'failed: text too small' END AS outcome,
       CAST(length({sql_clean('main')}) AS INTEGER) AS text_len
FROM main
WHERE {_GATE}
QUALIFY row_number() OVER (PARTITION BY {sql_doc_id('url')} ORDER BY page_id % 4 DESC, page_id DESC) = 1
"""))
def q_stream_content(spark, base):
    """M2 (+M7): landed pages as a stream through the content pass (gates,
    extraction, size outcome), each batch upserted into the store by feed: the
    page of the last arrival stays, and reads are plain scans."""
    pages = _stream(spark, base, "pages", "page_id").select("page_id", F.col("url").alias("link"), "html", "arrival")
    gated = pages.filter(U.is_valid_url("link") & U.not_excluded_uri("link") & U.not_excluded_type("link"))
    docs = X.extract_docs(gated).select(
        "id", F.regexp_extract("link", r"^https?://[^/]+/([a-z]{2})/", 1).alias("origin"), "text", F.struct("arrival", "page_id").alias("o"),
        F.when(F.length("text") > T.NEWS_MIN_TEXT_SIZE, F.lit("successful"))
        .otherwise(F.lit("failed: text too small")).alias("outcome"))
    ck = S.checkpoint_path(spark, "content")
    store = Store(spark, ck + "/store")
    S.run_into_store(docs, store, "content", ck + "/ckpt", output_mode="append")
    return store.read().select("id", "outcome", F.length("text").alias("text_len"))


@register("stream_feeds", with_fixtures("""
SELECT id, link, title, array_to_string(tags, ',') AS tags, origin,
       strftime(updated, '%Y-%m-%dT%H:%M:%SZ') AS updated
FROM docs
""", "docs"))
def q_stream_feeds(spark, base):
    """M1 (+A1, A2, M7): the docs landed as RSS files (Spark's XML writer),
    collected by a file stream with bounded batches and normalised."""
    from newslake.functions import dates as D
    docs = FX.docs(spark, base)
    items = docs.select(
        "title", "link", F.col("lang").alias("description"), "author",
        F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss").alias("pubDate"), F.col("tags").alias("category"),
        F.struct(F.concat(F.lit("https://"), F.col("origin"), F.lit(".example.com/feed")).alias("_url"),
                 F.col("origin").alias("_VALUE")).alias("source"))
    ck = S.checkpoint_path(spark, "feeds")
    items.repartition(4).write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(ck + "/landed")
    stream = S.feed_stream(spark, ck + "/landed", F.col("source._VALUE"), "item", max_files=1,
                           now=F.lit(None).cast("timestamp_ntz"))
    S.run_available(stream.withColumn("o", F.struct(F.lit(0))), ck + "/out", ck + "/ckpt", output_mode="append")
    out = S.read_batches(spark, ck + "/out")
    return out.select("id", "link", "title", F.array_join("tags", ",").alias("tags"), "origin",
                      D.to_iso_z("updated").alias("updated"))


@register("stream_predict", with_fixtures(f"""
target AS (SELECT doc_id AS id, NULL::VARCHAR AS title, NULL::VARCHAR AS summary, text FROM documents),
{sql_fixed_scores('target')}
SELECT id AS doc_id, {SQL_LABELS}, {SQL_SCORES} FROM fixed_scores
"""))
def q_stream_predict(spark, base):
    """M3: a stored topic model applied to a document stream."""
    docs = _stream(spark, base, "documents", "doc_id").select(
        "doc_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("summary"), "text")
    pred = S.predict_stream(docs, fixed_models(spark)).select("doc_id", *score_columns())
    ck = S.checkpoint_path(spark, "predict")
    S.run_available(pred, ck + "/out", ck + "/ckpt", output_mode="append")
    return S.read_batches(spark, ck + "/out").drop("batch_id")
