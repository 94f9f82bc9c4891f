"""Sources: feeds, tweets, chat messages, landed files and registries
(A1-A12).

Readers take landed data (files or text columns) with explicit schemas --
nothing is inferred on a large input.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from newslake.functions import dates, text as TX, urls as U
from newslake.functions._util import EMPTY_STRINGS
from newslake.operators.aggregates import max_id_per_source
from newslake.operators.broadcast import bounded_broadcast
from newslake.operators import windows
from newslake.operators.predicates import of_type

# Chat-created sources and docs.
CHAT_SOURCE_DEFAULTS = {"limit": 200, "step": 1000, "freq": 30, "depth": 2}
CHAT_CHANNEL_LINK = "telegram"

RSS_ITEM_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("category", T.ArrayType(T.StringType())),
    T.StructField("source", T.StructType([T.StructField("_url", T.StringType()),
                                          T.StructField("_VALUE", T.StringType())])),
])
ATOM_ENTRY_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StructType([T.StructField("_href", T.StringType())])),
    T.StructField("summary", T.StringType()),
    T.StructField("author", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("updated", T.StringType()),
    T.StructField("category", T.ArrayType(T.StructType([T.StructField("_term", T.StringType())]))),
    T.StructField("source", T.StructType([
        T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("link", T.StructType([T.StructField("_href", T.StringType())]))])),
])
TWEET_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("id_str", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("retweet_count", T.IntegerType()),
    T.StructField("lang", T.StringType()),
    T.StructField("user", T.StructType([T.StructField("screen_name", T.StringType())])),
    T.StructField("entities", T.StructType([
        T.StructField("hashtags", T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))),
        T.StructField("urls", T.ArrayType(T.StructType([T.StructField("expanded_url", T.StringType())]))),
    ])),
])


# ---------------------------------------------------------------------------
# A1 / A2 feeds
# ---------------------------------------------------------------------------
def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """A1: RSS (``item``) or Atom (``entry``) files with an explicit schema."""
    schema = RSS_ITEM_SCHEMA if row_tag == "item" else ATOM_ENTRY_SCHEMA
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def normalize_entries(items: DataFrame, origin, now, row_tag: str = "item") -> DataFrame:
    """A2: feed entries -> docs. tags = category terms; ``updated`` defaults
    to now; source = the entry's source link or ``""``; format and
    source_type ``rss``; id from the link (I1)."""
    o = origin if isinstance(origin, Column) else F.lit(origin)
    if row_tag == "item":
        link, summary, author = F.col("link"), F.col("description"), F.col("author")
        tags = F.coalesce(F.col("category"), F.array().cast(EMPTY_STRINGS))
        updated = F.coalesce(dates.from_rfc822(F.col("pubDate")), dates.parse_updated(F.col("pubDate")))
        source = F.coalesce(F.col("source._url"), F.lit(""))
    else:
        link, summary, author = F.col("link._href"), F.col("summary"), F.col("author.name")
        tags = F.coalesce(F.transform("category", lambda c: c["_term"]), F.array().cast(EMPTY_STRINGS))
        updated = F.coalesce(dates.parse_updated(F.col("updated")), dates.from_rfc822(F.col("updated")))
        source = F.coalesce(F.col("source.link._href"), F.lit(""))
    return items.select(
        U.doc_id(link).alias("id"), o.alias("origin"), link.alias("link"),
        F.col("title"), summary.alias("summary"), author.alias("author"),
        F.coalesce(updated.cast("timestamp_ntz"), now).alias("updated"),
        tags.alias("tags"), source.alias("source"),
        F.lit("rss").alias("format"), F.lit("rss").alias("source_type"))


def require_entries(items: DataFrame) -> DataFrame:
    """A1: a feed with no entries is an error (checked with one ``limit(1)``)."""
    if not items.limit(1).count():
        raise ValueError("feed has no entries")
    return items


# ---------------------------------------------------------------------------
# A3 paged reads, A5 watermark, A6 capped recent
# ---------------------------------------------------------------------------
def take_until_empty_page(pages: DataFrame, source: str = "source", offset: str = "offset",
                          n_entries: str = "n_entries") -> DataFrame:
    """A3: per source keep the pages before the first one with no entries. Only
    sources with such a page are joined, by broadcast where their number is
    checked, so the pages of a hot source stay where they are."""
    first_empty = pages.filter(F.col(n_entries) == 0).groupBy(source).agg(F.min(offset).alias("__first_empty"))
    return (pages.join(bounded_broadcast(first_empty), source, "left")
            .filter(F.col("__first_empty").isNull() | (F.col(offset) < F.col("__first_empty")))
            .drop("__first_empty"))


def newer_than_watermark(new: DataFrame, stored: DataFrame, key: str = "origin", id_col: str = "status_id") -> DataFrame:
    """Only items with an id above the highest stored id of their
    source (numeric comparison)."""
    # One row per source: broadcast where its size is checked.
    marks = bounded_broadcast(max_id_per_source(stored, key, id_col).withColumnRenamed("max_id", "__since"))
    return (new.join(marks, key, "left")
            .filter(F.col("__since").isNull() | (F.col(id_col).try_cast("bigint") > F.col("__since")))
            .drop("__since"))


def recent_per_source(df: DataFrame, limit: int, lang: str | None = "en", key: str = "origin",
                      id_col: str = "status_id") -> DataFrame:
    """Language filter, then the ``limit`` most recent (highest id) per
    source (a WindowGroupLimit: bounded per task before the shuffle)."""
    d = df if lang is None else df.filter(F.col("lang") == lang)
    return windows.top_k_per(d, [key], [F.col(id_col).try_cast("bigint").desc()], limit)


# ---------------------------------------------------------------------------
# A4 tweets
# ---------------------------------------------------------------------------
def tweets_to_docs(tweets: DataFrame, origin) -> DataFrame:
    """A4: statuses -> docs. link = last expanded URL else the status URL;
    related_links = every expanded URL; summary without URLs; tags =
    hashtags (I5); occurences = retweets; language kept."""
    o = origin if isinstance(origin, Column) else F.lit(origin)
    status_url = F.concat(F.lit("https://twitter.com/"), F.col("user.screen_name"), F.lit("/status/"),
                          F.coalesce(F.col("id_str"), F.col("id").cast("string")))
    urls = F.coalesce(F.transform("entities.urls", lambda u: u["expanded_url"]), F.array().cast(EMPTY_STRINGS))
    link = F.coalesce(F.try_element_at(urls, F.lit(-1)), status_url)
    return tweets.select(
        U.doc_id(link).alias("id"), o.alias("origin"), link.alias("link"),
        F.col("user.screen_name").alias("author"),
        F.coalesce(F.col("id_str"), F.col("id").cast("string")).alias("status_id"),
        status_url.alias("source"),
        F.trim(TX.strip_urls(F.col("text"))).alias("summary"),
        TX.hashtags(F.coalesce(F.col("entities.hashtags"),
                               F.array().cast("array<struct<text:string>>"))).alias("tags"),
        F.col("lang"), F.coalesce(F.col("retweet_count"), F.lit(0)).alias("occurences"),
        urls.alias("related_links"),
        F.lit("twitter").alias("format"), F.lit("twitter").alias("source_type"))


# ---------------------------------------------------------------------------
# A7 dispatch
# ---------------------------------------------------------------------------
def ingest_all(parts: dict[str, DataFrame]) -> DataFrame:
    """One reader output per format, unioned by column name."""
    frames = [df.withColumn("format", F.lit(fmt)) if "format" not in df.columns else df
              for fmt, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------------------
# A8 landed documents
# ---------------------------------------------------------------------------
# How response bodies begin.
PDF_MAGIC, ZIP_MAGIC = b"%PDF", b"PK\x03\x04"


def response_type(body: Column, text: Column, link: Column, header: Column | None = None) -> Column:
    """The type of a response by its first bytes, then its header, then the
    ending of its link."""
    head = F.ltrim(F.lower(F.substring(text, 1, 512)))
    named = F.lower(F.coalesce(header, F.lit(""))) if header is not None else F.lit("")
    ends = lambda e: F.lower(F.regexp_replace(link, "[?#].*$", "")).endswith(e)
    return (F.when(F.substring(body, 1, 4) == F.lit(bytearray(PDF_MAGIC)), F.lit("application/pdf"))
            .when(F.substring(body, 1, 4) == F.lit(bytearray(ZIP_MAGIC)), F.lit("application/zip"))
            .when(head.contains("<html") | head.contains("<!doctype html"), F.lit("text/html"))
            .when(F.try_parse_json(text).isNotNull() & head.rlike(r"^[{\[]"), F.lit("application/json"))
            .when(named.contains("html"), F.lit("text/html"))
            .when(named.contains("csv") | ends(".csv"), F.lit("text/csv"))
            .otherwise(F.lit("text/plain")))


def json_text(text: Column) -> Column:
    """The string values of a JSON text, a line each (keys are left out)."""
    values = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]|\\.)*")(?!\s*:)(?=\s*[,}\]]|\s*$)'), 1)
    return F.array_join(F.transform(values, lambda v: F.get(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), 0)), "\n")


def csv_text(text: Column) -> Column:
    """The cells of a CSV text: fields joined by a blank, without quotes."""
    cells = F.regexp_replace(text, r'"((?:[^"]|"")*)"', "$1")
    return F.replace(F.regexp_replace(F.replace(cells, F.lit('""'), F.lit('"')), r"[,;\t]", " "), F.lit("\r\n"), F.lit("\n"))


def pdf_text():
    """A function from PDF bytes to the text that their content streams show (plain
    or deflated streams with literal strings; others give an empty text)."""
    @F.pandas_udf(T.StringType())
    def show(bodies: pd.Series) -> pd.Series:
        import re
        import zlib
        stream = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
        shown = re.compile(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ|(T\*|\b(?:Td|TD|ET)\b)", re.S)
        piece, escape = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S), re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3})")
        signs = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}

        def plain(s):
            return escape.sub(lambda m: signs.get(m[1], m[1]) if not m[1][:1].isdigit() else bytes([int(m[1], 8) & 255]), s)
        out = []
        for body in bodies:
            lines = [b""]
            for m in stream.finditer(body or b""):
                data = m[1]
                try:
                    data = zlib.decompress(data)
                except zlib.error:
                    pass
                for x in shown.finditer(data):
                    if x[3]:
                        lines.append(b"")
                    else:
                        lines[-1] += plain(x[1]) if x[1] is not None else b"".join(plain(p) for p in piece.findall(x[2]))
            text = b"\n".join(x for x in lines if x)
            out.append(text.decode("utf-8") if _utf8(text) else text.decode("latin-1"))
        return pd.Series(out, dtype=object)

    def _utf8(b):
        try:
            b.decode("utf-8")
            return True
        except UnicodeDecodeError:
            return False
    return show


def response_texts(responses: DataFrame, link: str = "link", body: str = "body", header: str | None = None) -> DataFrame:
    """Landed responses, many in a file (records of a link, the bytes and the
    header's type), with ``content_type``, cleaned ``text`` (I17) and ``outcome``. HTML gives
    its visible text, JSON its string values, CSV its cells, PDF what it shows;
    archives are refused, an empty text is an error. Invalid UTF-8 is replaced."""
    from newslake.operators.partitioning import spread
    raw = spread(responses).withColumn("__text", F.make_valid_utf8(F.col(body).cast("string")))
    kind = response_type(F.col(body), F.col("__text"), F.col(link), F.col(header) if header else None)
    typed = raw.withColumn("content_type" if "content_type" not in responses.columns else "found_type", kind)
    name = "content_type" if "content_type" not in responses.columns else "found_type"
    # Only PDF bytes go to Python.
    shown = pdf_text()(F.when(F.col(name) == "application/pdf", F.col(body)))
    t = F.col("__text")
    text = (F.when(F.col(name) == "text/html", TX.visible_text(t)).when(F.col(name) == "application/json", json_text(t)).when(F.col(name) == "text/csv", csv_text(t))
            .when(F.col(name) == "application/pdf", shown).when(F.col(name) == "text/plain", t))
    out = typed.withColumn("text", TX.clean_extracted(text)).drop("__text")
    return out.withColumn("outcome", F.when(F.col(name) == "application/zip", F.lit("refused: archive"))
                          .when(F.length(F.trim("text")) > 0, F.lit("successful")).otherwise(F.lit("error: empty text")))


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A8 on a folder with a file for each response (see ``response_texts``)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return response_texts(raw.select(F.col("path").alias("link"), F.col("content").alias("body"), "length")).drop("body")


# ---------------------------------------------------------------------------
# A9 / A10 chat
# ---------------------------------------------------------------------------
def channel_origin(channel: str = CHAT_CHANNEL_LINK) -> Column:
    return U.doc_id(F.lit(channel))


def messages_to_docs(messages: DataFrame, now, channel: str = CHAT_CHANNEL_LINK) -> DataFrame:
    """A message carrying a URL (plain or ``/teach``) becomes a doc:
    origin = the channel id, summary = the text, tags = taught keywords,
    source = the sender's name, format/source_type ``telegram``."""
    cmd = TX.parse_command("text")
    url = F.coalesce(cmd["target"], F.nullif(F.regexp_extract("text", r"(https?://\S+)", 1), F.lit("")))
    is_doc = cmd["command"].isNull() | (cmd["command"] == "teach")
    d = messages.filter(is_doc & url.isNotNull())
    name = F.concat(F.col("first_name"), F.lit(" "), F.coalesce(F.col("last_name"), F.lit("")))
    return d.select(
        U.doc_id(url).alias("id"), channel_origin(channel).alias("origin"), url.alias("link"),
        F.col("text").alias("summary"),
        F.coalesce(cmd["keywords"], F.array().cast(EMPTY_STRINGS)).alias("tags"),
        name.alias("source"), now.alias("updated"),
        F.lit("telegram").alias("format"), F.lit("telegram").alias("source_type"),
        F.col("message_id"))


def messages_to_sources(messages: DataFrame) -> DataFrame:
    """A10: ``/follow @x``, ``/watch q`` (twitter) and ``/subscribe url``
    (rss) create sources with the chat defaults."""
    cmd = TX.parse_command("text")
    d = messages.select("*", cmd.alias("cmd")).filter(
        F.col("cmd.command").isin("follow", "watch", "subscribe") & F.col("cmd.valid"))
    stype = F.when(F.col("cmd.command") == "subscribe", F.lit("rss")).otherwise(F.lit("twitter"))
    creator = F.concat(F.coalesce(F.concat(F.col("first_name"), F.lit(" ")), F.lit("")),
                       F.coalesce(F.concat(F.col("last_name"), F.lit(" ")), F.lit("")),
                       F.coalesce(F.concat(F.col("from_id").cast("string"), F.lit(" ")), F.lit("")))
    return d.select(
        U.doc_id(F.col("cmd.target")).alias("id"),
        F.col("cmd.target").alias("link"),
        F.concat(F.lit("Telegram "), F.col("first_name"), F.lit(" "), stype, F.lit(" source to scrap.")).alias("title"),
        F.col("text").alias("summary"), stype.alias("format"),
        F.lit(CHAT_SOURCE_DEFAULTS["limit"]).alias("limit"), F.lit(CHAT_SOURCE_DEFAULTS["step"]).alias("step"),
        F.lit(CHAT_SOURCE_DEFAULTS["depth"]).alias("depth"), F.lit(CHAT_SOURCE_DEFAULTS["freq"]).alias("freq"),
        F.lit(True).alias("predict"), F.lit(True).alias("enable_content"), F.lit(True).alias("active"),
        creator.alias("creator"))


# ---------------------------------------------------------------------------
# A11 / A12 registries and point lookups
# ---------------------------------------------------------------------------
def load_registry(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Every object of one type from a registry table."""
    return of_type(spark.read.parquet(path), kind)


def get(df: DataFrame, ids, parent: str | None = None, key: str = "id") -> DataFrame:
    """Objects by id (a list, or a DataFrame of ids -> semi join),
    optionally routed by parent (prunes ``origin`` partitions)."""
    out = df if parent is None else df.filter(F.col("origin") == parent)
    if isinstance(ids, DataFrame):
        return out.join(ids.select(key), key, "left_semi")
    ids = [ids] if isinstance(ids, str) else list(ids)
    return out.filter(F.col(key).isin(ids))


def with_defaults(df: DataFrame, kind: str = "source") -> DataFrame:
    """The null_value defaults of the mapping (sources: active false,
    enable_content true, predict true; docs: occurences 1)."""
    if kind == "source":
        fills = {"active": False, "enable_content": True, "predict": True}
    else:
        fills = {"occurences": 1}
    for c, v in fills.items():
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return df
