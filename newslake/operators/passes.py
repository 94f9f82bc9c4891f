"""The scheduled passes over the store as whole jobs (L7-L9): landed pages and
entries in, extraction, language, prediction, and the upsert of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newslake.functions import text as T, urls as U
from newslake.operators import joins as J, text as X, topics as TP, windows
from newslake.operators.store import Store

#: What a pass writes besides the fields of the content.
RESULT = ["outcome"]


def fetched(pages: DataFrame, rules: dict[str, str] | None, min_size: int, language) -> DataFrame:
    """Landed pages that may be read (C11-C13), refreshes followed (I16), as content
    (J5) by doc id; of several pages of one id the last landed."""
    gated = pages.filter(U.is_valid_url("link") & U.not_excluded_uri("link") & U.not_excluded_type("link"))
    # The id is that of the page asked for, whatever it refreshes to.
    asked = X.follow_refresh(gated.withColumn("__id", U.doc_id("link")))
    content = X.extract_docs(asked, rules, min_size, language=language).drop("id").withColumnRenamed("__id", "id")
    return windows.latest_per_key(content, "id", "page_id") if "page_id" in content.columns else content.dropDuplicates(["id"])


def content_rows(docs: DataFrame, pages: DataFrame, rules: dict[str, str] | None = None, min_size: int = T.NEWS_MIN_TEXT_SIZE,
                 language=None, models: dict | None = None) -> DataFrame:
    """Docs without text with the content of their landed page (D7), the
    outcome of the size gate (C14) and, with ``models``, their topics (J9)."""
    content = fetched(pages, rules, min_size, language).select("id", "text", "title", "summary", F.col("html_b64").alias("html"), "lang", "content_type", "tags")
    out = J.apply_content(docs.filter(F.col("text").isNull()), content, min_size)
    return predicted(out, models) if models else out


def predicted(docs: DataFrame, models: dict) -> DataFrame:
    """J9 for docs with text; others keep their topics."""
    has = F.col("text").isNotNull()
    old = F.col("topics") if "topics" in docs.columns else F.lit(None).cast("array<struct<label:string,score:double>>")
    out = TP.predict_topics(docs.withColumn("__old", old), models)
    return out.withColumn("topics", F.when(has, F.col("topics")).otherwise(F.col("__old"))).drop("__old")


def content_pass(store: Store, pages: DataFrame, parts: list[str] | None = None, **how) -> DataFrame:
    """L7 on the store: fills the docs without text (of ``parts``, else of all
    sources) from the landed pages, predicts, and upserts what changed (see
    ``content_rows``). Returns the stored rows of what was asked for."""
    done = content_rows(store.read(parts), pages, **how)
    store.upsert(done.filter(F.col("outcome") != "unchanged"))
    return store.read(parts)


def prediction_pass(store: Store, models: dict, parts: list[str] | None = None) -> DataFrame:
    """L8 on the store: topics of every doc with text."""
    store.upsert(predicted(store.read(parts).filter(F.col("text").isNotNull()), models))
    return store.read(parts)


def source_refresh(store: Store, source: str, entries: DataFrame, pages: DataFrame, **how) -> DataFrame:
    """One source collected -- of its landed entries those that are not stored
    with a text yet (D8) -- and its children's content pass. Only this source's
    folder is read and written. Returns its docs."""
    stored = store.read([source], columns=entries.withColumn("text", F.lit(None).cast("string")))
    new = J.not_yet_collected(entries.filter(F.col(store.part) == source), stored, store.key)
    fresh = new.join(stored, store.key, "left_anti")
    store.upsert(fresh.withColumn("text", F.lit(None).cast("string")) if "text" not in fresh.columns else fresh)
    return content_pass(store, pages, [source], **how)
