"""Writes and sinks.

The store is a table of docs keyed by ``id``; a write produces the new
version of the table (a DataFrame) and, when asked, persists it. Upserts are
last-writer-wins by an ingest sequence, computed with a window over the id
(rows of one id are few, so no group is large even when a source is hot).
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from newslake.functions import dates
from newslake.operators import windows

OUTCOMES = ("successful", "failed", "error")


def upsert(base: DataFrame, batch: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """B1 / B2 / H3: full replace per id; the highest ``seq`` wins (the batch
    must carry a higher sequence than the base)."""
    merged = base.unionByName(batch, allowMissingColumns=True)
    return windows.latest_per_key(merged, key, seq)


def merge_fields(base: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Partial update -- non-null patch fields overwrite, others stay."""
    fields = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"__p_{c}") for c in fields])
    out = base.join(p, key, "left")
    for c in fields:
        if c in base.columns:
            out = out.withColumn(c, F.coalesce(F.col(f"__p_{c}"), F.col(c)))
        else:
            out = out.withColumn(c, F.col(f"__p_{c}"))
    return out.drop(*[f"__p_{c}" for c in fields])


def delete(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Remove the given ids (anti join; AQE broadcasts a small id list)."""
    return base.join(ids.select(key), key, "left_anti")


def clear_predictions(docs: DataFrame, cond: Column | None = None, field: str = "topics") -> DataFrame:
    """Drop ``topics`` where ``cond`` holds (all docs by default)."""
    if cond is None:
        return docs.withColumn(field, F.lit(None).cast(docs.schema[field].dataType))
    return docs.withColumn(field, F.when(F.coalesce(cond, F.lit(False)), F.lit(None)).otherwise(F.col(field)))


def export_csv(rows: DataFrame, path: str) -> None:
    """``|``-delimited, back-quote quoted, with a header."""
    (rows.write.mode("overwrite").option("sep", "|").option("quote", "`").option("header", True)
     .option("emptyValue", "").csv(path))


def atom_entries(df: DataFrame) -> DataFrame:
    """B7 rows: title, summary, content, categories, author, url, updated,
    published, rights (the shape of a feed entry)."""
    from newslake.functions import text as T, urls as U
    return df.select(
        T.title_or("title", "summary").alias("title"),
        T.summary_or("summary").alias("summary"),
        T.content_or("summary").alias("content"),
        F.transform(T.categories("topics", "tags"), lambda c: F.struct(c["term"].alias("_term"),
                                                                   c["label"].alias("_label"))).alias("category"),
        F.struct(T.author_or("author").alias("name")).alias("author"),
        U.unquote("link").alias("id"),
        dates.to_iso_z("updated").alias("updated"),
        dates.to_iso_z("updated").alias("published"),
        T.rights_text("topics").alias("rights"),
    )


def export_atom(df: DataFrame, path: str) -> None:
    """Atom-like XML, one ``<entry>`` per row (Spark's XML source)."""
    (atom_entries(df).write.mode("overwrite").format("xml")
     .option("rootTag", "feed").option("rowTag", "entry").save(path))


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def with_outcome(df: DataFrame, ok: Column, error: Column | None = None,
                 reason: Column | None = None) -> DataFrame:
    """Per-row ``outcome`` = successful / failed[: reason] / error."""
    out = F.when(ok, F.lit("successful"))
    if error is not None:
        out = out.when(error, F.lit("error"))
    fail = F.lit("failed") if reason is None else F.concat(F.lit("failed: "), reason)
    return df.withColumn("outcome", out.otherwise(fail))


def run_metrics(df: DataFrame, call: str, started: float | None = None) -> DataFrame:
    """Run counters (total, count, successful, failed, errors, duration)
    from a table with an ``outcome`` column -- one aggregate job."""
    started = time.time() if started is None else started
    kind = F.split("outcome", ":").getItem(0)
    agg = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(kind == "successful").alias("successful"),
        F.count_if(kind == "failed").alias("failed"),
        F.count_if(kind == "error").alias("errors"),
    )
    return agg.select(F.lit(call).alias("call"), "total", F.col("total").alias("count"),
                      "successful", "failed", "errors",
                      F.round(F.unix_micros(F.current_timestamp()) / 1e6 - F.lit(started), 3).alias("duration"))
