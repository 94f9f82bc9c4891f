"""Structured Streaming versions of collection, content, prediction, dedup
and votes (M1-M8).

Conventions
-----------
* Sources are file streams with explicit schemas; ``maxFilesPerTrigger``
  bounds a micro-batch (M7, the reference flushed every 1000 items).
* Sinks are ``foreachBatch`` writers that are idempotent per ``batch_id``
  (each batch overwrites its own folder), so a retried batch after an
  executor loss writes the same files again; the checkpoint (under the
  cluster's ``spark.checkpoint.dir``) records progress (M6).
* Last-writer-wins is by arrival (batch id, then the row's own sequence),
  not by the ``updated`` field: the reference has no event-time semantics
  (M8). Watermarks are on the time of arrival and only bound state.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from newslake.operators import windows
from newslake.session import ensure_checkpoint_dir
from newslake.sources import feeds as FD

MAX_FILES_PER_TRIGGER = 1000


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A fresh checkpoint folder under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files: int = MAX_FILES_PER_TRIGGER, **options) -> DataFrame:
    """M1 / M7: a landed-file stream with a schema and bounded batches."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def feed_stream(spark: SparkSession, path: str, origin, row_tag: str = "item",
                max_files: int = MAX_FILES_PER_TRIGGER, now=None) -> DataFrame:
    """M1: landed RSS/Atom files as a stream of normalised docs (A1, A2).
    ``origin`` is a source id or a Column of the entry."""
    schema = FD.RSS_ITEM_SCHEMA if row_tag == "item" else FD.ATOM_ENTRY_SCHEMA
    raw = file_stream(spark, path, schema, "xml", max_files, rowTag=row_tag, ignoreSurroundingSpaces="false")
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    return FD.normalize_entries(raw, origin, now, row_tag)


def dedup_first_seen(stream: DataFrame, key: str = "id", ts: str = "updated",
                     delay: str = "1 day") -> DataFrame:
    """M4 (drop repeats): the first arrival of every id is kept; state for an
    id is dropped once the watermark passes it."""
    # Watermarks need TIMESTAMP (with zone); NTZ event times are cast.
    if dict(stream.dtypes).get(ts) == "timestamp_ntz":
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def latest_per_key_stream(stream: DataFrame, keys: list[str], order_cols: list[str], value_cols: list[str],
                          arrival: str | None = None, every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """M4 / M5 (last writer wins): a stateful aggregation keeping, per key,
    the values of the row with the highest order; emitted in update mode.

    With ``arrival`` (a timestamp set when the row lands, so it never runs behind)
    the state is kept by key and period of arrival and dropped ``delay`` after the
    period: it holds the keys of the last periods, not all that were ever seen.
    A key that comes again later is emitted again; a sink that keeps the highest
    order (``store_sink``) has the same rows either way."""
    order = F.struct(*order_cols)
    vals = F.struct(*value_cols)
    by = [F.col(k) for k in keys]
    if arrival:
        stream = stream.withColumn("__arrival", F.col(arrival).cast("timestamp")).withWatermark("__arrival", delay)
        by.append(F.window("__arrival", every).alias("__period"))
    return stream.groupBy(*by).agg(F.max_by(vals, order).alias("v"), F.max(order).alias("o")).select(
        *keys, "v.*", "o")


def resume_points(stream: DataFrame, key: str, id_col: str, arrival: str | None = None, every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """M6: the per-source high-water mark as streaming state (with ``arrival`` of
    the last periods only, see ``latest_per_key_stream``)."""
    seen = stream.withColumn("since_id", F.col(id_col).try_cast("bigint"))
    return latest_per_key_stream(seen, [key], ["since_id"], ["since_id"], arrival, every, delay)


def store_sink(store, name: str, order: str = "o"):
    """M2, M5, M6: foreachBatch sink into a stored table: of each key the row with the highest
    order, stored or new. Only the folders that a batch names are rewritten, reads
    need no window over the batches, and a batch that is retried after its version
    was recorded changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, order, stream=name, batch_id=batch_id, contest=True)
    return write


def run_into_store(stream: DataFrame, store, name: str, checkpoint: str, output_mode: str = "update", order: str = "o") -> StreamingQuery:
    """Process everything available now into ``store``, then stop."""
    q = (stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
         .foreachBatch(store_sink(store, name, order)).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def batch_writer(path: str, fmt: str = "parquet", partition_by: list[str] | None = None):
    """foreachBatch sink: each batch overwrites ``path/batch_id=N`` (idempotent
    on retry); readers take the union (or the latest per key)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        w = batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").format(fmt)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(os.path.join(path, f"batch_id={batch_id}"))
    return write


def run_available(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "update",
                  partition_by: list[str] | None = None) -> StreamingQuery:
    """Process everything available now (``availableNow``), then stop."""
    q = (stream.writeStream.outputMode(output_mode)
         .option("checkpointLocation", checkpoint)
         .foreachBatch(batch_writer(path, partition_by=partition_by))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_across_batches(df: DataFrame, keys: list[str]) -> DataFrame:
    """The store view of an update-mode sink: per key, the row of the last
    batch (then the highest order inside it). M8: arrival order wins,
    whatever the row's ``updated`` says."""
    return windows.first_per(df, keys, [F.col("batch_id").desc(), F.col("o").desc()]).drop("batch_id", "o")


def predict_stream(stream: DataFrame, fitted: dict) -> DataFrame:
    """M3: classifier scoring on a stream (narrow transform per batch)."""
    from newslake.operators.topics import predict_topics
    return predict_topics(stream, fitted)
