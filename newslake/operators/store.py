"""The stored doc table (B1, B4): folders by source, and a version marker.

A write puts new files for the sources it names next to the old ones and then
records, in a small table of folders (the version), which folder each source
has now. Readers open the folders of the last version only: a write that fails
before its version is recorded changes nothing, files of other sources are not
read, rewritten or moved. One writer at a time; a second one is told.

    path/data/<write>/part=<source>/...   rows, sorted by key
    path/versions/version=<n>/...         (part, folder) and the state of streams
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from newslake.operators import windows

NO_SOURCE = "__none__"


class Conflict(RuntimeError):
    """Another write recorded a version first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, part: str = "origin", key: str = "id"):
        self.spark, self.path, self.part, self.key = spark, path, part, key

    # -- versions -----------------------------------------------------------
    def _marker(self) -> tuple[int, dict[str, str], dict, StructType] | None:
        """(version, folder of each source, last batch of each stream, schema):
        one row for each source and one for the rest, read to the driver like
        any list of partitions."""
        try:
            rows = self.spark.read.parquet(os.path.join(self.path, "versions"))
            last = rows.agg(F.max("version")).first()[0]
        except Exception as e:  # noqa: BLE001 - no such folder: nothing stored yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        if last is None:
            return None
        found = rows.filter(F.col("version") == last).collect()
        head = next(r for r in found if r["part"] is None)
        state = json.loads(head["folder"])
        return last, {r["part"]: r["folder"] for r in found if r["part"] is not None}, state["streams"], StructType.fromJson(state["schema"])

    def version(self) -> int:
        """The last recorded version, 0 if there is none."""
        found = self._marker()
        return found[0] if found else 0

    def folders(self) -> dict[str, str]:
        """Source -> folder of the last version."""
        found = self._marker()
        return found[1] if found else {}

    def _record(self, base: int, folders: dict[str, str], streams: dict, schema: StructType) -> None:
        if self.version() != base:
            raise Conflict(f"version {base} is no longer the last one")
        rows = [(None, json.dumps({"streams": streams, "schema": schema.jsonValue()})), *folders.items()]
        # One file: it appears as a whole or not at all.
        (self.spark.createDataFrame(rows, "part string, folder string").coalesce(1).write.mode("overwrite")
         .parquet(os.path.join(self.path, "versions", f"version={base + 1}")))

    # -- reading ------------------------------------------------------------
    def read(self, parts: list[str] | None = None, columns: DataFrame | None = None) -> DataFrame:
        """The stored rows, of all sources or of ``parts`` (no other folder is
        opened). An empty store has the columns of ``columns``."""
        found = self._marker()
        if found is None:
            if columns is None:
                raise ValueError(f"nothing stored under {self.path}")
            return columns.limit(0)
        _, folders, _, schema = found
        use = [f for p, f in sorted(folders.items()) if parts is None or p in parts]
        if not use:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*use)

    # -- writing ------------------------------------------------------------
    def _part(self) -> Column:
        return F.coalesce(F.col(self.part).cast("string"), F.lit(NO_SOURCE))

    def _write(self, df: DataFrame) -> dict[str, str]:
        """New files for the rows of ``df``, and the folder of each source. A
        large source is dealt over several tasks by a hash of the key."""
        folder = os.path.join(self.path, "data", uuid.uuid4().hex)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        part = "__part"
        rows = df.withColumn(part, self._part())
        (rows.repartition(n, F.col(part), F.pmod(F.xxhash64(self.key), F.lit(max(1, n // 4)))).sortWithinPartitions(part, self.key)
         .write.partitionBy(part).parquet(folder))
        written = self.spark.read.schema(df.schema).parquet(folder).select(F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]+$", 1).alias("folder"), self._part().alias("part"))
        return {r["part"]: unquote(r["folder"]) for r in written.distinct().collect()}  # a row for each source

    def create(self, df: DataFrame) -> None:
        """Replaces everything by the rows of ``df``."""
        found = self._marker()
        self._record(found[0] if found else 0, self._write(df), {}, df.schema)

    def upsert(self, batch: DataFrame, order: str | Column | None = None, stream: str | None = None, batch_id: int | None = None, contest: bool = False) -> bool:
        """B1: the rows of ``batch`` replace stored ones with the same source and
        key; ``order`` picks the last of several in the batch, and with ``contest``
        also between them and the stored one. Only folders of
        sources that the batch names are rewritten: their other rows by an anti
        join on the key. A batch of a ``stream`` that is recorded already changes
        nothing; returns whether anything was written. Columns that the store
        lacks are added, those that the batch lacks are null."""
        found = self._marker()
        version, folders, streams, schema = found if found else (0, {}, {}, None)
        if stream is not None and streams.get(stream, -1) >= batch_id:
            return False
        staged_at = os.path.join(self.path, "staged", uuid.uuid4().hex)
        # Written once: it is read for its sources, its keys and its rows.
        (batch if order is None else windows.latest_per_key(batch, [self.part, self.key], order)).write.parquet(staged_at)
        staged = self.spark.read.schema(batch.schema).parquet(staged_at)
        parts = [r["part"] for r in staged.select(self._part().alias("part")).distinct().collect()]  # at most one row for each source
        streams = streams if stream is None else streams | {stream: batch_id}
        if not parts:
            if stream is not None:
                self._record(version, folders, streams, schema or batch.schema)
            return False
        rows = staged
        if found:
            touched = self.read(parts)
            same = [touched[self.key] == staged[self.key], touched[self.part].eqNullSafe(staged[self.part])]
            rows = touched.join(staged, same, "left_anti").unionByName(staged, allowMissingColumns=True)
            if contest:
                last = windows.latest_per_key(touched.join(staged, same, "left_semi").unionByName(staged, allowMissingColumns=True), [self.part, self.key], order)
                rows = touched.join(staged, same, "left_anti").unionByName(last, allowMissingColumns=True)
        self._record(version, folders | self._write(rows), streams, rows.schema)
        return True

    def delete(self, keys: DataFrame) -> None:
        """The rows of ``keys`` (source and key) go; other sources' files stay."""
        found = self._marker()
        if found is None:
            return
        version, folders, streams, schema = found
        parts = [r["part"] for r in keys.select(self._part().alias("part")).distinct().collect()]
        touched = self.read(parts)
        same = [touched[self.key] == keys[self.key], touched[self.part].eqNullSafe(keys[self.part])]
        left = self._write(touched.join(keys, same, "left_anti"))
        self._record(version, {p: f for p, f in folders.items() if p not in parts} | left, streams, schema)
