"""Broadcast only what has a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newslake.operators.partitioning import plan_nodes

# Registries (topics, models, voters of one request...) above these bounds
# are joined by shuffle instead of broadcast.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def plan_size_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (exact for local data, file sizes for
    scans; None when it cannot be read)."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(size if isinstance(size, int) else size.toString())
    except Exception:  # noqa: BLE001
        return None


def is_bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when ``df`` is known to be small: by the planner's size estimate
    (no job), else by counting at most ``max_rows + 1`` rows. The estimate does
    not know how many rows an ``explode`` makes of one; those are counted."""
    size = plan_size_bytes(df)
    if size is not None and size <= max_bytes and not {"Generate", "Expand"} & (plan_nodes(df) or {"Generate"}):
        return True
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                      max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if it is checked to be small (see ``is_bounded``),
    else return it unchanged so the planner shuffles (AQE may still pick a
    broadcast from runtime sizes, which is also a checked bound)."""
    return F.broadcast(df) if is_bounded(df, max_rows, max_bytes) else df
