"""Input parallelism for per-row heavy work (regex, tokenising).

A scan yields one task per file split; a small corpus kept in one file (or
one row group) would run its whole tokenisation in one task. When the input
has fewer partitions than the cluster has cores, it is spread round-robin
first. On a large input (many splits) this is a no-op, so no extra shuffle of
the corpus happens at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


# Plan nodes that already give the data a shuffle-sized parallelism (or would
# make ``rdd`` execute stages eagerly under AQE): spreading is skipped.
_SHUFFLING = ("Repartition", "Aggregate", "Join", "Window", "Sort", "Subquery", "Generate", "Expand",
              "Union", "Distinct", "Deduplicate")


def plan_nodes(df: DataFrame) -> set[str] | None:
    """The names of the nodes of the optimised plan, and ``Subquery`` if an
    expression holds one; None where the plan can't be read."""
    try:
        root = df._jdf.queryExecution().optimizedPlan()
        names, stack = set(), [root]
        while stack:
            node = stack.pop()
            names.add(node.nodeName())
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
        return names | ({"Subquery"} if root.subqueriesAll().size() else set())
    except Exception:  # noqa: BLE001 - not a classic DataFrame
        return None


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over ``min_partitions`` (default: the default
    parallelism) when it is a plain scan with fewer splits; otherwise return
    it as is.

    Only scan-only plans are inspected: for them ``rdd.getNumPartitions()``
    lists file splits without running anything. Plans with an exchange or a
    subquery are returned untouched (their parallelism comes from the
    shuffle, and inspecting them would execute stages)."""
    if df.isStreaming:
        return df
    nodes = plan_nodes(df)
    if nodes is None or any(n.startswith(_SHUFFLING) for n in nodes):
        return df
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001
        return df
    return df.repartition(target) if n < target else df
