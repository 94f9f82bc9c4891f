"""Top-k per group, representative rows, quotas, sorting and paging
(F1-F5, G1-G7).

Top-k uses ``row_number`` over a window with a ``<= k`` filter: Spark plans it
as a ``WindowGroupLimit`` below the shuffle, so each partition keeps only its
k best rows per key before the exchange (no full sort of a hot key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newslake.functions._util import as_col


# Up to this limit (``spark.sql.optimizer.windowGroupLimitThreshold``) Spark cuts
# groups below the shuffle by itself.
GROUP_LIMIT = 1000


def _orders(order) -> list[Column]:
    return [as_col(o) for o in (order if isinstance(order, (list, tuple)) else [order])]


def top_k_per(df: DataFrame, keys: list[str], order, k: int, rank_col: str | None = None) -> DataFrame:
    """the ``k`` first rows of every ``keys`` group by ``order``.

    With no keys this is a global top-k (``TakeOrderedAndProject``)."""
    order = _orders(order)
    if not keys:
        out = df.orderBy(*order).limit(k)
        if rank_col:
            out = out.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
        return out
    w = Window.partitionBy(*keys).orderBy(*order)
    rn = rank_col or "__rn"
    if k > GROUP_LIMIT:
        # Beyond Spark's own bound the rows of a group are first ranked among
        # those of one input partition, so a hot group is dealt over many tasks.
        part = Window.partitionBy(*keys, "__part").orderBy(*order)
        df = (df.withColumn("__part", F.spark_partition_id()).withColumn("__first", F.row_number().over(part))
              .filter(F.col("__first") <= k).drop("__part", "__first"))
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
    return out if rank_col else out.drop(rn)


def first_per(df: DataFrame, keys: list[str], order) -> DataFrame:
    """One row per group, the first by ``order``."""
    return top_k_per(df, keys, order, 1)


def latest_per_key(df: DataFrame, key: str | list[str], seq) -> DataFrame:
    """Last version per key (highest ``seq``; ties broken by the
    whole row order being irrelevant because seq is unique per key)."""
    keys = [key] if isinstance(key, str) else list(key)
    return first_per(df, keys, [as_col(seq).desc()])


def tag_quotas(inventory: DataFrame, limit_col: str = "limit", group: list[str] | None = None,
               tag_col: str = "tag", size_col: str = "n_docs", eligible_col: str = "n_eligible") -> DataFrame:
    """rolling quota carry-over along the tags of a topic, smallest first.

    base = int(limit / n_tags), first carry = limit - base * n_tags;
    quota_i = base + carry_i; taken_i = min(eligible_i, quota_i);
    carry_{i+1} = max(0, quota_i - taken_i).

    The fold is sequential, so it runs over the (small) sorted tag array of
    each topic with the higher-order ``aggregate`` -- never over documents.
    """
    group = group or ["model", "topic"]
    tags = F.array_sort(F.collect_list(F.struct(
        F.col(size_col).alias("n"), F.col(tag_col).alias("tag"),
        F.col(eligible_col).alias("eligible"))))
    per_group = inventory.groupBy(*group, limit_col).agg(tags.alias("tags"))
    n_tags = F.size("tags")
    base = F.floor(F.col(limit_col) / n_tags).cast("int")
    first_carry = F.col(limit_col) - base * n_tags
    zero = F.array().cast("array<struct<tag:string,n:bigint,eligible:bigint,quota:int,taken:bigint>>")
    init = F.struct(first_carry.cast("int").alias("carry"), zero.alias("out"))

    def step(acc, t):
        quota = base + acc["carry"]
        taken = F.least(t["eligible"], quota.cast("bigint"))
        row = F.struct(t["tag"].alias("tag"), t["n"].cast("bigint").alias("n"),
                       t["eligible"].cast("bigint").alias("eligible"),
                       quota.cast("int").alias("quota"), taken.alias("taken"))
        return F.struct(F.greatest(quota - taken, F.lit(0)).cast("int").alias("carry"),
                        F.concat(acc["out"], F.array(row)).alias("out"))

    folded = per_group.filter(n_tags > 0).select(
        *group, limit_col, F.posexplode(F.aggregate("tags", init, step)["out"]).alias("pos", "q"))
    return folded.select(*group, limit_col, (F.col("pos") + 1).alias("tag_order"),
                         F.col("q.tag").alias(tag_col), F.col("q.n").alias(size_col),
                         F.col("q.eligible").alias(eligible_col), F.col("q.quota").alias("quota"),
                         F.col("q.taken").alias("taken"))


# ---------------------------------------------------------------------------
# sorting and paging
# ---------------------------------------------------------------------------
def newest(df: DataFrame, score: str | None = "score", key: str = "id") -> DataFrame:
    """G1: ``updated desc``, then score, then id for a total order (the
    ranked feed's order)."""
    order = [F.col("updated").desc_nulls_last()]
    if score:
        order.append(F.col(score).desc_nulls_last())
    return df.orderBy(*order, F.col(key))


def best_topic_key(topics="topics") -> Column:
    """Highest nested topic score of a doc (null without topics)."""
    return F.array_max(F.transform(as_col(topics), lambda t: t["score"]))


def best_topic_first(df: DataFrame, score: str | None = "score", key: str = "id") -> DataFrame:
    """Max topic score desc, ``updated desc``, score desc."""
    order = [best_topic_key().desc_nulls_last(), F.col("updated").desc_nulls_last()]
    if score:
        order.append(F.col(score).desc_nulls_last())
    return df.orderBy(*order, F.col(key))


def oldest(df: DataFrame, key: str = "id") -> DataFrame:
    """``updated asc``, best topic score desc."""
    return df.orderBy(F.col("updated").asc_nulls_last(), best_topic_key().desc_nulls_last(), F.col(key))


def sort_mode(df: DataFrame, mode: str = "date", key: str = "id") -> DataFrame:
    """List order by date or by topic score."""
    return best_topic_first(df, None, key) if mode == "topic" else newest(df, None, key)


def page(df: DataFrame, offset: int = 0, size: int = -1) -> DataFrame:
    """Skip ``offset`` rows, then at most ``size`` (negative = no limit).

    ``df`` must already be ordered; Spark keeps the order through
    offset/limit (``TakeOrderedAndProject`` with an offset). An offset without
    a size is a listing to its end, which Spark makes in one task: give a size
    where the rest is large."""
    offset, size = int(offset), int(size)
    out = df
    if offset > 0:
        out = out.offset(offset)
    if size > -1:
        out = out.limit(size)
    return out


def pick_one(df: DataFrame, order, seed: int, lo: int = 1, hi: int = 10) -> DataFrame:
    """One row at a seeded random offset ``lo..hi`` of the ordered rows."""
    import random
    offset = random.Random(seed).randint(lo, hi)
    return df.orderBy(*_orders(order)).offset(offset).limit(1)
