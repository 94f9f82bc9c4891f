"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is a set of k-word shingles. Items are partitioned by size class
(powers of two); the sketch of an item is its smallest shingle hashes, as many
as an item of its class may miss at the asked containment, and one more. So a
document that holds enough of an item holds a hash of its sketch at least, at
whatever length of the document: the search misses nothing. Documents probe
the sketches with all their shingles. Candidate pairs are verified with the
shingles themselves. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import Scratch

#: Rows up to which a side is broadcast (ids and hashes of 8 bytes, or the items' shingles); beyond it the join shuffles.
BROADCAST_ROWS = 100_000
BROADCAST_ITEMS = 2000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: the optimiser may write an
    expression into a lambda, where it would be computed for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def windows(of: Column, k: int, join: Callable[..., Column], whole: bool = False) -> Column:
    """``join`` of the elements of the distinct windows of k elements of an
    array; with ``whole``, fewer elements are one window. Elements are taken
    one by one, as ``slice`` copies the whole array for each window."""
    def cut(column: Column) -> Column:
        last = F.greatest(F.size(column) - k, F.lit(0)) if whole else F.size(column) - k
        some = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: join(*[F.get(column, i + j) for j in range(k)]))
        return F.array_distinct(F.when((F.size(column) > 0) & (last >= 0), some).otherwise(F.slice(some, 1, 0)))
    return let(of, cut)


def shingle_texts(w: Column, k: int, whole: bool = False) -> Column:
    return windows(w, k, lambda *x: F.concat_ws(" ", *x), whole)


def shingle_hashes(w: Column, k: int, whole: bool = False) -> Column:
    return windows(F.transform(w, lambda x: F.xxhash64(x)), k, lambda *x: F.xxhash64(*x), whole)


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Pairs ``(doc_id, item_id, item_shingles, shared, containment)`` where a
    document holds at least ``percent`` % of an item's distinct k-word shingles.

    ``docs(doc_id, text)``, ``items(item_id, text)``; other columns are ignored.
    An item of fewer than k words is one shingle of its own length. Items
    without a word, null texts and empty tables give no pair. Null ids are
    kept as ids; rows that repeat an id give one pair, with the largest overlap.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    item = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(k)))
    item = scratch.save(item.select("item_id", "k", shingle_texts(F.col("w"), k, True).alias("texts"), shingle_hashes(F.col("w"), k, True).alias("hashes")).withColumn("n", F.size("texts")).withColumn("size_class", F.floor(F.log2(F.col("n"))).cast("int")))
    most = F.least(F.pow(F.lit(2), F.col("size_class") + 1) - 1, F.lit(1 << 30))
    sketch = scratch.save(item.select("item_id", F.explode(F.slice(F.array_sort("hashes"), 1, (F.floor(most * (100 - percent) / 100) + 1).cast("int"))).alias("h")))
    lengths = sorted({k, *(r["k"] for r in item.select("k").distinct().collect())})

    def sized(df: DataFrame, bound: int) -> DataFrame:
        return F.broadcast(df) if df.count() <= bound else df

    hashes = let(words(F.col("text")), lambda w: F.flatten(F.array(*[shingle_hashes(w, n) for n in lengths])) if len(lengths) > 1 else shingle_hashes(w, k))
    probe = docs.select("doc_id", F.explode(hashes).alias("h"))
    candidate = scratch.save(probe.join(sized(sketch, BROADCAST_ROWS), "h").select("doc_id", "item_id").distinct())
    ids = candidate.select(F.col("doc_id").alias("c_id")).distinct()
    near = docs.join(sized(ids, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("c_id")), "left_semi")
    held = scratch.save(near.select("doc_id", let(words(F.col("text")), lambda w: F.struct(*[shingle_texts(w, n).alias(f"t{n}") for n in lengths])).alias("t")).select("doc_id", "t.*"))
    pair = held.join(candidate.withColumnRenamed("doc_id", "c_id"), F.col("doc_id").eqNullSafe(F.col("c_id")))
    small = item.select(F.col("item_id").alias("i_id"), "k", "n", "texts")
    both = pair.join(sized(small, BROADCAST_ITEMS), F.col("item_id").eqNullSafe(F.col("i_id")))
    own = F.col(f"t{k}")
    for n in lengths[:-1]:
        own = F.when(F.col("k") == n, F.col(f"t{n}")).otherwise(own)
    return (both.select("doc_id", "item_id", "n", F.size(F.array_intersect("texts", own)).alias("shared"))
            .where(F.col("shared") * 100 >= percent * F.col("n"))
            .groupBy("doc_id", "item_id", F.col("n").cast("long").alias("item_shingles")).agg(F.max("shared").cast("long").alias("shared"))
            .withColumn("containment", F.round(F.col("shared") / F.col("item_shingles"), 6)))
