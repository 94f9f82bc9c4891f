"""N-gram Jaccard join by a blocked sparse product of the document by n-gram
incidence matrix.

Two sets with Jaccard similarity >= t share an n-gram among the first
``|X| - ceil(t |X|) + 1`` of each under any common order. The order used puts
rare n-grams first: occurrences over all documents are counted in a fixed
number of cells, and n-grams are ordered by (count of their cell, hash). Only
this part of the incidence matrix is dealt out by n-gram, so that common
passages gather no documents. Documents with equal sets are one row of the
matrix. In the column of an n-gram, one document of each component found so
far is multiplied with the column's documents of other components; the full
overlap counts are accumulated block by block, and pairs that the set sizes
rule out are dropped before. Links merge components, and columns within one
component are finished; further rounds go on until no column has two
components left with an unchecked pair. So a group of g copies costs about g
pairs, and no link between different components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.llm import wordhash as W
from newslake.llm.common import PACKED, Scratch, dense_counts, packed, row_blocks, text_buffers, unpacked
from newslake.llm.components import components

#: Counters of the n-gram order and bits of the row filter; both bound what is broadcast.
CELLS = 1 << 20
BITS = 1 << 21
#: Places in the first part of a row: above what any row has.
PLACES = 1 << 31
#: Rows of small intermediate tables for each file, and pairs for each task that compares texts: at most so many files and tasks, whatever the number of shuffle partitions.
ROWS_A_FILE = 30_000
PAIRS_A_TASK = 400
BINS_A_TASK = 20_000
#: Hash ranges (a power of two) in which the n-grams of a set are counted.
BINS = 256


def sets_of(text: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row, hash): the distinct shingles of each block of rows."""
    data, offsets = text_buffers(text)
    for lo, hi in row_blocks(offsets):
        w = W.Words(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
        yield lo, hi, *W.distinct(*W.shingles(w, k))


def _first(n: np.ndarray, percent: int) -> np.ndarray:
    """How many n-grams of a set of size n must be looked at."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def overlap(a: pa.Array, b: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes of rows of ``a`` and of ``b`` and the overlap of each pair: the
    product of two blocks of the incidence matrix along the pairs."""
    n = len(a)
    sizes, inter = [np.zeros(n, np.int64), np.zeros(n, np.int64)], np.zeros(n, np.int64)
    da, oa = text_buffers(a)
    db, ob = text_buffers(b)
    for lo, hi in row_blocks(oa + ob):
        parts = [W.distinct(*W.shingles(W.Words(d[o[lo]: o[hi]], o[lo: hi + 1] - o[lo]), k)) for d, o in ((da, oa), (db, ob))]
        for s, (row, _) in zip(sizes, parts):
            s[lo:hi] = np.bincount(row, minlength=hi - lo)
        row = np.concatenate([parts[0][0], parts[1][0]])
        h = np.concatenate([parts[0][1], parts[1][1]])
        by = np.lexsort((h, row))
        row, h = row[by], h[by]
        twice = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
        inter[lo:hi] = np.bincount(row[1:][twice], minlength=hi - lo)
    return sizes[0], sizes[1], inter


def jaccard_components(docs: DataFrame, percent: int = 90, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set
    holds its distinct ``k``-word shingles (64-bit hashes), with fewer words the
    whole sequence, without words nothing. Two documents link when
    ``100 * |X and Y| >= percent * |X or Y|``. Null and empty texts link with
    nothing; rows with a null id get a null component and link nothing; rows
    that repeat an id are one document that has the links of each of them.
    An empty table gives an empty one; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sets(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            ids, n, digest = b.column("doc_id"), np.zeros(len(b), np.int64), [b""] * len(b)
            for lo, hi, row, h in sets_of(b.column("text"), k):
                total += np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                n[lo:hi] = np.diff(at)
                for i in range(hi - lo):
                    digest[lo + i] = hashlib.blake2b(h[at[i]: at[i + 1]].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(digest, pa.binary()), pa.nulls(len(b), pa.int32()), pa.nulls(len(b), pa.binary())], names)
        c = packed(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(c), pa.int64()), pa.nulls(len(c), pa.int64()), pa.nulls(len(c), pa.binary()), *c.columns], names)

    names = ["doc_id", "n", "digest", "piece", "counts"]
    found = scratch.save(docs.mapInArrow(sets, f"doc_id long, n long, digest binary, {PACKED}"))
    cells = spark.sparkContext.broadcast(np.minimum(unpacked(found.where("piece is not null").select("piece", "counts"), CELLS), (1 << 31) - 1).astype(np.int32))
    rows = found.where("piece is null").select("doc_id", "n", "digest")
    parts = 1 + rows.count() // ROWS_A_FILE

    # Documents with equal sets: one row of the matrix, named by the smallest id.
    classes = rows.where("doc_id is not null and n > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    many = scratch.save(classes.where("copies > 1").select("digest", "node"), parts)
    member = scratch.save(rows.join(salted(many, "digest"), [rows["digest"] == F.col("s_digest"), F.pmod(F.xxhash64(rows["doc_id"]), F.lit(SALTS)) == F.col("s_salt")], "left")
                          .select(rows["doc_id"], "n", F.when(rows["doc_id"].isNotNull(), F.coalesce("node", rows["doc_id"])).alias("node")), parts)
    apart = member.groupBy("doc_id").agg(F.min("node").alias("m"), F.max("node").alias("w")).where("m < w")
    edges = member.join(apart, "doc_id").where("node <> m").select(F.col("node").alias("u"), F.col("m").alias("v"))

    def first_rows(batches):
        count = cells.value
        for b in batches:
            size, grams = np.zeros(len(b), np.int64), [None] * len(b)
            for lo, hi, row, h in sets_of(b.column("text"), k):
                by = np.lexsort((h, count[(h & np.uint64(CELLS - 1)).astype(np.int64)], row))
                h = h[by]
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                size[lo:hi] = np.diff(at)
                p = _first(size[lo:hi], percent)
                for i in range(hi - lo):
                    grams[lo + i] = h[at[i]: at[i] + p[i]].view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(grams, pa.list_(pa.int64()))], ["node", "n", "grams"])

    # One text of each class; entries (n-gram, node) of the first part of its row, with the size of the row and the place in one number.
    one = scratch.save(docs.where("doc_id is not null").mapInArrow(first_rows, "node long, n long, grams array<long>").where("n > 0")
                       .join(member.where("doc_id = node and n > 0").select("node").distinct(), "node", "left_semi"), parts)
    entry = one.select("node", "n", F.posexplode("grams").alias("pos", "gram")).select("gram", "node", (F.col("n") * PLACES + F.col("pos")).alias("at"))
    # Columns of two entries are left out at once if the bounds below rule out their pair; most columns that are shared by chance go here.
    size, place = (lambda c: F.shiftright(c, 31)), (lambda c: F.col(c).bitwiseAND(F.lit(PLACES - 1)))
    shared = (entry.groupBy("gram").agg(F.count("*").alias("df"), F.min("at").alias("x"), F.max("at").alias("y"))
              .where((F.col("df") > 2) | (F.col("df") == 2) & (100 * size("x") >= percent * size("y"))
                     & ((100 + percent) * F.least(size("x") - place("x"), size("y") - place("y")) >= percent * (size("x") + size("y")))).select("gram"))
    column = scratch.save(entry.join(shared, "gram").select("gram", "node", size("at").alias("n"), place("at").alias("pos")), parts)

    def fetch(of: DataFrame, nodes: DataFrame) -> DataFrame:
        """Rows of ``of`` that may be among the nodes, by a filter of fixed size; it spares most others the shuffle."""
        bits = spark.sparkContext.broadcast(np.packbits(dense_counts(
            nodes, lambda b: (W.mix(b.column("node").to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64), BITS) > 0))

        def likely(batches):
            for b in batches:
                at = (W.mix(b.column("doc_id").to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)
                yield b.filter(pa.array((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
        return of.mapInArrow(likely, of.schema)

    def binned(batches):
        for b in batches:
            bins = [b""] * len(b)
            for lo, hi, row, h in sets_of(b.column("text"), k):
                counts = np.bincount(row * BINS + (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=(hi - lo) * BINS).reshape(-1, BINS)
                bins[lo:hi] = [c.astype(np.uint32).tobytes() for c in counts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bins, pa.binary())], ["a", "a_bins"])

    def may_link(batches):
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.slice(lo, 1024)
                x, y = (np.stack([np.frombuffer(v, np.uint32) for v in part.column(c).to_pylist()]).astype(np.int64) for c in ("a_bins", "b_bins"))
                ok = np.minimum(x, y).sum(1) * (100 + percent) >= percent * (x.sum(1) + y.sum(1))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok))

    def linked(batches):
        for b in batches:
            x, y, inter = overlap(b.column("a_text"), b.column("b_text"), k)
            ok = (inter > 0) & (100 * inter >= percent * (x + y - inter))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["u", "v"]).filter(pa.array(ok))

    label, rest, per = None, column.withColumn("comp", F.col("node")), 1
    while True:
        if label is not None:
            # Columns with documents of different components.
            state = rest.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("gram")
            rest = scratch.save(rest.join(state, "gram"), parts)
        if rest.isEmpty():
            break
        # One document of each component, as far as `per` goes: the one with the fewest rare n-grams before this one.
        bucket = F.lit(0) if per == 1 else F.pmod(F.xxhash64("comp"), F.lit(per))
        pivot = rest.groupBy("gram", bucket.alias("part")).agg(F.min(F.struct("pos", "node", "n", "comp")).alias("p")).select(
            "gram", F.col("p.n").alias("an"), F.col("p.pos").alias("ap"), F.col("p.comp").alias("ac"), F.col("p.node").alias("a"))
        # Bounds of the overlap by the sizes, and by what follows the n-gram in both rows if it is the first that they share.
        most = F.least(F.col("n") - F.col("pos"), F.col("an") - F.col("ap"))
        pair = scratch.save(rest.join(pivot, (rest["gram"] == pivot["gram"]) & (F.col("ac") != F.col("comp")) & (100 * F.least("n", "an") >= percent * F.greatest("n", "an"))
                                      & (most * (100 + percent) >= percent * (F.col("n") + F.col("an"))))
                            .select("a", F.col("node").alias("b")).distinct(), parts)
        pairs, found = pair.count(), None
        if pairs:
            of_a, of_b = pair.select(F.col("a").alias("node")), pair.select(F.col("b").alias("node"))
            texts = scratch.save(fetch(docs.where("doc_id is not null"), of_a.unionByName(of_b)))
            # The sets' counts by hash range bound the overlap; few pairs that don't link get past them, so texts move for few.
            a_bins, b_bins = (texts.mapInArrow(binned, "a long, a_bins binary") for _ in "ab")
            close = scratch.save(pair.join(b_bins.toDF("b", "b_bins"), "b").join(a_bins, "a")
                                 .coalesce(1 + pairs // BINS_A_TASK).mapInArrow(may_link, "a long, b long").distinct(), parts)
            pairs = close.count()
            of_a, of_b = close.select(F.col("a").alias("node")), close.select(F.col("b").alias("node"))
            a_text, b_text = fetch(texts, of_a).withColumnsRenamed({"doc_id": "a", "text": "a_text"}), fetch(texts, of_b).withColumnsRenamed({"doc_id": "b", "text": "b_text"})
            found = scratch.save(close.join(b_text, "b").join(a_text, "a").coalesce(1 + pairs // PAIRS_A_TASK).mapInArrow(linked, "u long, v long"), parts)
        if label is None or found is not None and not found.isEmpty():
            edges = scratch.save((edges.unionByName(found) if found is not None else edges).distinct(), parts)
            label = scratch.save(components(edges, scratch, parts), parts)
        # These documents are checked against all of their column.
        rest = (rest.select("gram", "node", "n", "pos").join(pivot.select("gram", F.col("a").alias("node")), ["gram", "node"], "left_anti")
                .join(label, "node", "left").select("gram", "node", "n", "pos", F.coalesce("component", "node").alias("comp")))
        per *= 16
    label = label if label is not None else components(edges, scratch, parts)
    named = member.join(label.withColumnRenamed("component", "c"), "node", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "node").alias("component_id"))


SALTS = 8


def salted(unique: DataFrame, key: str) -> DataFrame:
    """Each row once per salt, so that the other side's rows of one key are
    dealt over ``SALTS`` tasks."""
    return unique.withColumnRenamed(key, f"s_{key}").withColumn("s_salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
