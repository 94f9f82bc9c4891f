"""Nearest neighbours by inner product: a block matrix join.

Queries are dealt into strips and candidates into lanes; a task takes one strip
and one lane, so each pair of a query and a candidate meets once. Vectors are
quantised to int8 with a scale each. A tile, the product of two blocks of codes,
is exact in integers, and the two quantisation errors bound how far it is from
the inner product. Pairs whose upper bound reaches the query's k-th best score
so far are computed again in double precision and go through the query's heap;
heaps of different lanes are merged. No answer is lost by the bounds.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from newslake.llm.common import Scratch


@dataclass(frozen=True)
class Layout:
    """How the work is cut; results are the same for all values."""
    strip_bytes: int = 32 << 20  # of the vectors of a strip of queries
    pairs: int = 1 << 36  # that a task looks at, at most
    tasks: int = 24  # at least, however small the table
    cells: int = 1 << 21  # of a tile


#: Products of this many int8 codes and their sum are exact in float32.
EXACT = 1024


def vectors(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, whether each row is complete, whether it has another
    value than zero) of a column of lists. A row is complete if neither it nor
    an entry is null and all entries are finite; other rows' values mean nothing."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = lists.flatten()  # without the values of null lists
    null = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.cast(pa.from_numpy_dtype(dtype), safe=False).fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    bad = np.bincount(row[null | ~np.isfinite(values)], minlength=len(lists)) > 0
    some = np.bincount(row[values != 0], minlength=len(lists)) > 0
    return values, offsets, lists.is_valid().to_numpy(zero_copy_only=False) & ~bad, some


def element_dtype(df: DataFrame, vec_col: str):
    kind = df.schema[vec_col].dataType
    if not isinstance(kind, ArrayType):
        raise ValueError(f"{vec_col} is not an array")
    return np.float32 if isinstance(kind.elementType, FloatType) else np.float64


def taking_part(df: DataFrame, id_col: str, vec_col: str, is_query: Column) -> DataFrame:
    """(id, query, dim, vec): the rows that take part, vectors as bytes."""
    dtype = element_dtype(df, vec_col)

    def run(batches):
        for b in batches:
            values, offsets, complete, some = vectors(b.column("vec"), dtype)
            use = np.flatnonzero(complete & some & b.column("id").is_valid().to_numpy(zero_copy_only=False))
            raw = np.ascontiguousarray(values).view(np.uint8).tobytes()
            size = np.dtype(dtype).itemsize
            vec = [raw[x * size: y * size] for x, y in zip(offsets[use].tolist(), offsets[use + 1].tolist())]
            take = pa.array(use)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("query").take(take), pa.array(np.diff(offsets)[use], pa.int32()), pa.array(vec, pa.binary())], ["id", "query", "dim", "vec"])
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vec_col).alias("vec"))
    return rows.mapInArrow(run, "id long, query boolean, dim int, vec binary")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (held as float32), scales, norms of the decoded vectors and
    norms of what they lack, for the rows of ``x``. Norms are rounded up."""
    wide = x.astype(np.float64)
    scale = np.abs(wide).max(axis=1) / 127
    codes = np.rint(wide / scale[:, None])
    back = codes * scale[:, None]
    up = 1 + 1e-9
    return codes.astype(np.float32), scale, np.sqrt((back * back).sum(axis=1)) * up, np.sqrt(((wide - back) ** 2).sum(axis=1)) * up


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tile ``a @ b.T`` of integer codes, exact."""
    total = a[:, :EXACT] @ b[:, :EXACT].T
    if a.shape[1] > EXACT:
        total = total.astype(np.float64)
        for d in range(EXACT, a.shape[1], EXACT):
            total += a[:, d: d + EXACT] @ b[:, d: d + EXACT].T
    return total


class Strip:
    """A strip of queries with a heap of (score, -id) for each."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, cells: int):
        self.row, self.ids, self.k, self.cells = row, ids, k, cells  # rows ascend
        self.columns = np.ascontiguousarray(x.T)
        self.codes, self.scale, self.norm, self.lack = quantised(x)
        self.heaps: list[list] = [[] for _ in range(len(row))]
        self.least = np.full(len(row), -np.inf)  # k-th best score so far

    def meet(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Lets the queries see more candidates."""
        use = self._of_equals(ids, x)
        step = max(1, self.cells // len(self.row))
        for lo in range(0, len(use), step):
            part = use[lo: lo + step]
            self._tile(row[part], ids[part], x[part])

    def _of_equals(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of equal vectors the k + 1 with the smallest ids: no answer holds
        another one, as one of them at most is the query itself."""
        raw = x.view(np.uint32).astype(np.uint64)
        odd = np.random.default_rng(7).integers(1, 1 << 62, raw.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        key = (raw * odd).sum(axis=1, dtype=np.uint64)
        by = np.lexsort((ids, key))
        new = np.ones(len(by), bool)
        new[1:] = key[by][1:] != key[by][:-1]
        begin = np.flatnonzero(new)
        if len(begin) == len(by):
            return np.arange(len(ids))
        size = np.diff(np.append(begin, len(by)))
        place = np.arange(len(by)) - np.repeat(begin, size)
        late = np.flatnonzero(place > self.k)
        first = by[np.repeat(begin, size)[late]]
        equal = (x[by[late]] == x[first]).all(axis=1)
        drop = np.zeros(len(ids), bool)
        drop[by[late[equal]]] = True
        return np.flatnonzero(~drop)

    def _tile(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        codes, scale, norm, lack = quantised(x)
        near = code_products(self.codes, codes) * (self.scale[:, None] * scale)
        # Of the two errors and their product, and of rounding in double precision.
        slack = (x.shape[1] + 8) * 2.0 ** -52
        far = self.norm[:, None] * (lack + slack * (norm + lack)) + self.lack[:, None] * (norm + lack)
        own = np.searchsorted(self.row, row)
        own[own == len(self.row)] = 0
        mine = np.flatnonzero(self.row[own] == row)
        near[own[mine], mine] = -np.inf
        least = self.least.copy()
        open_ = np.flatnonzero(np.isneginf(least))
        if len(open_) and len(row) > self.k:
            # Until a heap is full: k candidates of this tile reach the k-th lower bound.
            low = near[open_] - far[open_]
            least[open_] = np.partition(low, len(row) - self.k, axis=1)[:, len(row) - self.k]
        near += far
        q, c = np.nonzero((near >= least[:, None]) & ~np.isneginf(near))
        for lo in range(0, len(q), self.cells // 4 + 1):
            part = slice(lo, lo + self.cells // 4 + 1)
            self._push(q[part], ids[c[part]], self._exact(q[part], c[part], np.ascontiguousarray(x.T)))

    def _exact(self, q: np.ndarray, c: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Inner products in double precision, summed in the order of the entries."""
        total = np.zeros(len(q))
        for mine, other in zip(self.columns, columns):
            total += mine[q].astype(np.float64) * other[c].astype(np.float64)
        return total

    def _push(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        use = np.flatnonzero(score >= self.least[q])
        k = self.k
        for i, s, d in zip(q[use].tolist(), score[use].tolist(), ids[use].tolist()):
            heap = self.heaps[i]
            if len(heap) < k:
                heapq.heappush(heap, (s, -d))
            elif (s, -d) > heap[0]:
                heapq.heapreplace(heap, (s, -d))
            else:
                continue
            if len(heap) == k:
                self.least[i] = heap[0][0]

    def lists(self, step: int = 4096):
        """What the heaps hold, best first."""
        for lo in range(0, len(self.row), step):
            best = [sorted(h, key=lambda x: (-x[0], -x[1])) for h in self.heaps[lo: lo + step]]
            yield pa.RecordBatch.from_arrays([pa.array(self.row[lo: lo + step]), pa.array(self.ids[lo: lo + step]),
                                              pa.array([[s for s, _ in h] for h in best], pa.list_(pa.float64())), pa.array([[-d for _, d in h] for h in best], pa.list_(pa.int64()))], LISTS)


LISTS = ["row", "query_id", "scores", "ids"]


def _meet(k: int, cells: int, dtype):
    def run(batches):
        """Rows come by tile, queries before candidates."""
        at, waiting, strip = None, [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("dim", "strip", "lane", "kind")])
            cut = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [b.num_rows]]) if b.num_rows else [0]
            for lo, hi in zip(cut[:-1], cut[1:]):
                dim, number, lane, kind = key[:, lo].tolist()
                if at != (dim, number, lane):
                    if strip is not None:
                        yield from strip.lists()
                    at, waiting, strip = (dim, number, lane), [], None
                part = b.slice(lo, hi - lo)
                vec = part.column("vec").combine_chunks() if isinstance(part.column("vec"), pa.ChunkedArray) else part.column("vec")
                x = np.frombuffer(b"".join(vec.to_pylist()), dtype).reshape(-1, dim)
                piece = (part.column("row").to_numpy(), part.column("id").to_numpy(), x)
                if kind == 0:
                    waiting.append(piece)
                    continue
                if strip is None and waiting:
                    strip = Strip(*[np.concatenate(p) for p in zip(*waiting)], k, cells)
                    waiting = []
                if strip is not None:  # a strip without queries has nobody to meet
                    strip.meet(*piece)
        if strip is not None:
            yield from strip.lists()
    return run


def _merge(k: int):
    def best(query, parts):
        merged = heapq.merge(*[[(-s, d) for s, d in zip(x, y)] for x, y in parts])
        return [(query, r + 1, d, -s) for r, (s, d) in enumerate(islice(merged, k))]

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])

    def run(batches):
        """Lists come by query."""
        at, parts, out = None, [], []
        for b in batches:
            for row, query, scores, ids in zip(*[b.column(c).to_pylist() for c in LISTS]):
                if at is None or at[0] != row:
                    if at is not None:
                        out += best(at[1], parts)
                    at, parts = (row, query), []
                parts.append((scores, ids))
            if len(out) > 10_000:
                yield packed(out)
                out = []
        if at is not None:
            out += best(at[1], parts)
        yield packed(out)
    return run


def nearest(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 20, layout: Layout = Layout()) -> DataFrame:
    """The ``k`` rows with the largest inner product, in double precision on the
    original vectors, for each row of ``df`` for which ``is_query`` holds:
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; of equal scores the
    smaller id is nearer. Candidates are all rows but the query's own row; if
    there are fewer than ``k``, all of them. The result is exact.

    Vectors that are null, empty, all zero or hold a null or an entry that is
    not finite take no part, nor do rows with a null id. A vector meets
    vectors of its own length only. Repeated rows are rows of their own: each of
    them is a query (with an answer of its own under the same id) and a candidate
    of the others. Other columns of ``df`` are not read. An empty table, or
    one without queries, gives an empty one.

    Each query is sent to every lane and each candidate to every strip; both
    counts follow from the numbers of rows, and the memory of a task from the
    layout. Rows are read back from the shared folder, so a lost executor's
    tiles are computed again and nothing else."""
    spark = df.sparkSession
    dtype = element_dtype(df, vec_col)
    rows = Scratch(spark, "vectors").save(taking_part(df, id_col, vec_col, is_query).withColumn("row", F.monotonically_increasing_id()))
    strips, lanes, tiles = {}, {}, 0
    for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("query").alias("q")).collect():  # one row for each length of vectors
        strips[r["dim"]] = max(1, math.ceil(r["q"] * r["dim"] * np.dtype(dtype).itemsize / layout.strip_bytes))
        lanes[r["dim"]] = max(1, math.ceil(layout.tasks / strips[r["dim"]]), math.ceil(r["n"] * r["q"] / strips[r["dim"]] / layout.pairs))
        tiles += strips[r["dim"]] * lanes[r["dim"]]
    if not tiles:
        strips, lanes, tiles = {0: 1}, {0: 1}, 1

    def of(counts):
        return F.create_map(*[F.lit(x).cast("int") for kv in counts.items() for x in kv])[F.col("dim")]

    def dealt(salt, counts):
        return F.pmod(F.xxhash64("row", F.lit(salt)), of(counts)).cast("int")
    columns = ["dim", "strip", "lane", "kind", "row", "id", "vec"]
    queries = (rows.where("query").withColumn("strip", dealt(1, strips)).withColumn("kind", F.lit(0))
               .withColumn("lane", F.explode(F.sequence(F.lit(0), of(lanes) - 1))).select(columns))
    others = (rows.withColumn("lane", dealt(2, lanes)).withColumn("kind", F.lit(1))
              .withColumn("strip", F.explode(F.sequence(F.lit(0), of(strips) - 1))).select(columns))
    grid = queries.unionByName(others).repartition(min(tiles, 100_000), "dim", "strip", "lane").sortWithinPartitions("dim", "strip", "lane", "kind", "row")
    lists = grid.mapInArrow(_meet(k, layout.cells, dtype), "row long, query_id long, scores array<double>, ids array<long>")
    return lists.repartition("row").sortWithinPartitions("row").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
