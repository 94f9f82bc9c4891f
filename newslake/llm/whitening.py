"""Whitening directions of a table of vectors without forming its covariance.

Tasks reduce their centred rows to triangular factors by blockwise QR, which
are combined in two steps to one factor ``R`` with ``R'R`` = n times the
covariance. ``R`` has the size of a vector squared, whatever the number of
rows; the driver reduces it to a bidiagonal ``B`` by Householder reflections,
finds the singular values of ``B`` by the differential quotient-difference
algorithm with shifts (dqds), each to high relative accuracy, and the right
singular vectors by twisted factorisations of ``B'B - s^2``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.llm.neighbours import element_dtype, vectors

EPS = np.finfo(np.float64).eps
#: Entries of a block of rows in numpy code.
BLOCK = 1 << 18


# ---------------------------------------------------------------------------
# the driver's part: d x d
# ---------------------------------------------------------------------------
def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, v)`` with ``r = u @ B @ v.T``: ``B`` is upper bidiagonal with
    diagonal ``a`` and off-diagonal ``b``, ``u`` and ``v`` are orthogonal."""
    m = np.array(r, np.float64)
    d = len(m)
    v = np.eye(d)

    def reflector(x):
        """w with (1 - 2 w w') x = a multiple of the first unit vector."""
        w = x.copy()
        peak = np.abs(w).max()
        if peak == 0 or not np.any(w[1:]):
            return None
        w /= peak
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)
    for i in range(d):
        w = reflector(m[i:, i])
        if w is not None:
            m[i:, i:] -= 2 * np.outer(w, w @ m[i:, i:])
        if i + 2 < d:
            w = reflector(m[i, i + 1:])
            if w is not None:
                m[i:, i + 1:] -= 2 * np.outer(m[i:, i + 1:] @ w, w)
                v[:, i + 1:] -= 2 * np.outer(v[:, i + 1:] @ w, w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One transform of the qd array by ``shift``; the third value, the least of
    the d's, tells how far below zero the shift went."""
    n = len(q)
    p, f = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        p[i] = d + e[i]
        if p[i] == 0.0:
            f[i], d = 0.0, q[i + 1] - shift
        else:
            t = q[i + 1] / p[i]
            f[i] = e[i] * t
            d = d * t - shift
        least = min(least, d) if d == d else float("-inf")
    p[n - 1] = d
    return p, f, least


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix, falling. Works
    on the qd array ``q = a^2``, ``e = b^2``: every transform keeps them free of
    subtractions but for the shift, a shift that goes too far is taken back and made smaller."""
    out: list[float] = []
    stack = [([x * x for x in a.tolist()], [x * x for x in b.tolist()], 0.0)]
    tiny = EPS * EPS
    while stack:
        q, e, gone = stack.pop()
        tries = 0
        while q:
            n = len(q)
            # Off-diagonals that no longer count split the array.
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= tiny * q[i] or e[i] <= tiny * (gone + q[i + 1])), None)
            if n == 1:
                out.append(gone + q[0])
                break
            if cut is not None:
                stack.append((q[: cut + 1], e[:cut], gone))
                q, e, tries = q[cut + 1:], e[cut + 1:], 0
                continue
            if n == 2:  # both values of the last two rows at once
                s = q[0] + q[1] + e[0]
                det = q[0] * q[1]
                high = 0.5 * (s + max(0.0, (q[0] - q[1] + e[0]) ** 2 + 4 * q[1] * e[0]) ** 0.5)
                out += [gone + high, gone + (det / high if high else 0.0)]
                break
            if q[0] < 0.5 * q[-1]:  # falling arrays lose their small values first
                q, e = q[::-1], e[::-1]
            shift = _least_bound(q, e) * 0.25 ** tries if tries < 3 else 0.0
            p, f, low = _dqds_step(q, e, shift)
            if low < 0.0 and shift > 0.0:
                tries += 1
                continue
            if low < 0.0:  # rounding alone: a zero value
                p = [max(x, 0.0) for x in p]
            q, e, gone, tries = p, f, gone + shift, 0
    return np.sort(np.array(out))[::-1]


def _least_bound(q: list[float], e: list[float]) -> float:
    """A lower bound of the least eigenvalue: the d's of the transform without
    a shift are the reciprocals of the diagonal of the inverse, whose trace is at
    least the reciprocal of the least eigenvalue."""
    d, total = q[0], 0.0
    for i in range(len(q) - 1):
        if d <= 0.0:
            return 0.0
        total += 1.0 / d
        d = d * (q[i + 1] / (d + e[i]))
    return 1.0 / (total + 1.0 / d) if d > 0.0 else 0.0


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of ``B'B`` next to ``value``: factored from the top as
    L D L' and from the bottom as U D U', the two meet at the row where the
    remaining pivot is smallest, and that row is solved for outwards."""
    n = len(a)
    if n == 1:
        return np.ones(1)
    q, e = (a * a).tolist(), (b * b).tolist()
    small = np.finfo(np.float64).tiny / EPS
    # B'B has diagonal a_i^2 + b_{i-1}^2 and off-diagonal a_i b_i; the pivots of
    # B'B - value follow from the differential forms, without squaring up.
    up_ratio, s = [0.0] * (n - 1), -value
    stationary = [0.0] * n
    for i in range(n - 1):
        stationary[i] = s
        pivot = q[i] + s
        if abs(pivot) < small:
            pivot = -small
        up_ratio[i] = (a[i] * b[i]) / pivot
        s = s * (e[i] / pivot) - value
    stationary[n - 1] = s
    # From the bottom: diagonal pivots of U D U' of the same matrix.
    down_ratio, p = [0.0] * (n - 1), q[n - 1] - value
    progressive = [0.0] * n
    for i in range(n - 2, -1, -1):
        progressive[i + 1] = p
        pivot = e[i] + p
        if abs(pivot) < small:
            pivot = -small
        down_ratio[i] = (a[i] * b[i]) / pivot
        p = p * (q[i] / pivot) - value
    progressive[0] = p
    rest = np.array(stationary) + np.array(progressive) + value
    r = int(np.argmin(np.abs(rest)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -up_ratio[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -down_ratio[i] * z[i]
    return z / np.linalg.norm(z)


def directions(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest squares of singular values of ``B``, falling, and
    unit eigenvectors of ``B'B`` for them, as columns. Off-diagonals without
    weight split ``B``; a value's vector lives in one part. Vectors of values
    closer than a relative 1e-6 are made orthogonal. Values that are zero in double precision are left out."""
    n = len(a)
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    cuts = np.flatnonzero(np.abs(b) <= EPS * scale * 1e-3)
    bounds = [0, *(cuts + 1).tolist(), n]
    found = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        found += [(float(v), lo, hi) for v in dqds(a[lo:hi], b[lo: hi - 1])]
    found.sort(key=lambda x: -x[0])
    found = [x for x in found if x[0] > (n * EPS) ** 2 * found[0][0]][:most]
    out = np.zeros((n, len(found)))
    begin = 0
    for i, (value, lo, hi) in enumerate(found):
        part_a, part_b = a[lo:hi], b[lo: hi - 1]
        if i and found[i - 1][0] - value > 1e-6 * found[i - 1][0]:
            begin = i
        z = np.zeros(n)
        z[lo:hi] = twisted_vector(part_a, part_b, value)
        near = out[:, begin:i]
        z = _apart(z, near)
        if np.linalg.norm(z) < 0.1:  # the same vector again: another one of the part
            z = np.zeros(n)
            z[lo:hi] = _inverse_iteration(part_a, part_b, value, np.random.default_rng(i).normal(size=hi - lo), near[lo:hi])
        out[:, i] = z / np.linalg.norm(z)
    return np.array([x[0] for x in found]), out


def _apart(z: np.ndarray, near: np.ndarray) -> np.ndarray:
    """``z`` without its parts along the columns of ``near`` (taken out twice against rounding)."""
    for _ in range(2):
        z = z - near @ (near.T @ z)
    return z


def _inverse_iteration(a: np.ndarray, b: np.ndarray, value: float, z: np.ndarray, near: np.ndarray) -> np.ndarray:
    """A unit vector of ``B'B`` next to ``value``, orthogonal to ``near``."""
    diagonal = a * a
    diagonal[1:] += b * b
    m = np.diag(diagonal) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    m -= np.eye(len(a)) * (value + EPS * np.abs(m).max())
    for _ in range(5):
        z = _apart(z, near)
        z = np.linalg.solve(m, z / np.linalg.norm(z))
        z = _apart(z / np.linalg.norm(z), near)
        z /= np.linalg.norm(z)
    return z


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening of vectors of ``dim`` entries: ``n`` vectors with the
    exact sums ``sums``; per component the eigenvalue, its share of the trace and
    the direction (a column, not scaled). Components without variance are absent."""
    dim: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    explained: np.ndarray
    columns: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        """Of what ``fixed_point`` gives less its offset, rounded once."""
        return np.array([_ratio(s - OFFSET * self.n, self.n) for s in self.sums])

    @property
    def scaled(self) -> np.ndarray:
        return self.columns / np.sqrt(self.values)


def _ratio(a: int, b: int) -> float:
    return a / b if b else 0.0


# ---------------------------------------------------------------------------
# the tasks' part
# ---------------------------------------------------------------------------
OFFSET, STEPS = 1_000_000, 64


def fixed_point(values: np.ndarray) -> np.ndarray:
    """floor(64 c) as long, less the offset 1,000,000 that the contract adds
    (the two cancel in all that follows). Beyond a long it stays at the limit."""
    with np.errstate(over="ignore"):
        x = np.floor(STEPS * values.astype(np.float64))
    top = 2.0 ** 63 - 2.0 ** 22
    return np.clip(x, -top, top).astype(np.int64)


def _rows(batches, dtype, dim, extra=None):
    """(row numbers in the batch, their fixed-point entries, batch) by bounded blocks."""
    for b in batches:
        values, offsets, complete, _ = vectors(b.column("vec"), dtype)
        use = np.flatnonzero(complete & (np.diff(offsets) == dim))
        step = max(1, BLOCK // max(dim, 1))
        for lo in range(0, len(use), step):
            part = use[lo: lo + step]
            yield part, fixed_point(values[offsets[part][:, None] + np.arange(dim)]), b


def _lengths(df: DataFrame, dtype) -> DataFrame:
    def run(batches):
        counts: dict[int, int] = {}
        for b in batches:
            _, offsets, complete, _ = vectors(b.column("vec"), dtype)
            for d, n in zip(*(x.tolist() for x in np.unique(np.diff(offsets)[complete], return_counts=True))):
                counts[d] = counts.get(d, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["dim", "n"])
    return df.mapInArrow(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n"))


def _sums(df: DataFrame, dtype, dim: int) -> list[int]:
    """Exact sums of the entries: tasks add in Python's integers once a block could overflow."""
    def run(batches):
        total = [0] * dim
        for _, x, _ in _rows(batches, dtype, dim):
            wide = len(x) and int(np.abs(x).max()) > 2 ** 62 // len(x)
            for i, s in enumerate(x.astype(object).sum(axis=0) if wide else x.sum(axis=0).tolist()):
                total[i] += int(s)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(t) for t in total])], ["i", "s"])
    got = df.mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()  # a row for each entry
    sums = [0] * dim
    for r in got:
        sums[r["i"]] = int(r["s"])
    return sums


def _factors(df: DataFrame, dtype, dim: int, mean: np.ndarray) -> np.ndarray:
    """The triangular factor of all centred rows: one of each task, those of the
    tasks combined by 32 others, and theirs by one. No task holds more than a
    block of rows and a factor."""
    def packed(r):
        return pa.RecordBatch.from_arrays([pa.array([r.astype(np.float64).tobytes()], pa.binary())], ["r"])

    def first(batches):
        r = np.zeros((0, dim))
        for _, x, _ in _rows(batches, dtype, dim):
            r = np.linalg.qr(np.vstack([r, x - mean]), mode="r")
        if len(r):
            yield packed(r)

    def combine(batches):
        r = np.zeros((0, dim))
        for b in batches:
            for x in b.column("r"):
                r = np.linalg.qr(np.vstack([r, np.frombuffer(x.as_py()).reshape(-1, dim)]), mode="r")
        if len(r):
            yield packed(r)
    got = df.mapInArrow(first, "r binary").repartition(32).mapInArrow(combine, "r binary").repartition(1).mapInArrow(combine, "r binary").collect()
    r = np.zeros((dim, dim))
    for x in got:  # one row at most
        part = np.frombuffer(bytes(x["r"])).reshape(-1, dim)
        r[: len(part)] = part
    return r


def solve(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, shares of the trace, directions as columns) of ``r'r / n``
    for the ``most`` largest eigenvalues. One that is zero in double precision gives no component."""
    d = len(r)
    scale = np.abs(r).max(initial=0.0)
    if not d or scale == 0:
        return np.zeros(0), np.zeros(0), np.zeros((d, 0))
    a, b, v = bidiagonalise(r / scale)
    squares, z = directions(a, b, most)
    columns = v @ z
    columns /= np.linalg.norm(columns, axis=0)
    trace = float((r / scale * (r / scale)).sum())
    return squares * scale * scale / n, squares / trace, columns


def _identity_error(df: DataFrame, dtype, w: Whitening) -> float:
    """Largest entry, without sign, of the covariance of the whitened fit list
    less the identity. Tasks keep (n, mean, centred products) of their blocks,
    which are combined without losing the centring."""
    mean, scaled, k = w.mean, w.scaled, len(w.values)

    def join(a, b):
        if a is None:
            return b
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def packed(s):
        return pa.RecordBatch.from_arrays([pa.array([s[0]], pa.int64()), pa.array([s[1].tobytes()], pa.binary()), pa.array([s[2].tobytes()], pa.binary())], ["n", "m", "c"])

    def unpacked(n, m, c):
        return n, np.frombuffer(m), np.frombuffer(c).reshape(k, k)

    def first(batches):
        s = None
        for _, x, _ in _rows(batches, dtype, w.dim):
            y = (x - mean) @ scaled
            m = y.mean(axis=0)
            s = join(s, (len(y), m, (y - m).T @ (y - m)))
        if s:
            yield packed(s)

    def combine(batches):
        s = None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("n", "m", "c"))):
                s = join(s, unpacked(*row))
        if s:
            yield packed(s)
    kind = "n long, m binary, c binary"
    [r] = df.mapInArrow(first, kind).repartition(32).mapInArrow(combine, kind).repartition(1).mapInArrow(combine, kind).collect()
    n, _, c = unpacked(r["n"], bytes(r["m"]), bytes(r["c"]))
    return float(np.abs(c / n - np.eye(k)).max())


def fit(df: DataFrame, vec_col: str, most: int = 32) -> Whitening:
    """The whitening of all rows of ``df`` whose vector takes part: it is not
    null, holds neither nulls nor entries that are not finite, and has the
    length that most vectors have (of two such lengths the longer). Repeated
    rows count each time. An empty table gives a whitening of no vectors, one
    vector or equal ones a whitening without components."""
    dtype = element_dtype(df, vec_col)
    vec = df.select(F.col(vec_col).alias("vec"))
    best = _lengths(vec, dtype).orderBy(F.desc("n"), F.desc("dim")).first()
    if best is None or not best["dim"]:
        return Whitening(0, 0, (), np.zeros(0), np.zeros(0), np.zeros((0, 0)))
    dim, n = best["dim"], best["n"]
    sums = [s + OFFSET * n for s in _sums(vec, dtype, dim)]
    part = Whitening(dim, n, tuple(sums), np.zeros(0), np.zeros(0), np.zeros((dim, 0)))
    return Whitening(dim, n, part.sums, *solve(_factors(vec, dtype, dim, part.mean), n, most))


def apply(df: DataFrame, vec_col: str, w: Whitening, into: str = "whitened", deviation_into: str = "deviation") -> DataFrame:
    """The rows of ``df`` that take part (see ``fit``), with the components of
    the whitened vector (an array of doubles) and ``deviation``: the exact sum
    over the entries of ``(n * x - S)^2`` as ``decimal(38,0)``, null beyond it.
    Raises ValueError if one of the new columns exists."""
    if {into.lower(), deviation_into.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"column {into} or {deviation_into} exists")
    dtype = element_dtype(df, vec_col)
    names = df.columns
    mean, scaled, n = w.mean, w.scaled, w.n
    off = [s - OFFSET * n for s in w.sums]  # S - n * offset
    most = max([abs(s) for s in off], default=0)
    square = sum(s * s for s in off)

    def run(batches):
        for b in batches:
            for part, x, _ in _rows([_named(b, vec_col)], dtype, w.dim):
                white = (x - mean) @ scaled
                peak = int(np.abs(x).max(initial=0))
                # (n x - S)^2 summed up = n^2 sum x^2 - 2 n sum x S + sum S^2, in whole numbers.
                wide = w.dim * peak * max(peak, most) >= 2 ** 62
                y = x.astype(object) if wide else x
                own = (y * y).sum(axis=1).tolist()
                with_s = (y @ np.array(off, object if wide or most >= 2 ** 62 else np.int64)).tolist()
                deviation = [str(n * n * int(p) - 2 * n * int(q) + square) for p, q in zip(own, with_s)]
                k = white.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(white).ravel()))
                take = pa.array(part)
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in range(len(names))], lists, pa.array(deviation, pa.string())], [*names, into, deviation_into])
    from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType
    out = df.mapInArrow(run, StructType([*df.schema.fields, StructField(into, ArrayType(DoubleType())), StructField(deviation_into, StringType())]))
    return out.withColumn(deviation_into, F.col(deviation_into).try_cast("decimal(38,0)"))


def _named(b: pa.RecordBatch, vec_col: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(vec_col)], ["vec"])


def whiten(df: DataFrame, id_col: str, vec_col: str, most: int = 32) -> DataFrame:
    """A row for each vector that takes part (see ``fit``) and each of the
    ``most`` first components: ``vec_id`` (``id_col``, null ids included),
    ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error``. Components without variance have no rows, so equal
    vectors, a single one and empty tables give an empty result."""
    w = fit(df, vec_col, most)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"))
    k = len(w.values)
    if not k:
        return rows.limit(0).select("vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
                                    *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    error = _identity_error(df.select(F.col(vec_col).alias("vec")), element_dtype(df, vec_col), w)
    shares = F.array(*[F.lit(float(x)) for x in w.explained])
    flat = apply(rows, "vec", w).drop("vec").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
