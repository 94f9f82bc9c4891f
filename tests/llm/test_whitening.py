import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslake.llm import whitening
from newslake.llm.queries import QUERIES


def dense(rows, most):
    """Whitening by an eigensolver on the whole table: {(id, component): ...}, exact deviations."""
    ok = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in ok]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x]
    centred = np.array([[c - 1_000_000 - (t - 1_000_000 * n) / n for c, t in zip(r, s)] for r in x])
    cov = centred.T @ centred / n
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w[:, ::-1]
    k = min(most, int((e > 1e-9 * e[0]).sum()))
    return ok, n, deviation, e[:k], e[:k] / np.trace(cov), centred @ w[:, :k] / np.sqrt(e[:k])


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", 2) for i, v in rows], f"vec_id long, v array<{kind}>, whitened string, deviation int")


def compare(out, rows, most):
    ok, n, deviation, e, explained, white = dense(rows, most)
    got = {}
    for r in out.collect():
        got.setdefault(r["component"], []).append(r)
    assert sorted(got) == list(range(1, len(e) + 1))
    for c, part in got.items():
        assert len(part) == len(ok)
        assert {r["n"] for r in part} == {n}
        assert sorted((r["vec_id"], int(r["deviation"])) for r in part) == sorted((i, x) for (i, _), x in zip(ok, deviation))
        assert part[0]["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
        mine = np.array([r["whitened"] for r in sorted(part, key=lambda r: (r["vec_id"], int(r["deviation"])))])
        ref = np.array([w for _, _, w in sorted((i, x, w) for (i, _), x, w in zip(ok, deviation, white[:, c - 1].tolist()))])
        assert np.abs(mine * np.sign(mine @ ref) - ref).max() < 1e-7
        assert part[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("most", [32, 3])
def test_against_a_dense_eigensolver(spark, most):
    rng = random.Random(most)
    rows = [(i, [rng.gauss(j, 1 + j) for j in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # a very common vector
    bad = [(2000, None), (2001, [1.0] * 7 + [None]), (2002, [float("nan")] + [1.0] * 7), (2003, [float("inf")] * 8)]
    df = table(spark, rows + bad, "double").repartition(5)
    compare(whitening.whiten(df, "vec_id", "v", most), rows, most)


def test_query_against_a_dense_eigensolver(spark):
    out = QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.001")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert [(n, t) for n, t in out.dtypes] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    compare(out, rows, 32)


def test_dependent_entries_and_ties(spark):
    rng = random.Random(4)
    rows = [(i, [float(a), float(a), float(b), 5.0]) for i, (a, b) in enumerate((rng.randrange(9), rng.randrange(9)) for _ in range(300))]
    compare(whitening.whiten(table(spark, rows), "vec_id", "v"), rows, 32)  # two components of four
    square = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)] * 3)]
    got = whitening.whiten(table(spark, square), "vec_id", "v").collect()
    assert {r["component"] for r in got} == {1, 2} and all(r["identity_error"] < 1e-12 and abs(r["explained"] - 0.5) < 1e-12 for r in got)


def test_large_values_are_exact(spark):
    rows = [(1, [2.0 ** 40, 1.0]), (2, [-(2.0 ** 40), 2.0]), (3, [3.0, 2.0 ** 33])]
    compare(whitening.whiten(table(spark, rows, "double"), "vec_id", "v"), rows, 32)
    beyond = whitening.whiten(table(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "double"), "vec_id", "v").collect()
    assert {r["deviation"] for r in beyond} <= {None, beyond[0]["deviation"]}


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]):
        df = table(spark, rows or [(1, [1.0])])
        out = whitening.whiten(df if rows else df.limit(0), "vec_id", "v")
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_other_lengths_and_null_ids(spark):
    rows = [(None, [1.0, 5.0]), (1, [2.0, 3.0]), (2, [7.0, 1.0]), (3, [1.0]), (4, [1.0])]
    got = whitening.whiten(table(spark, rows), "vec_id", "v").collect()
    assert {(r["vec_id"], r["n"]) for r in got} == {(None, 3), (1, 3), (2, 3)}


def test_clashing_column_raises(spark):
    df = table(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0])])
    with pytest.raises(ValueError):
        whitening.apply(df, "v", whitening.fit(df, "v"))


def matrices():
    rng = np.random.default_rng(3)
    yield "random", rng.normal(size=(40, 40))
    yield "graded", rng.normal(size=(30, 30)) * np.logspace(0, -12, 30)
    yield "equal", np.diag([3.0, 3, 3, 2, 2, 1])
    yield "identity", np.eye(7)
    yield "one", np.array([[2.0]])
    yield "rank", np.outer(rng.normal(size=9), rng.normal(size=9))
    yield "close pairs", np.triu(np.diag(np.abs(np.arange(-10, 11.0))) + np.eye(21, k=1))
    q = [np.linalg.qr(rng.normal(size=(30, 30)))[0] for _ in range(2)]
    yield "clusters", (q[0] * np.repeat([1, 1 + 1e-9, 2], 10)) @ q[1]


@pytest.mark.parametrize("name,m", list(matrices()))
def test_solver(name, m):
    r = np.linalg.qr(m, mode="r")
    e, share, c = whitening.solve(r, 1, len(r))
    ref = np.linalg.svd(r, compute_uv=False) ** 2
    scale = ref[0]
    tol = 1e-9 if name == "graded" else 1e-12  # of a general matrix small values are only known absolutely
    assert np.abs(e - ref[: len(e)]).max() <= tol * scale and (ref[len(e):] < 1e-20 * scale).all()
    assert np.abs(c.T @ c - np.eye(len(e))).max() < 1e-10
    assert np.abs(r.T @ (r @ c) - c * e).max() < 1e-12 * scale
    assert share == pytest.approx(e / (r * r).sum())


def test_small_singular_values_are_relatively_accurate():
    """dqds finds them from the bidiagonal to its own precision."""
    from fractions import Fraction
    a, b = np.array([1.0, 1e-5, 1e-10]), np.array([1e-3, 1e-8])
    product = 1
    for x in a:
        product *= Fraction(float(x)) ** 2
    got = whitening.dqds(a, b)
    assert float(np.prod(got)) == pytest.approx(float(product), rel=1e-13)
