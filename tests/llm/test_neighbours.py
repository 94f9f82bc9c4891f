import math
import random

import pytest
from pyspark.sql import functions as F

from newslake.llm import neighbours
from newslake.llm.neighbours import Layout

SCHEMA = "vec_id long, v array<float>, score int, rank string"


def brute(rows, k, query):
    """Rows (id, vector) by sorting all candidates of every query."""
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if query(i):
            scored = []
            for b, (j, w) in enumerate(ok):
                if a != b and len(v) == len(w):
                    s = 0.0
                    for x, y in zip(v, w):
                        s += x * y
                    scored.append((-s, j))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def got(df, k, layout=Layout()):
    out = neighbours.nearest(df, "vec_id", "v", F.col("vec_id") % 20 == 0, k, layout)
    return sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect())


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def floats(df):
    """The rows as Spark holds them: entries rounded to float."""
    return [(r["vec_id"], r["v"]) for r in df.collect()]


def mixed():
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([1, 1, 30]) for _ in range(16)]) for i in range(700)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a very common vector
    rows += [(2000 + i, [float(rng.randrange(-2, 3)) for _ in range(16)]) for i in range(200)]  # many equal scores
    rows += [(20, rows[3][1]), (20, rows[3][1]), (40, None), (60, []), (80, [0.0] * 16), (100, [1.0] * 15 + [None]), (120, [float("nan")] * 16), (140, [float("inf")] + [1.0] * 15)]
    rows += [(3000 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(30)] + [(None, [1.0] * 16), (4000, [1e-40] * 16), (4020, [3e37] * 16)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("layout", [Layout(), Layout(strip_bytes=640, tasks=1, cells=64), Layout(strip_bytes=1 << 20, tasks=5, cells=1000, pairs=20_000)])
def test_against_brute_force(spark, layout):
    df = table(spark, mixed()).repartition(4)
    assert got(df, 20, layout) == brute(floats(df), 20, lambda i: i % 20 == 0)


def test_fewer_candidates_than_asked_and_one_row(spark):
    df = table(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0])])
    assert got(df, 20) == [(0, 1, 1, 4.0), (0, 2, 2, 4.0)]
    assert got(table(spark, [(0, [1.0, 2.0])]), 20) == []


def test_empty_tables(spark):
    assert got(table(spark, [(1, [1.0])]).limit(0), 3) == []
    assert got(table(spark, [(0, None)]), 3) == []
    assert got(table(spark, [(1, [1.0]), (2, [1.0])]), 3) == []


def test_doubles_and_long_vectors(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(2500)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    assert got(df, 4) == brute(rows, 4, lambda i: i % 20 == 0)


def test_codes_multiply_exactly():
    import numpy as np
    rng = np.random.default_rng(1)
    a, b = rng.choice([-127, 127], (5, 3000)), rng.choice([-127, 127, 126], (4, 3000))
    assert (neighbours.code_products(a.astype(np.float32), b.astype(np.float32)) == a @ b.T).all()


def test_bounds_hold_and_discard():
    """Most pairs are not computed again."""
    import numpy as np
    x = np.random.default_rng(2).normal(size=(3000, 32)).astype(np.float32)
    strip = neighbours.Strip(np.arange(50), np.arange(50), x[:50], 10, 1 << 14)
    pairs = []
    strip._exact = lambda q, c, columns, f=strip._exact: (pairs.append(len(q)), f(q, c, columns))[1]
    strip.meet(np.arange(3000), np.arange(3000), x)
    assert sum(pairs) < 50 * 3000 // 8
