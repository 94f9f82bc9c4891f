import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from newslake.llm import periodic_runs
from tests.llm import brute


def runs(words):
    """Every maximal run by its definition, lag by lag."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def described(text, words=None):
    words = brute.WORD.findall(text or "") if words is None else words
    r = runs(words)
    drop = {i for s, length, q in r for i in range(s + q, s + length)}
    best = min(r, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(words), len(r), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % x for x in r)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def rewritten(doc_id, text):
    w = brute.WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


COLUMNS = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def texts(seed, n=250):
    rng = random.Random(seed)
    for i in range(n):
        alphabet = [f"w{x}é" for x in range(rng.choice([1, 2, 2, 3, 5, 40]))]
        w = []
        while len(w) < rng.choice([0, 3, 8, 40, 150]):
            if rng.random() < 0.4:
                root = [rng.choice(alphabet) for _ in range(rng.randrange(1, 9))]
                w += (root * 9)[: rng.randrange(1, 9 * len(root) + 1)]
            else:
                w += [rng.choice(alphabet) for _ in range(rng.randrange(1, 8))]
        yield rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = [(i, t) for i, t in enumerate(texts(seed))]
    docs += [(900, None), (901, ""), (902, " \n"), (903, "a"), (904, "a " * 5), (905, "a " * 6), (906, "a b " * 4), (907, "a b " * 3 + "a"), (908, "x a b a b a b a b a y"),
             (909, "a b " * 7), (910, "A a " * 4), (910, "A a " * 4)]
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    got = {(r["id"], r["text"]): tuple(r[c] for c in COLUMNS) for r in periodic_runs.find_runs(df).collect()}
    assert got == {(i, t): described(t) for i, t in docs}


def test_runs_are_returned_in_order(spark):
    [r] = periodic_runs.find_runs(spark.createDataFrame([("q " + "a b c " * 5 + "c " * 7,)], "text string")).collect()
    assert [tuple(x) for x in r["runs"]] == [(1, 15, 3), (15, 8, 1)]
    assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (1, 15, 3, 5000)


def test_planted_ends_and_null_ids(spark):
    docs = [(i, t) for i, t in enumerate(texts(5, 400))] + [(None, "a " * 20), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in periodic_runs.find_runs(df, rewrite=periodic_runs.planted("h")).collect() if r["doc_id"] is not None}
    assert got == {i: described(t, rewritten(i, t)) for i, t in docs if i is not None}


def test_very_long_texts(spark):
    rng = random.Random(9)
    root = [f"w{rng.randrange(900)}" for _ in range(30_000)]
    whole = root * 4 + root[:77] + ["end"]  # one run of a long period
    few = [rng.choice("ab") for _ in range(60_000)]  # no word is rare
    word = ["x" * 200_000] * 7 + ["y"]  # bytes rather than words
    df = spark.createDataFrame([(1, " ".join(whole)), (2, " ".join(few)), (3, " ".join(word))], "id long, text string")
    got = {r["id"]: r for r in periodic_runs.find_runs(df).collect()}
    assert (got[1]["n_runs"], got[1]["start"], got[1]["length"], got[1]["period"]) == (1, 0, 120_077, 30_000)
    assert got[1]["collapsed_sha256"] == hashlib.sha256(" ".join([*root, "end"]).encode()).hexdigest()
    short = runs_up_to(few, 40)
    assert [tuple(x) for x in got[2]["runs"]] == short
    assert (got[3]["start"], got[3]["length"], got[3]["period"]) == (0, 7, 1)
    assert got[3]["collapsed_sha256"] == hashlib.sha256((word[0] + " y").encode()).hexdigest()


def runs_up_to(words, most):
    """As ``runs``, for periods up to ``most`` (longer ones do not occur in random words)."""
    found = {}
    for q in range(1, most + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a a a a a a", 5, "z")], "id long, text string, Start int, runs string")
    [r] = periodic_runs.find_runs(df).collect()
    assert (r["id"], r["start"], r["length"]) == (1, 0, 6) and len(r["runs"]) == 1
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
