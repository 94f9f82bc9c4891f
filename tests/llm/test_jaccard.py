import random

import pytest

from newslake.llm.jaccard import jaccard_components
from tests.llm import brute


def rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"W{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(150)]
    passage = [rng.choice(vocab) for _ in range(50)]
    docs = []
    for i in range(400):
        if i % 4 == 0:  # near copies at several distances
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif i % 4 == 1:  # a passage that many documents share
            w = passage + [rng.choice(vocab) for _ in range(rng.randrange(40))]
        elif i % 4 == 2:
            w = [rng.choice(vocab) for _ in range(rng.randrange(6))]
        else:
            w = [rng.choice(vocab) for _ in range(rng.randrange(400))]
        docs.append((i, " \n\t"[i % 3].join(w)))
    docs += [(1000 + i, docs[i % 40][1].lower()) for i in range(200)]
    docs += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "one"), (3004, "ONE"), (3005, "one two"), (3006, "é É"), (3007, "x" * 300_000), (3008, "word " * 50_000)]
    rng.shuffle(docs)
    got = rows(jaccard_components(spark.createDataFrame([(i, t, 7, "q") for i, t in docs], "doc_id long, text string, n long, node string").repartition(5)))
    assert got == brute.jaccard_components(docs)


def test_null_ids_repeated_ids_and_empty(spark):
    a, b = "p q r s t u v", "k l m n o p q"
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (None, a), (None, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_components(df).collect() if r["doc_id"] is not None)
    assert got == [(1, 5, 1), (2, 5, 1), (2, 5, 1), (3, 5, 1)]
    assert [r["component_id"] for r in jaccard_components(df).where("doc_id is null").collect()] == [None, None]
    assert jaccard_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_other_thresholds(spark, percent):
    rng = random.Random(percent)
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(12)))) for i in range(150)]
    assert rows(jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), percent, 2)) == brute.jaccard_components(docs, percent, 2)
