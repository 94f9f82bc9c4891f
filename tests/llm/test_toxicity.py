import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from newslake.llm import toxicity as T


def corpus(n=1500):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 300))]
        toxic = rng.random() < 0.12
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["vilezor", "VILEZOR!", "scumbra", "Scumbra?"]))
        docs.append((i, " ".join(w)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    truth = {i: any(x in t.lower() for x in ("vilezor", "scumbra")) for i, t in docs}
    extra = [(10_000, None), (10_001, ""), (None, "scumbra text"), (10_002, "filler " * 50_000 + "vilezor")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs + extra], "doc_id long, text string, toxic int").repartition(4)
    lab = spark.createDataFrame(labels + [(None, 1), (3, None), (4, 0), (4, int(truth[4]))], "doc_id long, toxic int")
    model = T.fit(d, lab, ~T.held_out("doc_id"))
    rows = T.score(d, model).select("doc_id", "score", T.held_out("doc_id").alias("h")).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["h"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in docs) and by[None]["h"] is False
    out = [i for i, _ in docs if by[i]["h"]]
    assert np.mean([(by[i]["score"] >= 0.3) == truth[i] for i in out]) > 0.97
    assert by[10_000]["score"] == by[10_001]["score"] < 0.3 <= by[10_002]["score"]
    again = T.score(d, T.fit(d.repartition(7), lab.repartition(2), ~T.held_out("doc_id"))).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {i: r["score"] for i, r in by.items()}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(d, none, F.lit(True))
    assert T.score(d, model).first()["score"] == 0.0
    assert T.score(d.limit(0), model).count() == 0
    assert T.fit(d.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), F.lit(True)).prior == 0.0


def test_risk_estimate_uses_the_prior():
    rng = np.random.default_rng(0)
    positive = [np.array([0]) for _ in range(300)]
    unlabelled = [np.array([0]) if rng.random() < 0.2 else np.array([], int) for _ in range(3000)]
    w, b = T.nn_pu(positive, unlabelled, 1, 0.2)
    assert 1 / (1 + np.exp(-(w[0] + b))) > 0.8 and 1 / (1 + np.exp(-b)) < 0.05
