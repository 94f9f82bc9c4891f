import random
import re

from newslake.llm.decontam import contaminated


def grams(text, k, whole):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    if len(w) < k:
        return {tuple(w)} if w and whole else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items, k, percent):
    out = {}
    for i, t in items:
        n = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        if not n:
            continue
        size = min(k, len(n))
        own = grams(t, size, True)
        for d, x in docs:
            shared = len(own & grams(x, size, False))
            if 100 * shared >= percent * len(own):
                out[d, i] = max(out.get((d, i), (0, 0)), (len(own), shared))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 4, 5, 9, 16, 33, 60])))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "?!"), (103, "a b a b a b a b a b"), (104, "one"), (None, items[3][1])]
    docs = []
    for d in range(300):
        w = [rng.choice(vocab) for _ in range(rng.choice([3, 50, 400]))]
        for _ in range(rng.randrange(4)):  # plant whole and damaged items
            x = rng.choice(items[:60])[1].split()
            for _ in range(rng.randrange(3)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((d, ", ".join(w).upper() if d % 2 else "\n".join(w)))
    docs += [(5, docs[6][1]), (None, docs[7][1]), (900, None), (901, ""), (902, "word " * 60_000), (903, "a b " * 10)]
    got = contaminated(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["shared"]) for r in got.collect()}
    assert len(rows) == got.count() and rows == brute(docs, items, 5, 80)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contaminated(d, i).count() == 1
    assert contaminated(d.limit(0), i).count() == 0 and contaminated(d, i.limit(0)).count() == 0
