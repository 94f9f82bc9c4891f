import os
import random

from newslake.llm import token_counts as C

BASE = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
RANKS, JSON = f"{BASE}/byte_bpe_50k.tiktoken", f"{BASE}/byte_bpe_50k.json"


def test_lengths_by_both_encoders(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    texts = ["", "Hello, world!", "é中😀 it's 12 345", " \n\n x", "<|endoftext|>", "ab" * 30_000, "!" * 5000, "a b " * 3000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "doc_id long, text string, k int").repartition(3)
    got = {r["doc_id"]: r["n_tokens"] for r in C.encoded_lengths(df, RANKS, JSON).collect()}
    assert got == {**{i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}, len(texts): 0}


def test_limits_against_brute_force(spark):
    rng = random.Random(1)
    lengths = [rng.choice([0, 1, 5, 1023, 1024, 1025, rng.randrange(6000)]) for _ in range(800)]
    hist = C.histogram(spark.createDataFrame([(n,) for n in [*lengths, None]], "n_tokens long"))
    rows = {r["n_tokens"]: r for r in C.limits(hist).collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r["n_docs"] == lengths.count(n) and r["docs_at_least"] == sum(x >= n for x in lengths) and r["docs_over"] == sum(x > n for x in lengths)
        assert r["tokens_whole"] == sum(x for x in lengths if x <= n) and r["tokens_truncated"] == sum(min(x, n) for x in lengths)
        assert r["tokens_lost"] == sum(max(0, x - n) for x in lengths) and abs(r["quantile"] - sum(x <= n for x in lengths) / 800) < 1e-8
    assert C.quantile(hist, 0.5) == sorted(lengths)[399] and C.quantile(hist, 1.0) == max(lengths)
    assert C.truncated_total(hist, 2000) == sum(min(x, 2000) for x in lengths)
    empty = C.histogram(spark.createDataFrame([], "n_tokens long"))
    assert C.limits(empty).count() == 0 and C.quantile(empty, 0.5) is None and C.truncated_total(empty, 9) == 0
