import os
import random

from newslake.llm import decontam, pii, sentencepiece_codec, toxicity
from tests.llm import brute
from tests.llm.test_decontam import brute as leaks
import corpus_pipeline as P

MODEL = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")


def write(spark, base):
    rng = random.Random(3)
    vocab = [f"wo{i}rd" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(25))) for i in range(5)]
    docs = []
    for i in range(400):
        w = [rng.choice(vocab) for _ in range(rng.randrange(40, 200))]
        if i % 10 == 1:
            w.insert(3, "vilezor")
        if i % 10 == 2:
            w[5:5] = items[i % 5][1].split()
        if i % 10 == 3:
            w += [f"user{i}@mail.example.com", "+1 (555) 123-4567"]
        docs.append((i, " ".join(w), "en", "s", 0))
    docs += [(500 + i, docs[i * 7][1] + (" tail" if i % 2 else ""), "en", "t", 0) for i in range(40)]
    docs += [(600, None, None, None, None), (601, "", "en", "s", 0), (602, None, "de", "s", 0), (None, "no id here", "en", "s", 0), (9, "second row of an id", "en", "s", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 1)) for i in range(0, 400)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return docs, items


def test_run_against_brute_force(spark, tmp_dir):
    docs, items = write(spark, tmp_dir)
    out = P.run(spark, tmp_dir)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids"]
    rows = out.collect()
    kept = [d for d in docs if "vilezor" not in (d[1] or "")]
    # Rows that repeat an id are one document; the row with the smallest text stays.
    label = brute.jaccard_components([(i if i is not None else f"n{n}", t) for n, (i, t, *_) in enumerate(kept) if i != 9])
    kept = [d for d in kept if d[0] in (9, None) or label[d[0]][1] == d[0]]
    seven = sorted((d for d in kept if d[0] == 9), key=lambda d: d[1])
    kept = [d for d in kept if d[0] != 9] + seven[:1]
    lost = {d for d, _ in leaks([(d[0], d[1]) for d in kept], items, 5, 80)}
    kept = [d for d in kept if d[0] not in lost]
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d[0]) for d in kept)
    by = {r["doc_id"]: r for r in rows}
    v = sentencepiece_codec.Vocabulary.load(MODEL)
    import pyarrow as pa
    ids = sentencepiece_codec.encode_column(v, pa.array([r["text"] for r in rows], pa.string())).to_pylist()
    assert [r["token_ids"] for r in rows] == ids
    for d in kept:
        spans = pii.detect(d[1])
        r = by[d[0]]
        if not spans:
            assert r["text"] == d[1]
        else:
            assert len(spans) == 2 and "@mail.example.com" not in r["text"]
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)


def test_stages():
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii_surrogates", "sentencepiece"]


def test_only_rows_at_fault_are_dropped(spark, tmp_dir):
    rng = random.Random(4)
    text = lambda n=80: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    item, article, other, near = text(25), text(), text(), text()
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    rows = [(9, None, "a"), (9, article, "a"), (8, " \n", "a"), (8, other, "a"), (8, "", "b"),
            (1, near, "a"), (7, near + " tail", "b"), (7, None, "b"),  # a copy goes, the null text beside it stays
            (30, near.replace("w", "y"), "a"), (30, "a", "a"), (40, near.replace("w", "y"), "a"),  # 30 is the row "a", so 40 has no copy
            (None, "x " + item, "a"), (None, text(), "a"), (None, text(), "b"), (None, None, "a"), (None, near, "c")]
    schema = "doc_id long, text string, source string"
    df = spark.createDataFrame(rows, schema).repartition(4)
    want = [r for r in rows if r not in (rows[6], rows[8])]
    one = P.one_of_each_group(spark, df, tmp_dir)
    key = lambda r: tuple(map(str, r))
    assert one.columns == df.columns  # a stage adds no column
    assert sorted((tuple(r) for r in one.collect()), key=key) == sorted(want, key=key)
    one.write.parquet(f"{tmp_dir}/one")
    for docs in (spark.read.parquet(f"{tmp_dir}/one"), spark.createDataFrame(want, schema)):  # read and not read
        out = P.drop_contaminated(spark, docs, tmp_dir)
        assert out.columns == ["doc_id", "text", "source"]
        assert sorted((tuple(r) for r in out.collect()), key=key) == sorted((r for r in want if r != rows[11]), key=key)


CLASHES = ["score", "Group_Id", "row_key", "n_entities", "token_ids", "_score", "_row", "_key", "attempts", "text_key", "node", "u", "n"]


def test_columns_with_the_names_of_helpers(spark, tmp_dir):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(80))
    rows = [(i, t, *["own"] * len(CLASHES)) for i, t in ((1, text), (2, text), (3, "mail x@y.org " * 30), (4, None), (5, ""), (6, "w" * 300_000))]
    spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([(0, "a b c d e f g h")], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    out = P.run(spark, tmp_dir)
    assert out.columns == ["doc_id", "text", *[c for c in CLASHES if c != "token_ids"], "token_ids"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {1, 3, 4, 5, 6} and "x@y.org" not in got[3]["text"]
    assert all(r[c] == "own" for r in got.values() for c in CLASHES if c != "token_ids") and len(got[1]["token_ids"]) > 80


def test_empty_tables(spark, tmp_dir):
    docs, items = write(spark, f"{tmp_dir}/full")
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for empty, rows in (("documents", 0), ("others", None)):
        base = f"{tmp_dir}/{empty}"
        for t, schema in schemas.items():
            none = (t == "documents") == (empty == "documents")
            (spark.createDataFrame([], schema) if none else spark.read.parquet(f"{tmp_dir}/full/{t}.parquet")).write.parquet(f"{base}/{t}.parquet")
        out = P.run(spark, base)
        # Without labels nothing is toxic, without a benchmark nothing is contaminated: copies alone go.
        assert out.count() == (0 if rows == 0 else len({d[1] for d in docs if d[1] and d[0] != 9 and d[0] is not None and not d[1].endswith(" tail")}) + 5)
