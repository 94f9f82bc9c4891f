"""Work that must not grow faster than the tables: where it sits in the plans."""

import os

from pyspark.sql import functions as F

from newslake.operators import postings as PO, topics as TP
from newslake.plans import q_streams
from newslake.sources import fixtures as FX
from newslake.streaming import streams as S
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_titles_and_tags_come_after_the_joins(spark):
    docs = FX.build_docs(spark, SF_SMALL)
    text = plan(docs.filter(F.col("updated") > "2024-01-20").select("id", "title", "tags"))
    assert "pythonUDF" in text or "ArrowEvalPython" in text
    assert text.index("ArrowEvalPython") < text.index("Join")


def test_tags_by_hand(spark):
    rows = [(1, "The the THE cat-s cat, cats of to\tzebra\nzebra a1b2c é ab"), (2, None), (3, ""), (4, "bb aaa ccc ddd eee fff ggg hhh iii jjj iii"), (5, "naïve naive\x0bx")]
    got = {r["id"]: r["t"] for r in spark.createDataFrame(rows, "id int, text string").select("id", FX.fixture_tags(F.col("text")).alias("t")).collect()}
    assert got == {1: ["abc", "cat", "cats", "the", "zebra"], 2: [], 3: [], 4: ["aaa", "ccc", "ddd", "eee", "fff", "ggg", "hhh", "iii"], 5: ["naivex", "nave"]}


def test_postings_are_grouped_without_a_generator(spark):
    docs = spark.createDataFrame([(1, "b a b", "Äb b"), (2, None, None), (3, "", "a")], "id int, title string, text string")
    posts = PO.postings_of(docs, ["title", "text"], "id")
    assert "MapInArrow" in plan(posts) and "Generate" not in plan(posts)
    got = sorted((r["term"], r["id"], r["tf"], r["dl"], r["starts"], r["pos"]) for r in posts.collect())
    assert got == [("a", 1, 1, 5, [0, 4, 7], [1]), ("a", 3, 1, 1, [0, 1, 3], [1]), ("b", 1, 3, 5, [0, 4, 7], [0, 2, 5]), ("äb", 1, 1, 5, [0, 4, 7], [4])]


def test_a_training_set_derives_the_tags_once(spark):
    docs = spark.createDataFrame([(i, str(i), "en", "x" * 600, "t", None, None, ["the", "and"]) for i in range(9)],
                                 "doc_id long, id string, lang string, text string, title string, summary string, author string, tags array<string>")
    ts = TP.training_set(docs, FX.models(spark), FX.topics(spark))
    assert plan(ts).count("LogicalRDD") == 1  # the texts; tags and picked ids are stored
    assert {(r["model"], r["topic"], r["doc_id"]) for r in ts.collect()} == {("alpha", t, i) for t in ("articles", "joins") for i in range(9)}


def test_batches_of_a_stream_do_not_grow_with_its_files(spark, tmp_dir):
    spark.range(800).withColumnRenamed("id", "event_id").repartition(8).write.parquet(os.path.join(tmp_dir, "events.parquet"))
    stream = q_streams._stream(spark, tmp_dir, "events", "event_id")
    S.run_available(stream, tmp_dir + "/out", tmp_dir + "/ckpt", output_mode="append")
    out = S.read_batches(spark, tmp_dir + "/out")
    assert sorted((r["batch_id"], r["arrival"], r["count"]) for r in out.groupBy("batch_id", "arrival").count().collect()) == [(i, i, 200) for i in range(4)]


def test_top_words_are_counted_in_batches(spark):
    from newslake.operators import text as X
    rows = [(1, "Zoo zoo ant; ANT the the the of été l'Été x2yy 日本語 日本語 äbc"), (2, ""), (3, None), (4, "the of 12"), (5, " bee bee bee cat dog cat dog eel")]
    df = spark.createDataFrame(rows, "id int, text string")
    tops = df.select("id", X.top_words("text", k=4).alias("w"))
    assert "ArrowEvalPython" in plan(tops)
    got = {r["id"]: r["w"] and [(x["n"], x["token"]) for x in r["w"]] for r in tops.collect()}
    assert got == {1: [(2, "ant"), (2, "zoo"), (2, "été"), (2, "日本語")], 2: None, 3: None, 4: None, 5: [(3, "bee"), (2, "cat"), (2, "dog"), (1, "eel")]}
    slow = X.most_frequent(F.filter(X.words("text"), lambda w: (F.length(w) >= 3) & ~w.isin(X.STOP_WORDS)), 10)
    assert df.filter(~slow.eqNullSafe(X.top_words("text"))).count() == 0
    assert {(r["id"], r["token"], r["rank"]) for r in X.keywords(df, "id", k=1).collect()} == {(1, "ant", 1), (5, "bee", 1)}
    assert {r["id"]: r["tags"] for r in X.keyword_tags(df, "id", k=1).collect()} == {1: ["ant"], 5: ["bee"]}
