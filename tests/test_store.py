"""The stored doc table and the passes over it on hand-made rows."""

import os

import pytest
from pyspark.sql import functions as F

from newslake.functions import urls as U
from newslake.operators import language as L, passes as PS, topics as TP
from newslake.operators.store import Conflict, Store

SCHEMA = "id string, origin string, title string"


def rows(df):
    return sorted((r["id"], r["origin"], r["title"]) for r in df.collect())


@pytest.fixture()
def store(spark, tmp_dir):
    s = Store(spark, tmp_dir + "/s")
    s.create(spark.createDataFrame([("a", "s1", "x"), ("b", "s1", "y"), ("c", "s2", "z"), ("d", None, "n")], SCHEMA))
    return s


def files(store):
    found = {}
    for part, folder in store.folders().items():
        path = folder.removeprefix("file:")
        found[part] = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path)}
    return found


def test_upsert_rewrites_named_sources_only(spark, store):
    before = files(store)
    batch = spark.createDataFrame([("a", "s1", "x2", 2), ("a", "s1", "x1", 1), ("e", "s3", "new", 1), ("d", None, "n2", 1)], SCHEMA + ", seq int")
    assert store.upsert(batch, "seq")
    assert rows(store.read()) == sorted([("a", "s1", "x2"), ("b", "s1", "y"), ("c", "s2", "z"), ("d", None, "n2"), ("e", "s3", "new")], key=lambda r: r)
    after = files(store)
    assert after["s2"] == before["s2"] and set(after["s1"]) != set(before["s1"])
    assert {r["id"]: r["seq"] for r in store.read().collect()} == {"a": 2, "b": None, "c": None, "d": 1, "e": 1}
    assert rows(store.read(["s2"])) == [("c", "s2", "z")]
    assert "s1" not in str(store.read(["s2"]).inputFiles())


def test_failed_write_leaves_the_old_version(spark, store, monkeypatch):
    old = rows(store.read())
    monkeypatch.setattr(Store, "_record", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        store.upsert(spark.createDataFrame([("a", "s1", "lost")], SCHEMA))
    monkeypatch.undo()
    assert rows(store.read()) == old and store.version() == 1
    assert store.upsert(spark.createDataFrame([("a", "s1", "kept")], SCHEMA)) and ("a", "s1", "kept") in rows(store.read())


def test_a_replayed_batch_changes_nothing(spark, store):
    first, second = spark.createDataFrame([("a", "s1", "one")], SCHEMA), spark.createDataFrame([("a", "s1", "two")], SCHEMA)
    assert store.upsert(first, stream="feed", batch_id=0) and store.upsert(second, stream="feed", batch_id=1)
    seen = (store.version(), rows(store.read()))
    assert not store.upsert(first, stream="feed", batch_id=0) and not store.upsert(second, stream="feed", batch_id=1)
    assert (store.version(), rows(store.read())) == seen
    assert not store.upsert(first.limit(0), stream="feed", batch_id=2) and rows(store.read()) == seen[1]


def test_two_writers(spark, store, monkeypatch):
    write = Store._write

    def meanwhile(self, df):
        monkeypatch.setattr(Store, "_write", write)
        store.upsert(spark.createDataFrame([("b", "s1", "other")], SCHEMA))
        return write(self, df)
    monkeypatch.setattr(Store, "_write", meanwhile)
    with pytest.raises(Conflict):
        store.upsert(spark.createDataFrame([("a", "s1", "mine")], SCHEMA))
    assert ("b", "s1", "other") in rows(store.read()) and ("a", "s1", "x") in rows(store.read())


def test_delete_and_empty(spark, store, tmp_dir):
    store.delete(spark.createDataFrame([("c", "s2", ""), ("a", "s1", "")], SCHEMA).select("id", "origin"))
    assert [r[0] for r in rows(store.read(["s1", "s2"]))] == ["b"] and "s2" not in store.folders()
    fresh = Store(spark, tmp_dir + "/t")
    none = spark.createDataFrame([], SCHEMA)
    assert fresh.version() == 0 and fresh.read(columns=none).count() == 0
    with pytest.raises(ValueError):
        fresh.read()
    assert not fresh.upsert(none)
    fresh.create(none)
    assert fresh.read().count() == 0 and fresh.upsert(spark.createDataFrame([("q", "odd / source=1 %", "t")], SCHEMA))
    assert rows(fresh.read(["odd / source=1 %"])) == [("q", "odd / source=1 %", "t")]


PARAGRAPH = "<p>" + "The people of the city thought about the bridge and the river for a long time. " * 15 + "</p>"


def stub(link, origin, text=None, topics=None):
    return (link, origin, text, None, topics)


@pytest.fixture(scope="module")
def how(spark):
    train = spark.createDataFrame([("en", "the people of the city and the river"), ("de", "die leute der stadt und der fluss")], "lang string, text string")
    models = {"m": TP.fixed_topic_model(spark, ["a", "b"], ["bridge", "river"], [[0.5, 0.0], [0.0, 0.1]], [0.0, 0.2])}
    return {"language": L.language_of(*L.fit_language_profiles(train)), "models": models}


def test_passes(spark, tmp_dir, how):
    kind = "link string, origin string, text string, tags array<string>, topics array<struct<label:string,score:double>>"
    links = [f"https://news.com/{i}" for i in range(6)]
    docs = spark.createDataFrame([stub(links[0], "f1"), stub(links[1], "f1", "already here", [("old", 1.0)]), stub(links[2], "f2"), stub("https://sourceforge.net/x", "f1")], kind).withColumn("id", U.doc_id("link"))
    pages = spark.createDataFrame([(0, links[0], PARAGRAPH), (1, links[2], "<p>Too short.</p>"), (2, links[3], PARAGRAPH), (3, "https://sourceforge.net/x", PARAGRAPH),
                                   (4, links[4], f"<meta http-equiv=refresh content=\"0; url={links[0]}\">")], "page_id int, link string, html string")
    store = Store(spark, tmp_dir + "/s")
    store.create(docs)
    got = {r["link"]: r for r in PS.content_pass(store, pages, ["f1"], **how).collect()}
    assert set(got) == {links[0], links[1], "https://sourceforge.net/x"}
    done = got[links[0]]
    assert done["lang"] == "en" and done["outcome"] == "successful" and done["text"].startswith("The people") and done["summary"]
    assert [t["label"] for t in done["topics"]] == ["a", "b"] and abs(sum(t["score"] for t in done["topics"]) - 100) < 1e-9 and done["topics"][0]["score"] > done["topics"][1]["score"]
    assert got[links[1]]["text"] == "already here" and [t["label"] for t in got[links[1]]["topics"]] == ["old"]
    assert got["https://sourceforge.net/x"]["text"] is None  # an excluded address

    f2 = store.folders()["f2"]
    entries = spark.createDataFrame([(links[3], "f1"), (links[4], "f1"), (links[0], "f1"), (links[5], "f2")], "link string, origin string").withColumn("id", U.doc_id("link"))
    got = {r["link"]: r for r in PS.source_refresh(store, "f1", entries, pages, **how).collect()}
    assert set(got) == {links[0], links[1], links[3], links[4], "https://sourceforge.net/x"}
    assert got[links[3]]["lang"] == "en" and len(got[links[3]]["topics"]) == 2
    assert got[links[4]]["text"] == got[links[0]]["text"]  # a refresh is followed, the doc keeps its id
    assert store.folders()["f2"] == f2 and store.read(["f2"]).first()["text"] is None

    everything = {r["link"]: r for r in PS.prediction_pass(store, how["models"]).collect()}
    assert [t["label"] for t in everything[links[1]]["topics"]] == ["a", "b"] and everything[links[2]]["topics"] is None
    version = store.version()
    again = {r["link"]: r["text"] for r in PS.source_refresh(store, "f1", entries, pages, **how).collect()}
    assert again == {k: r["text"] for k, r in got.items()} and store.version() >= version


def test_refresh_of_an_unknown_source_starts_it(spark, tmp_dir, how):
    store = Store(spark, tmp_dir + "/s")
    entries = spark.createDataFrame([("https://news.com/1", "f9")], "link string, origin string").select(
        "link", "origin", U.doc_id("link").alias("id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("tags"))
    pages = spark.createDataFrame([(0, "https://news.com/1", PARAGRAPH)], "page_id int, link string, html string")
    [r] = PS.source_refresh(store, "f9", entries, pages, **how).collect()
    assert r["outcome"] == "successful" and r["lang"] == "en"
