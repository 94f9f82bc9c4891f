"""Operators on hand-made rows, checked against brute force in Python."""

import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from newslake.operators import graph as G
from newslake.operators import joins as J
from newslake.operators import sets as S
from newslake.operators import topics as TP
from newslake.operators import windows as W
from newslake.operators import writes as WR


def brute_quotas(limit, tags):
    """tags: list of (tag, n_docs, eligible) -> {tag: (quota, taken)}."""
    tags = sorted(tags, key=lambda t: (t[1], t[0]))
    base = limit // len(tags)
    carry = limit - base * len(tags)
    out = {}
    for tag, _, eligible in tags:
        quota = base + carry
        taken = min(eligible, quota)
        out[tag] = (quota, taken)
        carry = max(0, quota - taken)
    return out


@settings(max_examples=15, deadline=None)
@given(limit=st.integers(1, 200),
       sizes=st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=6))
def test_tag_quotas_property(spark, limit, sizes):
    tags = [(f"t{i}", max(n, e), min(n, e)) for i, (n, e) in enumerate(sizes)]
    inv = spark.createDataFrame([("m", "topic", limit, t, n, e) for t, n, e in tags],
                                "model string, topic string, limit int, tag string, n_docs bigint, n_eligible bigint")
    got = {r["tag"]: (r["quota"], r["taken"]) for r in W.tag_quotas(inv).collect()}
    assert got == brute_quotas(limit, tags)
    assert sum(t for _, t in got.values()) <= limit


def test_tag_quotas_no_tags_gives_no_rows(spark):
    inv = spark.createDataFrame([], "model string, topic string, limit int, tag string, n_docs bigint, n_eligible bigint")
    assert W.tag_quotas(inv).count() == 0


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, id string, lang string, title string, summary string, "
                                       "author string, text string, tags array<string>")


def test_training_set_edges(spark):
    long_en = "x" * 600
    rows = [(1, "a", "en", "t1", None, None, long_en, ["red", "blue"]),   # two tags of one topic
            (2, "b", "en", "t2", None, None, long_en, ["blue"]),
            (3, "c", "de", "t3", None, None, long_en, ["blue"]),           # wrong language
            (4, "d", "en", "t4", None, None, "short", ["blue"]),          # too short
            (5, "e", "en", "t5", None, None, long_en, ["blue"])]
    docs = _docs(spark, rows)
    topics = spark.createDataFrame([("topic:c", "colors", ["none", "red", "blue"]), ("topic:e", "empty", [])],
                                   "id string, title string, tags array<string>")
    models = spark.createDataFrame([("model:m", "m", ["colors", "empty"], 5, "en")],
                                   "id string, title string, related_topics array<string>, limit int, lang string")
    q = {r["tag"]: (r["quota"], r["taken"]) for r in TP.training_quotas(docs, models, topics).collect()}
    # 'none' has no docs and passes its quota on; order: none(0), red(1), blue(5)
    assert q == {"none": (3, 0), "red": (4, 1), "blue": (4, 3)}
    ts = TP.training_set(docs, models, topics).collect()
    ids = sorted(r["doc_id"] for r in ts)
    assert ids == [1, 2, 5]  # doc 1 via red and blue written once
    assert all(r["text"].startswith("\r\n") for r in ts)


def test_upsert_idempotent_and_latest(spark):
    base = spark.createDataFrame([("a", "old", 0), ("b", "keep", 0)], "id string, v string, seq int")
    batch = spark.createDataFrame([("a", "new", 1), ("c", "add", 1)], "id string, v string, seq int")
    once = WR.upsert(base, batch)
    twice = WR.upsert(once, batch)
    expect = {("a", "new"), ("b", "keep"), ("c", "add")}
    assert {(r["id"], r["v"]) for r in once.collect()} == expect
    assert {(r["id"], r["v"]) for r in twice.collect()} == expect


def test_votes_same_voter_twice_and_unknown_doc(spark):
    docs = spark.createDataFrame([("d1",)], "id string")
    votes = spark.createDataFrame([
        ("d1", "u1", 2, dt.datetime(2024, 1, 1), 1), ("d1", "u1", 0, dt.datetime(2024, 1, 2), 2),
        ("zz", "u2", 1, dt.datetime(2024, 1, 1), 3)],
        "id string, voter string, score int, ts timestamp_ntz, event_id long")
    got = {(r["id"], r["voter"]): (r["score"], r["outcome"]) for r in J.apply_votes(docs, votes).collect()}
    assert got == {("d1", "u1"): (0, "successful"), ("zz", "u2"): (1, "failed: unknown doc")}


def test_merge_fields_and_delete(spark):
    base = spark.createDataFrame([("a", "s1", "x"), ("b", "s2", "y")], "id string, summary string, author string")
    patch = spark.createDataFrame([("a", "new", None)], "id string, summary string, author string")
    got = {r["id"]: (r["summary"], r["author"]) for r in WR.merge_fields(base, patch).collect()}
    assert got == {"a": ("new", "x"), "b": ("s2", "y")}
    ids = spark.createDataFrame([("a",)], "id string")
    assert [r["id"] for r in WR.delete(base, ids).collect()] == ["b"]


def test_apply_content_outcomes(spark):
    docs = spark.createDataFrame([("a", None, ["t"]), ("b", None, None), ("c", "kept", ["k"])],
                                 "id string, text string, tags array<string>")
    content = spark.createDataFrame([("a", "y" * 1001, "T", None, None, "en", "text/html", ["t", "n"]),
                                     ("b", "short", "T", None, None, "en", "text/html", None)],
                                    "id string, text string, title string, summary string, html string, "
                                    "lang string, content_type string, tags array<string>")
    got = {r["id"]: (r["outcome"], r["tags"]) for r in J.apply_content(docs, content).collect()}
    assert got == {"a": ("successful", ["t", "n"]), "b": ("failed: text too small", None),
                   "c": ("unchanged", ["k"])}


def test_graph_same_title_merge_and_no_author(spark):
    tree = spark.createDataFrame([
        ("lab", 2, 1, "tag", 1, 2, "https://s.example/1", 1, 1, "h1", "Same", None, "rss", None, None),
        ("lab", 2, 1, "tag", 1, 2, "no-url", 1, 2, "h2", "Same", "auth", "rss", None, "fallback"),
    ], "topic string, topic_count long, topic_rank int, tag string, tag_rank int, tag_count long, link string, "
       "link_count long, link_rank int, hit_id string, title string, author string, source_type string, "
       "summary string, source string")
    nodes = {r["id"]: r for r in G.graph_nodes(tree).collect()}
    assert set(nodes) == {"lab", "tag", "Same", "s.example", "fallback", "auth"}
    assert nodes["Same"]["visits"] == 2 and nodes["Same"]["url"] == "https://s.example/1"
    edges = {r["id"]: r["weight"] for r in G.graph_edges(tree).collect()}
    assert edges == {"s.example_Same": 1, "fallback_auth": 1, "auth_Same": 1, "lab_Same": 20, "tag_Same": 6}


@settings(max_examples=10, deadline=None)
@given(a=st.lists(st.sampled_from("abcde"), max_size=5), b=st.lists(st.sampled_from("abcdef"), max_size=5))
def test_merge_tags_superset(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    out = df.select(S.merge_tags("a", "b")).first()[0]
    assert out[: len(a)] == a and set(out) == set(a) | set(b)


def test_bm25_stored_stats_equal_on_the_fly(spark, tmp_dir):
    from newslake.operators import search as SE
    from newslake.sources import fixtures as FX
    docs = FX.docs(spark, "/root/testdata/sf0.001").select("doc_id", "title", "summary", "text")
    fields = ["title", "summary", "text"]
    SE.write_term_stats(docs, tmp_dir + "/stats", fields)
    stats = SE.read_term_stats(spark, tmp_dir + "/stats")
    a = {r["doc_id"]: round(r["score"], 9) for r in SE.bm25(docs, "the anea", fields).collect()}
    b = {r["doc_id"]: round(r["score"], 9) for r in SE.bm25(docs, "the anea", fields, stats=stats).collect()}
    assert a == b and len(a) > 0


def test_train_net_and_trees(spark):
    """The network (layers sized from the fitted vocabulary) and the
    tree trainer both fit and predict every class."""
    words = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot"]
    rows = []
    for i in range(60):
        cls = "a" if i % 2 else "b"
        vocab = words[:3] if cls == "a" else words[3:]
        rows.append((i, None, None, " ".join(vocab[(i + k) % 3] for k in range(12)), cls))
    df = spark.createDataFrame(rows, "doc_id long, title string, summary string, text string, topic string")
    for kind, extra in [("net", {"layers": [8], "iterations": 20, "min_count": 2}),
                        ("trees", {"num_trees": 5, "iterations": 5, "min_count": 2})]:
        params = TP.trainer_profile(kind, 2, test_split=0.2, **extra)
        model, test = TP.train_topic_model(df, kind, params)
        pred = TP.predict_topics(df.limit(5), {"m": model}).collect()
        assert all(len(r["topics"]) == 2 for r in pred)
        assert TP.labels_of(model) == ["a", "b"]


def test_spread_only_widens_narrow_inputs(spark):
    from newslake.operators.partitioning import spread
    import tempfile
    target = spark.sparkContext.defaultParallelism
    path = tempfile.mkdtemp() + "/one"
    spark.range(100).coalesce(1).write.parquet(path)
    narrow = spark.read.parquet(path)
    assert narrow.rdd.getNumPartitions() == 1
    assert spread(narrow).rdd.getNumPartitions() == target
    shuffled = spark.range(100).repartition(target + 3)
    assert spread(shuffled) is shuffled  # plans with an exchange are left alone


def test_topic_stats_edges(spark):
    """E2 / E7 / G2 with null, empty and tied topics."""
    from newslake.functions.text import mean_topic_score
    from newslake.operators import aggregates as A
    t = "array<struct<label:string,score:double>>"
    docs = spark.createDataFrame([
        ("a", "s1", [("x", 50.0), ("y", 50.0)], dt.datetime(2024, 1, 2)),
        ("b", "s1", [], dt.datetime(2024, 1, 3)),
        ("c", "s2", None, dt.datetime(2024, 1, 4)),
        ("d", "s2", [("x", 10.0)], dt.datetime(2024, 1, 1)),
        ("e", "s2", [("x", 50.0)], dt.datetime(2024, 1, 2)),
    ], f"id string, origin string, topics {t}, updated timestamp_ntz")
    stats = {(r["origin"], r["label"]): (r["doc_count"], r["label_count"], r["avg_score"])
             for r in A.topic_stats(docs).collect()}
    assert stats == {("s1", "x"): (1, 1, 50.0), ("s1", "y"): (1, 1, 50.0), ("s2", "x"): (2, 2, 30.0)}
    means = {r["id"]: r["m"] for r in docs.select("id", mean_topic_score("topics").alias("m")).collect()}
    assert means == {"a": 50.0, "b": None, "c": None, "d": 10.0, "e": 50.0}
    order = [r["id"] for r in W.best_topic_first(docs.withColumn("score", F.lit(1.0))).collect()]
    assert order == ["a", "e", "d", "c", "b"]  # ties: updated desc, then id


def test_conform_schema_defaults_and_extra(spark):
    from newslake import schema as SC
    df = spark.createDataFrame([("s1", None, "x")], "id string, active boolean, surprise string")
    out = SC.conform(df, SC.SOURCES, SC.DEFAULTS["sources"], keep_extra=True)
    r = out.first()
    assert out.columns == SC.SOURCES.fieldNames() + ["extra"]
    assert (r["id"], r["active"], r["predict"], r["enable_content"]) == ("s1", False, True, True)
    assert r["extra"] == '{"surprise":"x"}'


def test_top_k_per_beyond_the_group_limit(spark, monkeypatch):
    """Limits over Spark's own bound rank in two steps, with the same rows."""
    from pyspark.sql import functions as F
    from newslake.operators import windows
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).repartition(7)
    want = windows.top_k_per(df, ["k"], F.col("v").desc(), 40, "rn").collect()
    monkeypatch.setattr(windows, "GROUP_LIMIT", 10)
    got = windows.top_k_per(df, ["k"], F.col("v").desc(), 40, "rn").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 120


def test_plans_are_read_by_their_nodes(spark, tmp_dir):
    """Names of paths and columns don't count; rows of an explode are counted."""
    from newslake.operators import broadcast as B
    from newslake.operators.partitioning import plan_nodes, spread
    spark.range(10).select(F.col("id").alias("JoinSortWindow")).coalesce(1).write.parquet(tmp_dir + "/Aggregate Union")
    df = spark.read.parquet(tmp_dir + "/Aggregate Union")
    assert not any(n.startswith(("Join", "Sort", "Window", "Aggregate", "Union")) for n in plan_nodes(df))
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "Subquery" in plan_nodes(df.filter(F.col("JoinSortWindow") > df.agg(F.min("JoinSortWindow")).scalar()))
    wide = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(5000))).alias("x"))
    assert B.is_bounded(wide) and not B.is_bounded(wide, max_rows=4999) and B.is_bounded(spark.range(5000), max_rows=10)
