"""File sources (A1, A8), sinks and streams (M1, M4) on files written by the
tests into a temporary folder."""

import os

from pyspark.sql import functions as F

from newslake.sources import feeds as FD
from newslake.streaming import streams as ST

RSS = """<?xml version="1.0"?><rss><channel>
<item><title>First &amp; one</title><link>https://a.example/1?utm=x</link><description>d1</description>
<author>ann</author><pubDate>Mon, 11 Apr 2016 16:15:48 +0200</pubDate><category>News Tag</category>
<category>Other</category><source url="https://feed.example/rss">Feed</source></item>
<item><title>Second</title><link>https://a.example/2</link><description>d2</description></item>
</channel></rss>"""

ATOM = """<?xml version="1.0"?><feed>
<entry><title>E1</title><link href="https://b.example/e1"/><summary>s</summary><author><name>bob</name></author>
<updated>2016-04-11T16:15:48Z</updated><category term="t1"/><category term="t2"/></entry></feed>"""


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(text)


def test_read_rss_and_atom(spark, tmp_dir):
    _write(tmp_dir + "/rss", "a.xml", RSS)
    _write(tmp_dir + "/atom", "b.xml", ATOM)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rss = FD.normalize_entries(FD.require_entries(FD.read_feed(spark, tmp_dir + "/rss", "item")), "src", now)
    rows = {r["title"]: r for r in rss.collect()}
    assert rows["First & one"]["tags"] == ["News Tag", "Other"]
    assert rows["First & one"]["source"] == "https://feed.example/rss"
    assert str(rows["First & one"]["updated"]) == "2016-04-11 14:15:48"
    assert str(rows["Second"]["updated"]) == "2024-01-01 00:00:00"
    assert rows["Second"]["source"] == ""
    atom = FD.normalize_entries(FD.read_feed(spark, tmp_dir + "/atom", "entry"), "src", now, "entry").first()
    assert atom["tags"] == ["t1", "t2"] and atom["author"] == "bob" and atom["link"] == "https://b.example/e1"


def test_empty_feed_is_an_error(spark, tmp_dir):
    _write(tmp_dir + "/empty", "e.xml", "<rss><channel></channel></rss>")
    import pytest
    with pytest.raises(ValueError):
        FD.require_entries(FD.read_feed(spark, tmp_dir + "/empty", "item"))


def test_read_documents(spark, tmp_dir):
    _write(tmp_dir + "/docs", "a.html", "<html><body><p>Hello....world</p></body></html>")
    _write(tmp_dir + "/docs", "b.json", '{"k": 1}')
    _write(tmp_dir + "/docs", "c.txt", "   ")
    with open(os.path.join(tmp_dir, "docs", "d.pdf"), "wb") as f:
        f.write(b"%PDF-1.4 binary")
    got = {os.path.basename(r["link"]): (r["content_type"], r["text"], r["outcome"])
           for r in FD.read_documents(spark, tmp_dir + "/docs").collect()}
    assert got["a.html"] == ("text/html", "Hello world", "successful")
    assert got["b.json"][0] == "application/json"
    assert got["c.txt"][2] == "error: empty text"
    assert got["d.pdf"][0] == "application/pdf"


def test_tweets(spark):
    tw = spark.createDataFrame(
        [(1, "1", "hi #x https://t.co/a", 3, "en", ("bob",), ([("News Day",)], [("https://e.example/1",), ("https://e.example/2",)])),
         (2, "2", "no urls", 0, "en", ("amy",), ([], []))],
        FD.TWEET_SCHEMA.simpleString().replace("struct<", "", 1)[:-1].replace(":", " ").replace(
            "created_at string,", ""))
    out = {r["status_id"]: r for r in FD.tweets_to_docs(tw, "o").collect()}
    assert out["1"]["link"] == "https://e.example/2" and out["1"]["tags"] == ["_day"]
    assert out["1"]["summary"] == "hi #x" and out["1"]["occurences"] == 3
    assert out["2"]["link"] == "https://twitter.com/amy/status/2"


def test_feed_stream_equals_batch(spark, tmp_dir):
    for i in range(3):
        _write(tmp_dir + "/land", f"f{i}.xml", RSS.replace("a.example", f"a{i}.example"))
    stream = ST.feed_stream(spark, tmp_dir + "/land", "src", "item", max_files=1)
    ck = ST.checkpoint_path(spark, "test-feed")
    ST.run_available(stream.withColumn("o", F.struct(F.lit(0))), ck + "/out", ck + "/ckpt", output_mode="append")
    streamed = ST.read_batches(spark, ck + "/out")
    assert streamed.select("batch_id").distinct().count() == 3  # bounded batches (M7)
    batch = FD.normalize_entries(FD.read_feed(spark, tmp_dir + "/land"), "src", F.current_timestamp().cast("timestamp_ntz"))
    assert sorted(r["id"] for r in streamed.collect()) == sorted(r["id"] for r in batch.collect())


def test_dedup_stream(spark, tmp_dir):
    import datetime as dt
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 1, 1)),
                                ("b", dt.datetime(2024, 1, 2))], "id string, updated timestamp_ntz")
    df.write.parquet(tmp_dir + "/in")
    s = ST.file_stream(spark, tmp_dir + "/in", df.schema)
    ck = ST.checkpoint_path(spark, "test-dedup")
    ST.run_available(ST.dedup_first_seen(s), ck + "/out", ck + "/ckpt", output_mode="append")
    assert sorted(r["id"] for r in ST.read_batches(spark, ck + "/out").collect()) == ["a", "b"]


def _pdf(content, deflate=False):
    import zlib
    data = zlib.compress(content) if deflate else content
    return b"%PDF-1.4\n1 0 obj\n<< /Length 9 >>\nstream\n" + data + b"\nendstream\nendobj"


def test_response_types_and_texts(spark):
    rows = [("h", None, b"<!DOCTYPE html><body><p>caf\xc3\xa9</p><script>x</script></body>", "text/html", "café", "successful"),
            ("i", "text/html; charset=x", b"no tags at all", "text/html", "no tags at all", "successful"),
            ("j", None, b' {"k": "v \\"w\\"", "n": 1, "l": ["a", {"b": "c\\u00e9"}]}', "application/json", "v \"w\"\na\ncé", "successful"),
            ("j2", None, b"{not json", "text/plain", "{not json", "successful"),
            ("c.csv?x=1", None, b'a,"b ""q"" c"\r\n1;2', "text/csv", 'a b "q" c\n1 2', "successful"),
            ("c2", "text/csv", b"a\tb", "text/csv", "a b", "successful"),
            ("p1", None, _pdf(b"BT (Hello \\(you\\)) Tj 0 -10 Td [(wor) -20 (ld)] TJ ET"), "application/pdf", "Hello (you)\nworld", "successful"),
            ("p2", None, _pdf(b"BT (d\\351j\\340) Tj ET", True), "application/pdf", "déjà", "successful"),
            ("p3", None, b"%PDF-1.7 scanned", "application/pdf", "", "error: empty text"),
            ("z", None, b"PK\x03\x04...", "application/zip", None, "refused: archive"),
            ("b", None, b"bad \xff byte....", "text/plain", "bad � byte ", "successful"),
            ("e", None, b"", "text/plain", "", "error: empty text"), ("n", None, None, "text/plain", None, "error: empty text")]
    df = spark.createDataFrame([r[:3] for r in rows], "link string, header string, body binary")
    got = {r["link"]: (r["content_type"], r["text"], r["outcome"]) for r in FD.response_texts(df, header="header").collect()}
    assert got == {r[0]: r[3:] for r in rows}
    assert FD.response_texts(df.limit(0)).count() == 0


def _arrivals(spark, path, batches):
    """One file for each batch, in the order of arrival."""
    import datetime as dt
    for i, (day, rows) in enumerate(batches):
        df = spark.createDataFrame([(*r, dt.datetime(2024, 1, day)) for r in rows], "doc int, voter string, n int, landed timestamp")
        df.coalesce(1).write.parquet(f"{path}/{i}")
        os.utime(path, None)
    return ST.file_stream(spark, path + "/*", df.schema, "parquet", 1)


VOTES = [(1, [(d, v, 1) for d in range(20) for v in "ab"]), (2, [(d, "c", 2) for d in range(20)]), (9, [(1, "a", 3)]), (20, [(2, "b", 4), (1, "a", 2)])]


def test_state_expires_and_the_result_stays(spark, tmp_dir):
    """Days later the state holds the last votes only; a vote that returns is
    merged into the store; the stored result is that of all votes."""
    from newslake.operators.store import Store
    stream = _arrivals(spark, tmp_dir + "/in", VOTES)
    latest = ST.latest_per_key_stream(stream, ["doc", "voter"], ["n"], ["n"], arrival="landed")
    keyed = latest.withColumn("part", F.col("doc") % 3).withColumn("id", F.concat_ws("/", "doc", "voter"))
    store = Store(spark, tmp_dir + "/store", part="part")
    ck = ST.checkpoint_path(spark, "test-expiry")
    q = ST.run_into_store(keyed, store, "votes", ck)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(states) >= 40 and states[-1] <= 2  # the clock has passed the first days
    want = {}
    for _, rows in VOTES:
        for d, v, n in rows:
            want[d, v] = max(want.get((d, v), 0), n)
    assert {(r["doc"], r["voter"]): r["n"] for r in store.read().collect()} == want
    forever = ST.run_available(ST.latest_per_key_stream(stream, ["doc", "voter"], ["n"], ["n"]), tmp_dir + "/o", ST.checkpoint_path(spark, "test-forever"))
    assert [p["stateOperators"][0]["numRowsTotal"] for p in forever.recentProgress if p["stateOperators"]][-1] == 60


def test_resume_points_expire_and_never_go_back(spark, tmp_dir):
    from newslake.operators.store import Store
    stream = _arrivals(spark, tmp_dir + "/in", [(1, [(1, "a", 10), (2, "b", 5)]), (5, [(1, "a", 7)]), (9, [(3, "c", 1)])])
    marks = ST.resume_points(stream, "doc", "n", arrival="landed").withColumn("part", F.lit("all"))
    store = Store(spark, tmp_dir + "/store", part="part", key="doc")
    q = ST.run_into_store(marks, store, "marks", ST.checkpoint_path(spark, "test-marks"))
    assert [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1] <= 1
    assert {r["doc"]: r["since_id"] for r in store.read().collect()} == {1: 10, 2: 5, 3: 1}
    version = store.version()
    ST.store_sink(store, "marks")(store.read().withColumn("since_id", F.lit(0).cast("bigint")), 0)  # a replayed batch
    assert store.version() == version and {r["doc"]: r["since_id"] for r in store.read().collect()} == {1: 10, 2: 5, 3: 1}
