"""Column functions on hand-made edge rows, checked against plain Python."""

import datetime as dt
import hashlib
import urllib.parse

import pytest
from pyspark.sql import functions as F

from newslake.functions import dates as D
from newslake.functions import text as T
from newslake.functions import urls as U


def py_quote(s, safe="/"):
    # The reference's quote kept letters, digits, _ . - (and ``safe``); ~ is encoded.
    return urllib.parse.quote(s, safe=safe).replace("~", "%7E")


def py_doc_id(link):
    if "//" in link:
        p = urllib.parse.urlparse(link)
        basis = p.scheme + "://" + p.netloc + p.path
    else:
        basis = link
    return hashlib.md5(py_quote(basis).encode()).hexdigest()


LINKS = [
    "https://example.com/a/b",
    "no-slashes-here",
    "https://example.com/a?x=1#frag",
    "https://example.com/a?x=2",
    "http://Example.com/with space/and%20pct",
    "HTTPS://host.org/p;params",
    "https://host.org/a;x/b",
    "ftp://files.example.net/~user/file.tar.gz",
    "https://müller.example/ümlaut?q=1",
]


def test_doc_id_matches_python(spark):
    df = spark.createDataFrame([(x,) for x in LINKS], "link string")
    got = {r["link"]: r["id"] for r in df.select("link", U.doc_id("link").alias("id")).collect()}
    for link in LINKS:
        assert got[link] == py_doc_id(link), link


def test_same_link_different_query_same_id(spark):
    df = spark.createDataFrame([(LINKS[2],), (LINKS[3],)], "link string")
    ids = {r[0] for r in df.select(U.doc_id("link")).collect()}
    assert len(ids) == 1


@pytest.mark.parametrize("s", ["a b/c", "x*y~z+w", "ä/ö?&=", "plain"])
def test_quote_family(spark, s):
    r = spark.createDataFrame([(s,)], "s string").select(
        U.quote("s").alias("q"), U.quote_plus("s").alias("qp"), U.unquote(U.quote("s")).alias("rt")).first()
    assert r["q"] == py_quote(s)
    assert r["qp"] == urllib.parse.quote_plus(s, safe="").replace("~", "%7E")
    assert r["rt"] == s


def test_unquote_keeps_plus(spark):
    r = spark.createDataFrame([("a+b%20c",)], "s string").select(U.unquote("s")).first()[0]
    assert r == "a+b c"


def test_normalize_tag(spark):
    rows = [("  World News ",), ("Café au lait",), ("NEWS",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.normalize_tag("t")).collect()]
    assert got == ["world_", "caf_au_lait", "", None]


def test_merge_tags(spark):
    df = spark.createDataFrame([(["a", "b"], ["c", "a", "c"]), (None, ["x"]), (["y"], None)],
                               "s array<string>, n array<string>")
    from newslake.operators.sets import merge_tags
    got = [r[0] for r in df.select(merge_tags("s", "n")).collect()]
    assert got == [["a", "b", "c"], ["x"], ["y"]]


def test_display_fallbacks(spark):
    df = spark.createDataFrame([("Tiny", "abc", None), ("Long title", None, "me"), (None, "A real summary", None)],
                               "title string, summary string, author string")
    got = df.select(T.title_or("title", "summary"), T.summary_or("summary"), T.author_or("author")).collect()
    assert [tuple(r) for r in got] == [("No summary", "No summary", "unknown"),
                                       ("Long title", "No summary", "me"),
                                       ("A real summary", "A real summary", "unknown")]


def test_date_math(spark):
    now = dt.datetime(2024, 3, 15, 13, 45, 10)
    df = spark.createDataFrame([(now,)], "now timestamp_ntz")
    cases = {"now-7d": dt.datetime(2024, 3, 8, 13, 45, 10), "now-4h": dt.datetime(2024, 3, 15, 9, 45, 10),
             "now-1d/d": dt.datetime(2024, 3, 14), "now/d": dt.datetime(2024, 3, 15),
             "now-1M/d": dt.datetime(2024, 2, 15), "now-1y/d": dt.datetime(2023, 3, 15)}
    r = df.select(*[D.date_math(k, F.col("now")).alias(str(i)) for i, k in enumerate(cases)]).first()
    assert list(r) == list(cases.values())
    with pytest.raises(ValueError):
        D.date_math("now-7x", F.col("now"))


def test_parse_updated_drops_zone(spark):
    df = spark.createDataFrame([("2016-04-11T16:15:48+0200",), ("junk",)], "s string")
    got = [r[0] for r in df.select(D.parse_updated("s")).collect()]
    assert got == [dt.datetime(2016, 4, 11, 16, 15, 48), None]


HTML = ("<html><head><title>T &amp; U</title><meta name=\"keywords\" content=\"a, b ,,c\">"
        "<meta http-equiv=\"Refresh\" content=\"5;url=https://next.example/x\"></head>"
        "<body><!-- hidden --><script>var t=\"</p>\";</script><p>One <b>two<p>three &amp; four"
        "<style>p{}</style></body></html>")


def test_html_functions(spark):
    df = spark.createDataFrame([(HTML,)], "html string")
    r = df.select(T.visible_text("html").alias("vt"), T.html_title("html").alias("t"),
                  T.meta_keywords("html").alias("k"), U.meta_refresh_target("html").alias("r")).first()
    assert r["vt"] == "One\r\ntwo\r\nthree & four"
    assert r["t"] == "T & U"
    assert r["k"] == ["a", "b", "c"]
    assert r["r"] == "https://next.example/x"


@pytest.mark.parametrize("text,expected", [
    ("nothing here", []), ("see cve-2021-1234 now", ["cve-2021-1234"]),
    ("CVE-2020-0001\nCVE-2020-00002 and CVE-2019-99999", ["CVE-2020-0001", "CVE-2020-00002", "CVE-2019-99999"]),
])
def test_extract_rules(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(*T.extract_rules("text")).first()["cve"] == expected


def test_prediction_input_removes_every_url(spark):
    text = "\n".join(f"https://u{i}.example/x" for i in range(12)) + "\nbody http://in.line/sentence end"
    df = spark.createDataFrame([("Title", None, text)], "title string, summary string, text string")
    out = df.select(T.prediction_input("title", "summary", "text")).first()[0]
    assert "http" not in out and out.startswith("Title\r\n") and "body" in out


@pytest.mark.parametrize("text,cmd,target,valid", [
    ("/follow @someone", "follow", "@someone", True),
    ("/follow someone", "follow", "someone", False),
    ("/watch@newslakebot big news", "watch", "big news", True),
    ("/watch@otherbot big news", None, None, False),
    ("/teach https://x.example/a k1, k2", "teach", "https://x.example/a", True),
    ("/digest", "digest", None, True),
    ("hello /follow @x", None, None, False),
])
def test_parse_command(spark, text, cmd, target, valid):
    r = spark.createDataFrame([(text,)], "text string").select(T.parse_command("text").alias("c")).first()["c"]
    assert (r["command"], r["target"], r["valid"]) == (cmd, target, valid)
    if cmd == "teach":
        assert r["keywords"] == ["k1", " k2"]  # split as given, like the reference


def test_url_predicates(spark):
    rows = [("https://ok.example.com/a",), ("http://sourceforge.net/x",), ("https://a.example/f.zip?x=1",),
            ("not a url",), ("http://localhost:8080/p",)]
    df = spark.createDataFrame(rows, "u string")
    got = [tuple(r) for r in df.select(U.is_valid_url("u"), U.not_excluded_uri("u"), U.not_excluded_type("u")).collect()]
    assert got == [(True, True, True), (True, False, True), (True, True, False), (False, True, True),
                   (True, True, True)]


def test_domain_fallback(spark):
    df = spark.createDataFrame([("https://a.b/c", "s"), ("no-url", "src")], "l string, s string")
    assert [r[0] for r in df.select(U.domain("l", "s")).collect()] == ["a.b", "src"]


def test_rules_map(spark):
    df = spark.createDataFrame([("CVE-2020-0001 and a@b.example",)], "text string")
    m = df.select(T.rules_map("text", {"cve": r"CVE-[0-9]{4}-[0-9]{4,}", "email": r"[a-z]+@[a-z.]+"})).first()[0]
    assert m == {"cve": ["CVE-2020-0001"], "email": ["a@b.example"]}


def test_eventlog_summary(tmp_dir):
    """Per-query figures from a (hand-written) Spark event log."""
    import json
    import os
    from newslake.eventlog import summarize
    os.makedirs(tmp_dir + "/app", exist_ok=True)
    events = [
        {"Event": "SparkListenerJobStart", "Stage IDs": [1, 2], "Properties": {"spark.jobGroup.id": "q1"}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 1,
         "Task Info": {"Launch Time": 1000, "Finish Time": 3000},
         "Task Metrics": {"Shuffle Write Metrics": {"Shuffle Bytes Written": 2_000_000},
                          "Shuffle Read Metrics": {"Remote Bytes Read": 0, "Local Bytes Read": 0}}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 2,
         "Task Info": {"Launch Time": 0, "Finish Time": 500},
         "Task Metrics": {"Shuffle Read Metrics": {"Remote Bytes Read": 1_000_000, "Local Bytes Read": 1_000_000}}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 9, "Task Info": {}, "Task Metrics": {}},
    ]
    with open(tmp_dir + "/app/events_1", "w") as f:
        f.write("\n".join(json.dumps(e) for e in events))
    assert summarize(tmp_dir) == {"q1": {"shuffle_write_mb": 2.0, "shuffle_read_mb": 2.0, "tasks": 2, "task_sec": 2.5}}
