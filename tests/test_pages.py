"""Page text, dates, formulas and search terms against values written by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newslake.functions import dates, text as T
from newslake.operators import predicates as P, search as S, text as X


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


HEADER = "<html><head><title>caf&eacute; &#8217;s</title></head><body><header>Top</header><p>The main paragraph.</p><script>var a='</p>';</script><p>Tail</p></body></html>"


def test_header_does_not_swallow_text(spark):
    assert one(spark, HEADER, T.visible_text) == "Top\r\nThe main paragraph.\r\nTail"


@pytest.mark.parametrize("source, want", [
    ("caf&eacute; &#8217; &#x1F600; &amp;lt; &unknown; &", "café ’ 😀 &lt; &unknown; &"),
    ("a&nbsp;b&hellip;&copy;&middot;", "a b…©·"), ("&#0; &#1114112;", "&#0; &#1114112;"), ("no entity", "no entity"), ("", "")])
def test_entities(spark, source, want):
    assert one(spark, source, T.decode_entities) == want


@pytest.mark.parametrize("page, want", [
    ("<meta name=\"keywords\" content=\"l'air,eau\">", ["l'air", "eau"]), ("<META content='a \"b\", c' NAME='Keywords'>", ['a "b"', "c"]),
    ("<meta name=keywords content=x>", ["x"]), ("<meta name=\"description\" content=\"keywords\">", []), ("<p>", [])])
def test_meta_keywords(spark, page, want):
    assert one(spark, page, T.meta_keywords) == want


@pytest.mark.parametrize("page, want", [
    ("<title lang=fr>L&rsquo;air </title>", "L’air"), ("<meta content=\"It's so\" property=\"og:title\">", "It's so"), ("<titles>x</titles>", None)])
def test_html_title(spark, page, want):
    assert one(spark, page, T.html_title) == want


@pytest.mark.parametrize("source, want", [
    ("Mon, 11 Apr 2016 16:15:48 GMT", dt.datetime(2016, 4, 11, 16, 15, 48)), ("Mon, 11 Apr 2016 16:15:48 EST", dt.datetime(2016, 4, 11, 21, 15, 48)),
    ("11 Apr 2016 16:15 +0230", dt.datetime(2016, 4, 11, 13, 45)), ("Mon, 1 Apr 16 01:15:48 CEST", dt.datetime(2016, 3, 31, 23, 15, 48)),
    ("Tuesday, 5 April 1999 6:05:09 -08:00", dt.datetime(1999, 4, 5, 14, 5, 9)), ("Mon, 11 Apr 2016 16:15:48", dt.datetime(2016, 4, 11, 16, 15, 48)),
    ("11 Apr 2016 16:15:48 XYZ", None), ("yesterday", None), (None, None)])
def test_feed_dates(spark, source, want):
    assert one(spark, source, dates.from_rfc822) == want


def test_has_looks_into_arrays(spark):
    df = spark.createDataFrame([(1, [], "x"), (2, ["a"], ""), (3, None, None)], "id int, tags array<string>, s string")
    assert [r["id"] for r in df.where(P.has("tags")).collect()] == [2]
    assert [r["id"] for r in df.where(P.has("s")).orderBy("id").collect()] == [1, 2]


def test_score_formula(spark):
    df = spark.createDataFrame([(2.0, [("a", 50.0), ("b", 100.0)]), (2.0, [])], "score double, topics array<struct<label:string,score:double>>")
    def run(f):
        return [r["overall_score"] for r in S.with_overall_score(df, formula=f).collect()]
    assert run(S.DEFAULT_OVERALL_SCORE) == [1.5, 0.0]
    assert run("es_score * mean(topics_scores) + max(topics_scores) - min(topics_scores) ** 2") == [2.25, 0.0]
    for bad in ("(select count(1) from range(5))", "__import__('os')", "es_score.x", "other", "[1]", "es_score if 1 else 2", "reflect(es_score)", "1 +"):
        with pytest.raises(ValueError):
            run(bad)


def test_search_terms_are_those_of_documents(spark):
    assert S.query_terms("Foo_bar É9-x") == ["foo", "bar", "é9", "x"] == one(spark, "Foo_bar É9-x", S.tokens)


def test_summary_and_keywords(spark):
    text = "Cats sleep. Dogs bark loudly! Cats purr and cats sleep; cats eat? 12. Birds"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "... 1!")], "k int, text string")
    got = X.summarize(df, "k", n=2)
    assert [tuple(r) for r in got.collect()] == [(1, "Cats sleep. Cats purr and cats sleep; cats eat?")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    words = X.keywords(df, "k", k=2)
    assert [(r["k"], r["token"], r["n"], r["rank"]) for r in words.collect()] == [(1, "cats", 4, 1), (1, "sleep", 2, 2)]
    assert [(r["k"], r["tags"]) for r in X.keyword_tags(df, "k", k=1).collect()] == [(1, ["cats"])]
