"""Main text, refreshes and languages against pages and texts written by hand."""

import time

import pytest
from pyspark.sql import functions as F

from newslake.operators import language as L, text as X
from tests.test_pages import one

PARAGRAPH = "The council met on Monday to discuss the new bridge over the river, its cost and its route."
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Section number {i} of this site</a></li>" for i in range(6)) + "</ul>"


def page(body):
    return f"<html><head><title>T</title></head><body>{body}</body></html>"


def test_article_keeps_short_paragraphs_between_long_ones_and_drops_menus(spark):
    body = MENU + f"<p>{PARAGRAPH}</p><p>It was late.</p><p>{PARAGRAPH}</p>" + MENU + "<p>Imprint</p>" + MENU
    assert one(spark, page(body), X.article_text) == f"{PARAGRAPH}\nIt was late.\n{PARAGRAPH}"
    assert one(spark, page(body), X.dense_text) == f"{PARAGRAPH}\n{PARAGRAPH}"


def main(spark, html, size):
    return one(spark, html, lambda c: X.extract_main_text(c, size))


def test_three_steps(spark):
    body = MENU + f"<p>{PARAGRAPH}</p>" + "<div>Short note.</div>" + MENU
    article, visible = one(spark, page(body), X.article_text), one(spark, page(body), lambda c: X.T.visible_text(c))
    assert len(article) < len(visible)
    assert main(spark, page(body), len(article)) == article  # the article is long enough
    assert main(spark, page(body), len(article) + 1) == visible  # the whole page is
    assert main(spark, page(body), len(visible) + 1) == PARAGRAPH  # neither is: the dense blocks
    assert main(spark, page("<p>Tiny.</p>"), 100) == "Tiny."  # no dense block
    assert main(spark, "", 100) == ""


def test_refresh_is_followed(spark):
    go = lambda to: f"<meta http-equiv=\"refresh\" content=\"0; url={to}\">"
    rows = [(1, "https://a.com/1", go("https://a.com/2")), (2, "https://a.com/2", go("https://a.com/3")), (3, "https://a.com/3", "<p>end</p>"),
            (4, "https://a.com/4", go("https://elsewhere.com/x")), (5, "https://a.com/5", "<p>plain</p>"),
            (6, "https://a.com/6", go("https://a.com/7")), (7, "https://a.com/7", go("https://a.com/6")), (8, "https://a.com/8", None)]
    df = spark.createDataFrame(rows, "page_id int, link string, html string")
    got = {r["page_id"]: r for r in X.follow_refresh(df).collect()}
    assert set(got) == set(range(1, 9))
    for i in (1, 2):
        assert (got[i]["link"], got[i]["html"]) == ("https://a.com/3", "<p>end</p>")
    for i in (3, 4, 5, 8):
        assert (got[i]["link"], got[i]["html"]) == rows[i - 1][1:]
    assert got[6]["link"] in ("https://a.com/6", "https://a.com/7")  # a circle ends
    assert X.follow_refresh(df.limit(0)).count() == 0


SAMPLES = {
    "en": ["the ships that were in the harbour and the people on them", "there is nothing that we can do about this weather"],
    "de": ["die schiffe, die im hafen lagen, und die menschen darauf", "wir können gegen dieses wetter nichts tun"],
    "fr": ["les navires qui étaient dans le port et les gens à bord", "nous ne pouvons rien faire contre ce temps"],
    "ja": ["港にいた船とその上の人々について話しました。", "この天気には何もできません。きょうはとても寒いです。"],
    "zh": ["港口里的船和船上的人们", "我们对这种天气无能为力，今天很冷。"],
    "th": ["เรือที่อยู่ในท่าเรือและผู้คนบนเรือ", "เราทำอะไรกับสภาพอากาศนี้ไม่ได้"],
}
ASKED = [("en", "what the people of the city thought about that"), ("de", "was die menschen der stadt darüber dachten"), ("fr", "ce que les gens de la ville en pensaient"),
         ("ja", "町の人々がどう思ったかを聞きました。"), ("zh", "城市里的人们怎么想"), ("th", "ผู้คนในเมืองคิดอย่างไร"), ("", ""), ("", "12 + 30 = 42"), ("", None)]


@pytest.fixture(scope="module")
def profile(spark):
    train = spark.createDataFrame([(k, t) for k, ts in SAMPLES.items() for t in ts] + [(None, "x"), ("en", None)], "lang string, text string")
    return L.fit_language_profiles(train)


def test_languages_with_and_without_spaces(spark, profile):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ASKED)], "k int, text string")
    out = L.detect_language(df, *profile, "k")
    assert {r["k"]: r["detected"] for r in out.collect()} == {i: lang for i, (lang, _) in enumerate(ASKED)}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()  # no exchange of texts or n-grams


def test_language_probability_is_that_of_the_profile(spark, profile):
    """The scores by counting n-grams one by one."""
    import math
    counts = {}
    for r in profile[0].collect():
        counts.setdefault(r["lang"], {})[r["cell"]] = r["n"]
    table = {r["lang"]: (r["docs"], r["grams"]) for r in profile[1].collect()}
    total = sum(d for d, _ in table.values())

    def cells(text):
        c = [ord(x) for x in " " + text + " "]
        return [(sum(c[i + k] * L.FACTORS[n - 1 - k] for k in range(n)) + n * 7919) % L.CELLS for n in (1, 2, 3) for i in range(len(c) - n + 1)]
    assert table["ja"][1] == sum(counts["ja"].values()) and table["en"][0] == 2
    for want, text in ASKED[:3]:
        score = {k: math.log(d / total) + sum(math.log((counts[k].get(x, 0) + 1) / (g + L.CELLS)) for x in cells(text)) for k, (d, g) in table.items()}
        assert max(sorted(score), key=score.get) == want


def test_no_profile_and_stored_profile(spark, tmp_dir):
    none = spark.createDataFrame([], "lang string, text string")
    df = spark.createDataFrame([(1, "the people")], "k int, text string")
    assert L.detect_language(df, *L.fit_language_profiles(none), "k").first()["detected"] == ""
    train = spark.createDataFrame([("en", "the people"), ("de", "die leute")], "lang string, text string")
    L.fit_language_profiles(train, path=tmp_dir + "/p")
    assert L.detect_language(df, *L.read_language_profiles(spark, tmp_dir + "/p"), "k").first()["detected"] == "en"


def test_extract_docs_is_planned_quickly_and_detects(spark, profile):
    pages = spark.createDataFrame([(1, "https://a.com/1", f"<html lang=xx><p>{'the people of the city thought about that. ' * 30}</p></html>"),
                                   (2, "https://a.com/2", "<html lang=xx><p>1234</p></html>")], "page_id int, link string, html string")
    X.extract_docs(pages)  # loads classes
    t = time.time()
    out = X.extract_docs(pages, language=L.language_of(*profile))
    assert time.time() - t < 5
    got = {r["page_id"]: r for r in out.collect()}
    assert (got[1]["lang"], got[1]["content"][0]["language"], got[2]["lang"]) == ("en", "en", "xx")
    assert got[1]["title"] == "the people of the city thought about that."
    assert got[2]["summary"] in (None, "")


def test_ranked_sentences(spark):
    text = "Cats sleep. Dogs bark. Cats and dogs and cats! 12 34. 中文 句子"
    [best] = spark.createDataFrame([(text,)], "t string").select(X.best_sentences("t", 2)).first()
    assert [(x["pos"], x["sentence"], x["rank"]) for x in best] == [(0, "Cats sleep.", 0), (2, "Cats and dogs and cats!", 1)] or [x["rank"] for x in best] == [1, 0]
    df = spark.createDataFrame([(None,), ("",), ("...",), ("1 2. 3",)], "t string")
    assert [r[0] for r in df.select(F.size(F.coalesce(X.best_sentences("t"), F.array().cast("array<struct<pos:int,sentence:string,rank:int>>")))).collect()] == [0, 0, 0, 0]


def test_letter_runs_are_those_of_the_engine(spark):
    """Every character that is a letter, or a number of another kind, among letters."""
    import re
    import sys
    import unicodedata
    chars = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Nl", "No", "Mn", "Pc") and (c < 0x3000 or c % 97 == 0 or unicodedata.category(chr(c))[0] == "N")]
    pattern, beyond = X._letter_runs()
    word = re.compile(pattern)
    for c in chars:
        assert bool(word.fullmatch(c.translate(beyond))) == (unicodedata.category(c)[0] == "L"), hex(ord(c))
