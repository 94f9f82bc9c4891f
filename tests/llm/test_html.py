import pytest

from newslake.llm import html_extract as H

TREE = H.train()
LONG = "A long paragraph of the article that tells what has happened in the town on that day."
CASES = [
    (None, ""), ("", ""), ("   \n", ""), ("<html><body></body></html>", ""),
    (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- ad <p> --><div class=\"ad\">Buy this.</div>"
     f"<article><h1>Caf&eacute; &amp;amp; co</h1><p><b>Bold  text\n here<br>next<p>{LONG}</p><p>One.</article><footer>&copy; x</footer>", f"Café &amp; co\n\nBold text here next\n\n{LONG}\n\nOne."),
    (f"<body><header><h1>Site</h1></header><main><header><h1>Story</h1></header><p>{LONG}</p></main><aside>{LONG}</aside><section class='comments'><p>{LONG}</p></section><form><p>{LONG}</p><input></form></body>", f"Story\n\n{LONG}"),
    (f"<div id='cookie-notice'>{LONG}</div><div class='post-body'><p>{LONG}</p><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></div><div class=advert><p>{LONG}</p></div>", f"{LONG}\n\na\n\nb\n\n1\n\n2"),
    ("<article><p>x &lt;b&gt; y &#8217;z&#x41; a < b</p><script>if (a<b) {}</script><noscript><p>no</p></noscript><p hidden>h</p><p style='display: none'>h</p></article>", "x <b> y ’zA a < b"),
    ("<ARTICLE><P>Up</P><SCRIPT>x</SCRIPT><style>y", "Up"), ("<article><p>cut off in a ta", "cut off in a ta"), ("<article><p>cut <a href='", "cut"), ("<!-- never closed <article><p>x", ""),
    ("<article><p>in<b>li</b>ne <em>text</em>s</p><p>a&nbsp;&nbsp;b</p></article>", "inline texts\n\na b"),
]


@pytest.mark.parametrize("page, want", CASES)
def test_pages(page, want):
    assert H.main_text(page, TREE) == want


def test_neighbours_and_density():
    found = H.blocks("<p>one two</p><p><a href=x>three</a> four</p>")
    assert [(b.text, b.words, b.density) for b in found] == [("one two", 2, 0.0), ("three four", 2, 0.5)]
    assert H.features(found)[0].tolist() == [2, 0, 0, 0, 2, 0.5, 0, 0, 0]


def test_tree_fits_its_table():
    for page in H.LABELLED:
        found = H.blocks(page)
        assert TREE.predict(H.features(found)).tolist() == [b.marked for b in found]


def test_columns(spark):
    df = spark.createDataFrame([(i, "u", p, "keep") for i, (p, _) in enumerate(CASES)], "page_id long, url string, html string, n_chars string").repartition(3)
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(CASES)}
    assert H.extract(df.limit(0)).count() == 0
    assert len(H.main_text("<article><p>" + "<p>word " * 50_000, TREE).split("\n\n")) == 50_000
    with pytest.raises(ValueError):
        H.extract(df, into="url")


@pytest.mark.parametrize("page", [
    f"<div class='layout no-sidebar'><p>{LONG}</p><p>{LONG}</p></div>",
    f"<div class='right-sidebar container'><div><p>{LONG}</p><p>{LONG}</p></div></div><footer>Imprint</footer>",
    f"<div id='page' class='has-nav'><div class=nav><a href=/>Home</a></div><article><p>{LONG}</p><p>{LONG}</p></article><div class=sidebar><article><p>{LONG}</p></article></div></div>",
    f"<div class='modal message'><div class=sidebar><article><p>Other</p></article></div><main><p>{LONG}</p><p>{LONG}</p></main><section class=comments><article><p>{LONG}</p></article></section></div>",
    f"<form id=legal><div class=post><p>{LONG}</p><p>{LONG}</p></div></form>",
])
def test_wrappers_with_names_of_the_frame(page):
    assert H.main_text(page, TREE) == f"{LONG}\n\n{LONG}"


@pytest.mark.parametrize("page", [
    f"<article><p>{LONG}</p></article><div class=sidebar><article><p>{LONG}</p><p>{LONG}</p></article></div>",
    f"<article><p>{LONG}</p></article><div class=comments><article><article><p>{LONG}</p><p>{LONG}</p></article></article></div>",
])
def test_frames_stay_frames(page):
    assert H.main_text(page, TREE) == LONG


def test_content_of_math_object_and_button():
    page = "<article><h2><button>Energy</button></h2><p>It is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding=tex>E</annotation></math> there <object data=x><b>shown</b></object>.</p><button class=share>Share</button></article>"
    assert H.main_text(page, TREE) == "Energy\n\nIt is E=m there shown."


@pytest.mark.parametrize("tag", ["button", "svg", "select", "object", "template"])
def test_unclosed_elements_end_at_their_parent(tag):
    text = H.main_text(f"<article><p>One.</p><div><{tag}></div><p>{LONG}</p><p>Two <{tag}><p>{LONG}</article>", TREE)
    assert text.startswith("One.") and text.count(LONG) == 2


def used(tree):
    return set() if tree.feature < 0 else {H.FEATURES[tree.feature]} | used(tree.low) | used(tree.high)


def test_tree_uses_density_and_a_neighbour():
    names = used(TREE)
    assert "density" in names and names & {"words before", "density before", "words after", "density after"}


@pytest.mark.parametrize("page, want", [
    (f"<div><h1>Big title</h1><p>{LONG}</p><p>Yes.</p><ul><li>One point</li></ul></div>", f"Big title\n\n{LONG}\n\nYes.\n\nOne point"),
    (f"<div><a href=/>Start</a></div><div><a href=/n>Neues</a></div><div><h1>Titel</h1><p>{LONG}</p><p>Nein.</p></div><div><a href=/m>Mehr davon in einem langen Verweis auf andere Seiten</a></div>", f"Titel\n\n{LONG}\n\nNein."),
    (f"<article><p>{LONG}</p></article><div class=responses><p>{LONG}</p></div><div class=werbung><p>{LONG}</p></div><div id=kommentare><p>{LONG}</p></div>", LONG),
    (f"<p>{LONG}</p><p><a href=/1>{LONG}</a></p><p><a href=/2>Only a link</a></p>", LONG),
])
def test_pages_without_helpful_names(page, want):
    assert H.main_text(page, TREE) == want


def test_query_with_extra_columns(spark, tmp_dir):
    from newslake.llm.queries import QUERIES
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "mine", 5)], "page_id long, url string, html string, text string, n_chars int")
    df.write.parquet(f"{tmp_dir}/pages.parquet")
    assert [tuple(r) for r in QUERIES["op7_html_extraction"](spark, tmp_dir).collect()] == [(1, "u", LONG, len(LONG))]
