"""Text analytics on pages and docs (J1-J5, L7 pieces).

* Page extraction (J4, J5) is per row and narrow: higher-order functions over
  the blocks of one page, no explode and no shuffle.
* Summaries (J2) and keywords (J3) count the words of one text inside its
  row, so there is no shuffle. Sentences are ranked in Arrow batches: sorting
  words in SQL lambdas took three times as long.
* Language detection (J1) is in ``language``. Whole texts are processed.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as ST

from newslake.functions import text as T, urls as U
from newslake.functions._util import as_col, let
from newslake.operators.partitioning import spread

# Block-level tags that start a text block, block thresholds.
BLOCK_TAGS = ["p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav",
              "footer", "header", "ul", "ol", "table", "tr", "td", "br", "aside", "main",
              "blockquote", "pre"]
MIN_BLOCK_CHARS = 25
MAX_LINK_DENSITY = 0.5
SENTENCE = r"[^.!?]+[.!?]*"
WORD_SPLIT = r"[^\p{L}]+"
# Stop words left out of keywords (en, fr, de, es).
STOP_WORDS = [
    "the", "and", "for", "that", "with", "this", "from", "was", "are", "not", "but", "have",
    "les", "des", "une", "que", "qui", "dans", "pour", "par", "sur", "est", "pas", "avec",
    "der", "die", "und", "das", "den", "dem", "ein", "eine", "ist", "nicht", "mit", "von", "sich",
    "los", "las", "del", "una", "por", "con", "para", "como", "más", "pero",
]


def _block_split() -> str:
    return r"(?i)<(?:" + "|".join(BLOCK_TAGS) + r")\b[^>]*>"


def strip_boilerplate(html) -> Column:
    """Comments, script/style/head/title blocks removed."""
    h = F.regexp_replace(as_col(html), r"(?is)<!--.*?-->", "")
    return F.regexp_replace(h, T.HIDDEN_ELEMENTS, "")


def _plain(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(T.decode_entities(t), r"\s+", " "))


def text_blocks(html) -> Column:
    """Blocks of a page: struct(text, link_chars) in document order."""
    blocks = F.split(strip_boilerplate(html), _block_split())

    def info(b):
        links = F.array_join(F.regexp_extract_all(b, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), 1), " ")
        return F.struct(_plain(b).alias("text"), F.length(_plain(links)).alias("link_chars"))
    return F.transform(blocks, info)


def _few_links(b, max_link_density: float = MAX_LINK_DENSITY) -> Column:
    return b["link_chars"] <= F.length(b["text"]) * max_link_density


def _lines(blocks) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")


def _dense(blocks, min_block: int, max_link_density: float) -> Column:
    return _lines(F.filter(blocks, lambda b: (F.length(b["text"]) >= min_block) & _few_links(b, max_link_density)))


def dense_text(html, min_block: int = MIN_BLOCK_CHARS, max_link_density: float = MAX_LINK_DENSITY) -> Column:
    """Density-based text: blocks of at least ``min_block`` characters whose
    link text is at most ``max_link_density`` of the block, each on its own."""
    return _dense(text_blocks(html), min_block, max_link_density)


def _article(blocks, min_block: int) -> Column:
    def smooth(full):
        # Characters outside links less those inside, as a mean over a block (twice) and its neighbours.
        weight = F.transform(full, lambda b: F.length(b["text"]) - 2 * b["link_chars"])
        return let(weight, lambda w: F.filter(full, lambda b, i: _few_links(b) & (
            F.coalesce(F.get(w, i - 1), F.lit(0)) + 2 * F.get(w, i) + F.coalesce(F.get(w, i + 1), F.lit(0)) >= 4 * min_block)))
    return _lines(let(F.filter(blocks, lambda b: F.length(b["text"]) > 0), smooth))


def article_text(html, min_block: int = MIN_BLOCK_CHARS) -> Column:
    """The article: blocks whose text density, smoothed over the neighbouring
    blocks, reaches ``min_block``. A short paragraph between long ones stays, a
    line of a menu or a teaser between links goes."""
    return _article(text_blocks(html), min_block)


def extract_main_text(html, min_size: int = T.NEWS_MIN_TEXT_SIZE) -> Column:
    """The article; if that is shorter than ``min_size``, the visible text
    of the whole page (I13); if that is shorter too, the dense blocks alone,
    and the visible text where there are none."""
    def chain(blocks):
        article, dense = _article(blocks, MIN_BLOCK_CHARS), _dense(blocks, MIN_BLOCK_CHARS, MAX_LINK_DENSITY)
        return let(article, lambda a: F.when(F.length(a) >= min_size, a).otherwise(let(T.visible_text(html), lambda v: (
            F.when((F.length(v) >= min_size) | (F.length(dense) == 0), v).otherwise(dense)))))
    return let(text_blocks(html), chain)


def html_lang(html) -> Column:
    return F.nullif(F.lower(F.regexp_extract(as_col(html), r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)), F.lit(""))


def follow_refresh(pages: DataFrame, link: str = "link", html: str = "html", hops: int = 3) -> DataFrame:
    """I16 followed: a page that only refreshes to another landed page gets that
    page's link and html, over at most ``hops`` refreshes; the deepest landed one
    counts. Pages without a refresh pass through; only ids are joined but for
    the pages that are fetched."""
    target = U.meta_refresh_target(F.col(html))
    named = pages.withColumn("__to", F.when(target.isNotNull(), U.doc_id(target)))
    # page -> where it refreshes to, up to hops times.
    step = named.filter("__to is not null").select(U.doc_id(link).alias("__id"), "__to").distinct()
    chain = step.select("__id", F.col("__to").alias("__at"), F.lit(1).alias("__depth"))
    reached = chain
    for d in range(2, hops + 1):
        nxt = step.select(F.col("__id").alias("__at"), F.col("__to").alias("__next"))
        chain = chain.join(nxt, "__at").select("__id", F.col("__next").alias("__at"), F.lit(d).alias("__depth"))
        reached = reached.unionByName(chain)
    wanted = reached.select("__at").distinct()
    landed = (pages.select(U.doc_id(link).alias("__at"), F.col(link).alias("__link"), F.col(html).alias("__html"))
              .join(wanted, "__at", "left_semi").groupBy("__at").agg(F.min(F.struct("__link", "__html")).alias("__p")))
    deepest = reached.join(landed, "__at").groupBy("__id").agg(F.max_by("__p", "__depth").alias("__p"))
    moved = (named.filter("__to is not null").withColumn("__id", U.doc_id(link)).join(deepest, "__id", "left")
             .withColumn(link, F.coalesce("__p.__link", link)).withColumn(html, F.coalesce("__p.__html", html)))
    return named.filter("__to is null").select(pages.columns).unionByName(moved.select(pages.columns))


def extract_docs(pages: DataFrame, rules: dict[str, str] | None = None,
                 min_size: int = T.NEWS_MIN_TEXT_SIZE, link: str = "link", html: str = "html",
                 content_type: str | None = None, language=None) -> DataFrame:
    """Page -> doc fields (link, id, content, content_type, title, html as
    base64, text, summary, rule fields, tags, language).

    The title falls back to the text's best sentence, the summary has its three
    best (J2), the tags are the keywords meta and the ten most frequent words
    (J3), normalised. ``content_type`` is the column of the landed header, where
    there is one. ``language`` (see ``language.language_of``) detects the language
    of the text; without it, or for a text without letters, the page's own
    attribute counts. Per-row steps only; text and sentences are computed once."""
    tags = F.concat(T.normalize_tags(T.meta_keywords(F.col(html))),
                    F.coalesce(T.normalize_tags(F.transform(top_words(F.col("text")), lambda x: x["token"])), F.array().cast("array<string>")))
    header = F.col(content_type) if content_type else F.lit("text/html")
    with_text = (spread(pages).select("*", T.clean_extracted(extract_main_text(F.col(html), min_size)).alias("text"))
                 .withColumn("__best", best_sentences("text")))
    lang = html_lang(F.col(html))
    with_text = with_text.withColumn("__lang", F.coalesce(F.nullif(language("text"), F.lit("")), lang) if language else lang)
    return with_text.select(
        *pages.columns, "text",
        U.doc_id(link).alias("id"),
        F.array(F.struct(F.col(link).alias("base"), F.coalesce("__lang", F.lit("")).alias("language"))).alias("content"),
        T.content_type_of(F.col(link), header).alias("content_type" if content_type != "content_type" else "found_type"),
        F.coalesce(T.html_title(F.col(html)), best_sentence(F.col("__best"))).alias("title"),
        F.array_join(F.transform("__best", lambda x: x["sentence"]), " ").alias("summary"),
        T.b64_html(F.col(html)).alias("html_b64"),
        F.col("__lang").alias("lang"),
        F.array_distinct(F.filter(tags, lambda t: F.length(t) > 0)).alias("tags"),
        *T.extract_rules(F.col("text"), rules),
    )


def words(c) -> Column:
    return F.filter(F.split(F.lower(as_col(c)), WORD_SPLIT), lambda t: F.length(t) > 0)


# ---------------------------------------------------------------------------
# J2 summaries, J3 keywords
# ---------------------------------------------------------------------------
def sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, sentence) for every sentence of every text."""
    return (df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(SENTENCE), 0)).alias("pos", "s"))
            .select(key, "pos", F.trim("s").alias("sentence")).filter(F.length("sentence") > 0))


def _runs(sorted_array: Column, key, make) -> Column:
    """``make(array, begin, end)`` of each run of equal ``key(element)`` in a
    sorted array: the grouping of one row's elements, without a shuffle."""
    def cut(a):
        begins = F.filter(F.sequence(F.lit(0), F.size(a) - 1),
                          lambda i: (i == 0) | (key(F.get(a, i)) != key(F.get(a, i - 1))))
        return let(begins, lambda b: F.transform(b, lambda lo, k: make(a, lo, F.coalesce(F.get(b, k + 1), F.size(a)))))
    return let(sorted_array, lambda a: F.when(F.size(a) > 0, cut(a)))


@lru_cache(maxsize=1)
def _letter_runs() -> tuple[str, dict[int, str]]:
    """The pattern ``\\p{L}+`` for Python's ``re``, which has no such class: word
    characters without digits and the other numbers (Nl, No). Those beyond the
    basic plane would make the class slow; they are a table for ``translate``."""
    numbers = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")]
    return r"[^\W\d_" + "".join(f"\\u{c:04x}" for c in numbers if c < 0x10000) + "]+", {c: " " for c in numbers if c > 0xFFFF}


def _sentence_ranker(n: int):
    sentence_pattern, (word_pattern, beyond) = SENTENCE, _letter_runs()
    kind = ST.ArrayType(ST.StructType([ST.StructField("pos", ST.IntegerType()), ST.StructField("sentence", ST.StringType()), ST.StructField("rank", ST.IntegerType())]))

    @F.pandas_udf(kind)
    def rank(texts: pd.Series) -> pd.Series:
        from collections import Counter
        sentence, letter = re.compile(sentence_pattern), re.compile(word_pattern)

        class Others(dict):
            """What is no letter becomes a space: the pattern is asked once for each
            character, ``translate`` and ``split`` are several times faster than it."""
            def __missing__(self, c):
                self[c] = chr(c) if c not in beyond and letter.fullmatch(chr(c)) else " "
                return self[c]
        others = Others()
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            found = [s for s in (x.strip(" ") for x in sentence.findall(text)) if s]
            tokens = [s.lower().translate(others).split() for s in found]
            counts = Counter(chain.from_iterable(tokens))
            best = sorted((-sum(map(counts.__getitem__, t)) / len(t), i) for i, t in enumerate(tokens) if t)[:n]
            place = {i: r for r, (_, i) in enumerate(best)}
            out.append([{"pos": i, "sentence": found[i], "rank": place[i]} for i in sorted(place)] if found else None)
        return pd.Series(out, dtype=object)
    return rank


def best_sentences(text, n: int = 3) -> Column:
    """J2 in the row: the ``n`` sentences (struct pos, sentence, rank from 0)
    whose words are most frequent in the text (mean count of the sentence's
    words; the earlier of equal ones), in text order; null when there is none."""
    return _sentence_ranker(n)(as_col(text))


def best_sentence(best: Column) -> Column:
    """The first by rank of what ``best_sentences`` gives."""
    return F.get(F.filter(best, lambda x: x["rank"] == 0), 0)["sentence"]


def summarize(df: DataFrame, key: str, text: str = "text", n: int = 3) -> DataFrame:
    """Extractive summary -- the ``n`` best sentences of each text, in text
    order and joined by a space. A narrow step: no shuffle."""
    # A text with a letter has a sentence; a filter on the ranking would run it twice.
    best = spread(df).filter(F.col(text).rlike(r"\p{L}")).select(key, best_sentences(F.col(text), n).alias("__b"))
    return best.select(key, F.array_join(F.transform("__b", lambda x: x["sentence"]), " ").alias("summary"))


def most_frequent(tokens, k: int) -> Column:
    """The ``k`` most frequent elements of an array of strings as structs (n,
    token), count desc then token asc; null for an empty array."""
    counted = _runs(F.sort_array(as_col(tokens)), lambda w: w, lambda a, lo, hi: F.struct((lo - hi).alias("m"), F.get(a, lo).alias("token")))
    return F.transform(F.slice(F.sort_array(counted), 1, k), lambda x: F.struct((-x["m"]).cast("long").alias("n"), x["token"].alias("token")))


def _word_counter(k: int, min_len: int, stop_words: list[str]):
    kind, stops = ST.ArrayType(ST.StructType([ST.StructField("n", ST.LongType()), ST.StructField("token", ST.StringType())])), frozenset(stop_words)

    @F.pandas_udf(kind)
    def count(texts: pd.Series) -> pd.Series:
        from collections import Counter
        out = []
        for text in texts:
            counts = Counter((text or "").split(" "))
            top = sorted((-n, w) for w, n in counts.items() if len(w) >= max(min_len, 1) and w not in stops)[:k]
            out.append([{"n": -n, "token": w} for n, w in top] or None)
        return pd.Series(out, dtype=object)
    return count


def top_words(text, k: int = 10, min_len: int = 3, stop_words: list[str] | None = None) -> Column:
    """J3 in the row: the ``k`` most frequent words (see ``words``) as structs (n,
    token), count desc then word asc; null when there is none. They are counted in
    Arrow batches, sorting them in SQL lambdas took several times as long."""
    stops = STOP_WORDS if stop_words is None else stop_words
    return _word_counter(k, min_len, stops)(F.regexp_replace(F.lower(as_col(text)), WORD_SPLIT, " "))


def keywords(df: DataFrame, key: str, text: str = "text", k: int = 10, min_len: int = 3,
             stop_words: list[str] | None = None) -> DataFrame:
    """The ``k`` most frequent words of each text (stop words and words
    shorter than ``min_len`` left out). A narrow step: no shuffle."""
    top = spread(df).select(key, F.posexplode(top_words(F.col(text), k, min_len, stop_words)).alias("p", "x"))
    return top.select(key, F.col("x.token").alias("token"), F.col("x.n").alias("n"), (F.col("p") + 1).cast("int").alias("rank"))


def keyword_tags(df: DataFrame, key: str, text: str = "text", k: int = 10) -> DataFrame:
    """J3 as a tags column (key, tags) in rank order."""
    return spread(df).select(key, F.transform(top_words(F.col(text), k), lambda x: x["token"]).alias("tags")).filter(F.size("tags") > 0)
