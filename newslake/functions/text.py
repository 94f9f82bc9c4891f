"""String, HTML, tag and message Column functions (I3-I5, I10-I22, I25-I27,
I29-I33, I35, I36, E7).

Everything here is a composition of built-in expressions (``regexp_*``,
``transform``, ``aggregate``...): no Python runs per row.
"""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column, functions as F

from newslake.functions._util import EMPTY_STRINGS, as_col

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------
# Tag normalisation removes this substring.
TAG_STOP_SUBSTRING = "news"
# Extraction rules: field name -> regex (case-insensitive, multiline).
DEFAULT_EXTRACTION_RULES = {"cve": r"CVE-[0-9]{4}-[0-9]{4,}"}
# Training-eligibility and content-size gates.
NEWS_MIN_TEXT_SIZE = 1000
TRAINING_MIN_TEXT_SIZE = 500
# Rank threshold of the ranked feed.
OVERALL_SCORE_THRESHOLD = 0.1
# Language code -> summariser language name (the detector's codes and the
# names the summariser knows). Two entries differ from the reference on
# purpose (decision Q10): pl -> polish (was portuguese), no -> norwegian (was bo).
LANGUAGE_NAMES = {
    "": "", "af": "af", "ar": "ar", "bg": "bg", "bn": "bn", "ca": "ca", "cs": "czech", "cy": "cy",
    "da": "da", "de": "german", "el": "el", "en": "english", "es": "spanish", "et": "et", "fa": "fa",
    "fi": "fi", "fr": "french", "gu": "gu", "he": "he", "hi": "hi", "hr": "hr", "hu": "hu", "id": "id",
    "it": "it", "ja": "japanese", "kn": "kn", "ko": "ko", "lt": "lt", "lv": "lv", "mk": "mk", "ml": "ml",
    "mr": "mr", "ne": "ne", "nl": "nl", "no": "norwegian", "pa": "pa", "pl": "polish", "pt": "pt",
    "ro": "ro", "ru": "ru", "sk": "slovak", "sl": "sl", "so": "so", "sq": "sq", "sv": "sv", "sw": "sw",
    "ta": "ta", "te": "te", "th": "th", "tl": "tl", "tr": "tr", "uk": "uk", "ur": "ur", "vi": "vi",
    "zh-cn": "chinese", "zh-tw": "chinese",
}
# Chat commands understood by the bot.
CHAT_COMMANDS = ["subscribe", "follow", "watch", "teach", "digest", "help"]
# The bot's own account name (commands addressed to another bot are ignored).
BOT_NAME = "newslakebot"

URL_IN_TEXT = r"https?://\S+"
NON_ASCII = r"[^\x00-\x7F]"
CRLF = "\r\n"


# ---------------------------------------------------------------------------
# tags
# ---------------------------------------------------------------------------
def normalize_tag(c) -> Column:
    """Trim, lower, drop ``news``, space to ``_``, drop non-ASCII."""
    t = F.lower(F.trim(as_col(c)))
    t = F.replace(t, F.lit(TAG_STOP_SUBSTRING), F.lit(""))
    t = F.replace(t, F.lit(" "), F.lit("_"))
    return F.regexp_replace(t, NON_ASCII, "")


def normalize_tags(c) -> Column:
    return F.transform(as_col(c), normalize_tag)


def strip_urls(c) -> Column:
    """I4 / part of I19: remove every URL."""
    return F.regexp_replace(as_col(c), URL_IN_TEXT, "")


def hashtags(entities_hashtags) -> Column:
    """Hashtag texts normalised by I3."""
    return F.transform(F.transform(as_col(entities_hashtags), lambda h: h["text"]), normalize_tag)


def ascii_only(c) -> Column:
    """I21."""
    return F.regexp_replace(as_col(c), NON_ASCII, "")


def card_hashtag(c) -> Column:
    """``#`` + alphanumerics of the tag."""
    return F.concat(F.lit("#"), F.regexp_replace(as_col(c), "[^A-Za-z0-9]+", ""))


def sanitize_topic_title(c) -> Column:
    """``-`` becomes ``_``."""
    return F.translate(as_col(c), "-", "_")


# ---------------------------------------------------------------------------
# display fallbacks
# ---------------------------------------------------------------------------
def summary_or(summary) -> Column:
    """Summary shorter than 5 (or missing) -> ``No summary``."""
    s = as_col(summary)
    return F.when(s.isNull() | (F.length(s) < 5), F.lit("No summary")).otherwise(s)


def content_or(summary) -> Column:
    """Content is the summary when the summary is long enough."""
    s = as_col(summary)
    return F.when(F.length(s) >= 5, s)


def author_or(author) -> Column:
    return F.coalesce(as_col(author), F.lit("unknown"))


def title_or(title, summary) -> Column:
    """Title missing or shorter than 5 -> the (display) summary."""
    t = as_col(title)
    return F.when(t.isNull() | (F.length(t) < 5), summary_or(summary)).otherwise(t)


def mean_topic_score(topics) -> Column:
    """sum/len of topics.score (null when there are no topics)."""
    t = as_col(topics)
    total = F.aggregate(t, F.lit(0.0), lambda acc, x: acc + x["score"])
    return F.when(F.size(t) > 0, total / F.size(t))


def topic_scores(topics) -> Column:
    """Topic scores scaled to 0..1 (``score/100``), the input of I24."""
    return F.transform(as_col(topics), lambda x: x["score"] / 100.0)


# ---------------------------------------------------------------------------
# HTML
# ---------------------------------------------------------------------------
def b64_html(html) -> Column:
    """base64 of the page source, one line (Spark may chunk base64 into
    MIME lines depending on ``spark.sql.chunkBase64String.enabled``)."""
    return F.regexp_replace(F.base64(F.encode(as_col(html), "UTF-8")), r"[\r\n]", "")


@lru_cache(maxsize=1)
def _entity_table() -> str:
    """Entity name -> text as JSON, from Python's table of the HTML standard;
    the most frequent ones first, as the lookup goes through the map in order."""
    first = ["amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "middot"]
    names = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return json.dumps({k: names[k] for k in first} | names)


def _entity(ent: Column) -> Column:
    """Text of one character reference (``&...;``); an unknown one stays as it is."""
    code = F.coalesce(
        F.conv(F.nullif(F.regexp_extract(ent, r"^&#[xX]([0-9a-fA-F]+);$", 1), F.lit("")), 16, 10),
        F.nullif(F.regexp_extract(ent, r"^&#([0-9]+);$", 1), F.lit(""))).try_cast("long")
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    by_code = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    # One literal, which the planner folds to a map.
    table = F.from_json(F.lit(_entity_table()), "map<string,string>")
    by_name = F.try_element_at(table, F.regexp_extract(ent, r"^&([A-Za-z][A-Za-z0-9]*);$", 1))
    return F.coalesce(by_code, by_name, ent)


def decode_entities(c) -> Column:
    """Character references (named and numeric) decoded once: the text is cut
    before every reference and each piece's reference replaced."""
    t = as_col(c)
    ref = r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"

    def piece(x):
        ent = F.regexp_extract(x, "^(" + ref + ")", 1)
        return F.when(ent == "", x).otherwise(F.concat(_entity(ent), F.substr(x, F.length(ent) + 1)))
    return F.when(t.rlike(ref), F.array_join(F.transform(F.split(t, "(?=" + ref + ")"), piece), "")).otherwise(t)


# Elements whose content is not visible; the end tag must be of the same name.
HIDDEN_ELEMENTS = r"(?is)<(script|style|head|title)\b[^>]*>.*?</\1\s*>"


def text_nodes(html) -> Column:
    """Visible text nodes in document order (comments, script, style, head and
    title removed, every tag a node boundary, blank nodes dropped)."""
    h = F.regexp_replace(as_col(html), r"(?is)<!--.*?-->", "")
    h = F.regexp_replace(h, HIDDEN_ELEMENTS, "")
    h = F.regexp_replace(h, r"(?is)<[^>]*>", "\u0001")
    nodes = F.transform(F.split(h, "\u0001"), lambda x: F.trim(decode_entities(x)))
    return F.filter(nodes, lambda x: F.length(x) > 0)


def visible_text(html) -> Column:
    """Text nodes joined by CRLF."""
    return F.array_join(text_nodes(html), CRLF)


def meta_content(html, names: list[str]) -> Column:
    """``content`` of the first ``<meta>`` whose ``name`` or ``property`` is one
    of ``names``; attributes in any order, quoted either way or not at all."""
    tags = F.regexp_extract_all(as_col(html), F.lit(r"(?is)<meta\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"), 1)

    def attribute(tag, name):
        whole = F.regexp_extract(tag, rf"(?is)(?:^|\s)(?:{name})\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
        return F.regexp_replace(whole, r"^[\"']|[\"']$", "")
    found = F.filter(tags, lambda t: F.lower(attribute(t, "name|property")).isin(names))
    return F.nullif(F.trim(attribute(F.get(found, 0), "content")), F.lit(""))


def html_title(html) -> Column:
    """``<title>`` text, else the ``og:title``/``title`` meta content."""
    h = as_col(html)
    t = F.nullif(F.trim(F.regexp_extract(h, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)), F.lit(""))
    return decode_entities(F.coalesce(t, meta_content(h, ["og:title", "title"])))


def meta_keywords(html) -> Column:
    """``<meta name=keywords content=a,b>`` split on commas, trimmed,
    blanks dropped (empty array when absent)."""
    raw = F.coalesce(decode_entities(meta_content(html, ["keywords"])), F.lit(""))
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def clean_extracted(c) -> Column:
    """``\\n\\n`` -> ``\\n`` and ``....`` -> space."""
    return F.replace(F.replace(as_col(c), F.lit("\n\n"), F.lit("\n")), F.lit("...."), F.lit(" "))


def html_tokens(html) -> Column:
    """The declared html analyser: strip html, ``&`` -> `` and ``,
    tokens of letters/digits, lower case."""
    text = F.array_join(text_nodes(html), " ")
    text = F.replace(text, F.lit("&"), F.lit(" and "))
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 0)


def extract_rule(text, pattern: str) -> Column:
    """All matches of one rule, case-insensitive and multiline."""
    return F.regexp_extract_all(as_col(text), F.lit(f"(?im)({pattern})"), 1)


def extract_rules(text, rules: dict[str, str] | None = None) -> list[Column]:
    """I18 for a rule set: one array column per rule name."""
    rules = DEFAULT_EXTRACTION_RULES if rules is None else rules
    return [extract_rule(text, pat).alias(name) for name, pat in rules.items()]


def rules_map(text, rules: dict[str, str] | None = None) -> Column:
    """I18 as the model's ``rules`` field: MAP<rule name, ARRAY<match>>."""
    rules = DEFAULT_EXTRACTION_RULES if rules is None else rules
    pairs = []
    for name, pat in rules.items():
        pairs += [F.lit(name), extract_rule(text, pat)]
    return F.create_map(*pairs)


def prediction_input(title, summary, text) -> Column:
    """Title, summary and text joined by CRLF with every URL removed."""
    return strip_urls(F.concat_ws(CRLF, as_col(title), as_col(summary), as_col(text)))


def training_text(title, summary, author, text, tags) -> Column:
    """CRLF + each present field, tags comma-joined, non-ASCII dropped."""
    def part(c):
        return F.when(c.isNotNull(), F.concat(F.lit(CRLF), c)).otherwise(F.lit(""))
    body = F.concat(part(as_col(title)), part(as_col(summary)), part(as_col(author)),
                    part(as_col(text)), part(F.array_join(as_col(tags), ",")))
    return ascii_only(body)


def _card_clean(c, n: int) -> Column:
    """First ``n`` characters, trimmed, ``()[]$`` removed, lines joined by a space."""
    s = F.translate(F.trim(F.substring(as_col(c), 1, n)), "()[]$", "")
    return F.array_join(F.split(s, r"\r\n|\r|\n"), " ")


def card(title, text, link, tags, topics, cve=None) -> Column:
    """The message card of a news item (title else first 120 characters,
    250-character extract, hashtags, topics joined by `` and ``, mean score)."""
    shown_title = F.coalesce(as_col(title), _card_clean(text, 120))
    extract = _card_clean(text, 250)
    tag_line = F.array_join(F.transform(F.coalesce(as_col(tags), F.array().cast(EMPTY_STRINGS)),
                                        lambda t: F.concat(F.lit(" "), card_hashtag(t))), "")
    topic_text = F.array_join(F.transform(as_col(topics), lambda x: x["label"]), " and ")
    msg = F.concat(F.lit("["), shown_title, F.lit("]("), as_col(link), F.lit(")\n\n```"), extract,
                   F.lit("...```\n\n"), tag_line, F.lit("\n\n"))
    if cve is not None:
        from newslake.functions.urls import cve_links
        msg = F.concat(msg, F.when(F.size(as_col(cve)) > 0,
                                   F.concat(cve_links(cve), F.lit(", \n\n"))).otherwise(F.lit("")))
    return F.struct(shown_title.alias("title"), extract.alias("extract"), tag_line.alias("hashtags"),
                    topic_text.alias("topics_text"),
                    F.coalesce(mean_topic_score(topics), F.lit(0.0)).alias("score"), msg.alias("message"))


def digest_entry(title, summary, link, tags, topics) -> Column:
    """L11 digest lines: ``[title](link)`` / ``Tags: #a #b`` / ``Topics: #x``."""
    t = F.coalesce(as_col(title), as_col(summary))
    tag_text = F.array_join(F.transform(F.coalesce(as_col(tags), F.array().cast(EMPTY_STRINGS)),
                                        lambda x: F.concat(F.lit("#"), x, F.lit(" "))), "")
    top_text = F.array_join(F.transform(F.coalesce(F.transform(as_col(topics), lambda x: x["label"]),
                                                   F.array().cast(EMPTY_STRINGS)),
                                        lambda x: F.concat(F.lit("#"), x, F.lit(" "))), "")
    return F.concat(F.lit("["), t, F.lit("]("), as_col(link), F.lit(")\nTags: "), tag_text,
                    F.lit("\nTopics: "), top_text, F.lit("\n\n"))


def categories(topics, tags) -> Column:
    """Atom categories, topics as (``_label``, label) then tags as (tag, tag)."""
    topic_cats = F.transform(F.coalesce(as_col(topics), F.array().cast("array<struct<label:string,score:double>>")),
                             lambda x: F.struct(F.concat(F.lit("_"), x["label"]).alias("term"),
                                                x["label"].alias("label")))
    tag_cats = F.transform(F.coalesce(as_col(tags), F.array().cast(EMPTY_STRINGS)),
                           lambda t: F.struct(t.alias("term"), t.alias("label")))
    return F.concat(topic_cats, tag_cats)


def rights_text(topics) -> Column:
    """``; label:score`` for every topic (empty when none)."""
    return F.coalesce(F.array_join(F.transform(as_col(topics), lambda x: F.concat(
        F.lit("; "), x["label"], F.lit(":"), x["score"].cast("string"))), ""), F.lit(""))


def language_name(code) -> Column:
    """Language code -> summariser language name (null for a code
    outside the table)."""
    pairs = []
    for k, v in LANGUAGE_NAMES.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), F.lower(as_col(code)))


def content_type_of(url, header_type) -> Column:
    """I32: the header type, ``application/pdf`` when the URL has ``.pdf``."""
    return F.when(F.contains(as_col(url), F.lit(".pdf")), F.lit("application/pdf")).otherwise(as_col(header_type))


def is_html_type(content_type) -> Column:
    return F.coalesce(F.lower(as_col(content_type)).rlike("html|xml"), F.lit(False))


def fetch_outcome(status) -> Column:
    """Classify a landed fetch status."""
    s = as_col(status)
    return (F.when(s < 300, "found").when(s == 429, "retry")
            .when((s >= 400) & (s <= 427), "refused").when(s >= 500, "server error")
            .otherwise("other"))


def document_label(file_name, mime_type, file_size) -> Column:
    """Chat document caption."""
    return F.format_string("%s  type: %s size: %s bytes", as_col(file_name), as_col(mime_type),
                           as_col(file_size).cast("string"))


def parse_command(text, bot_name: str = BOT_NAME) -> Column:
    """``/cmd[@bot] rest`` -> struct(command, target, keywords, valid).

    ``follow`` needs an ``@account``; ``teach`` takes a URL then comma-separated
    keywords; a command addressed to another bot is ignored.
    """
    t = as_col(text)
    m = r"^/([A-Za-z_]+)(?:@(\S+))?(?:\s|$)"
    cmd = F.lower(F.regexp_extract(t, m, 1))
    bot = F.regexp_extract(t, m, 2)
    rest = F.trim(F.regexp_extract(t, r"(?s)^/\S+\s+(.*)$", 1))
    for_me = (bot == "") | (bot == bot_name)
    known = cmd.isin(CHAT_COMMANDS) & for_me & t.startswith("/")
    command = F.when(known, cmd)
    url = F.nullif(F.regexp_extract(rest, r"^(https?://\S+)", 1), F.lit(""))
    after_url = F.trim(F.regexp_extract(rest, r"(?s)^https?://\S+\s*(.*)$", 1))
    # Taught keywords: the remainder after the URL, stripped of surrounding
    # whitespace, split on commas (elements kept as given).
    stripped = F.regexp_replace(after_url, r"^\s+|\s+$", "")
    keywords = F.when(command == "teach", F.split(stripped, ","))
    target = (F.when(command.isin("follow", "watch"), F.nullif(rest, F.lit("")))
              .when(command.isin("teach", "subscribe"), url))
    valid = (F.when(command.isNull(), F.lit(False))
             .when(command == "follow", F.coalesce(rest.startswith("@"), F.lit(False)))
             .when(command.isin("watch", "teach", "subscribe"), target.isNotNull())
             .otherwise(F.lit(True)))
    return F.struct(command.alias("command"), target.alias("target"),
                    keywords.alias("keywords"), valid.alias("valid"))
