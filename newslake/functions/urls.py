"""URL and id Column functions.

All of them are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newslake.functions._util import as_col

# Fixed values that must equal the reference's behaviour.
# URL validity pattern (http/ftp(s), domain, localhost or IPv4, optional port,
# optional path), case-insensitive.
URL_VALID_PATTERN = (
    r"(?i)^(?:http|ftp)s?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|"
    r"localhost|"
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?"
    r"(?:/?|[/?]\S+)$"
)
# Default exclusion lists (regex fragments); N4: callers may pass their own.
EXCLUDED_FILE_EXTENSIONS = [r"\.iso", r"\.mp3", r"\.mp4", r"\.bin", r"\.rom", r"\.zip",
                            r"\.tar", r"\.tgz", r"\.xz", r"\.img"]
EXCLUDED_URIS = [r"sourceforge\.net"]

# scheme://netloc path, the parts an id is built from (query, fragment and
# ;params of the last segment are dropped).
_URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def quote(c) -> Column:
    """Percent-encoding that keeps letters, digits, ``_ . -`` and ``/``
    (space becomes ``%20``)."""
    enc = F.url_encode(as_col(c))
    enc = F.replace(enc, F.lit("+"), F.lit("%20"))
    enc = F.replace(enc, F.lit("*"), F.lit("%2A"))
    return F.replace(enc, F.lit("%2F"), F.lit("/"))


def quote_plus(c) -> Column:
    """Like :func:`quote` but ``/`` is encoded and space becomes ``+``."""
    enc = F.url_encode(as_col(c))
    return F.replace(enc, F.lit("*"), F.lit("%2A"))


def unquote(c) -> Column:
    """Decode ``%XX``; a literal ``+`` stays ``+`` (unlike form decoding)."""
    protected = F.replace(as_col(c), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(protected), as_col(c))


def url_scheme(c) -> Column:
    return F.lower(F.regexp_extract(as_col(c), _URL_PARTS, 1))


def url_netloc(c) -> Column:
    return F.regexp_extract(as_col(c), _URL_PARTS, 2)


def url_path(c) -> Column:
    path = F.regexp_extract(as_col(c), _URL_PARTS, 3)
    return F.regexp_replace(path, r";[^/]*$", "")


def id_basis(c) -> Column:
    """The string an id is hashed from: ``scheme://netloc+path`` when the link
    contains ``//``, else the whole link."""
    link = as_col(c)
    return F.when(
        F.contains(link, F.lit("//")),
        F.concat(url_scheme(link), F.lit("://"), url_netloc(link), url_path(link)),
    ).otherwise(link)


def doc_id(c) -> Column:
    """Stable id of an object from its link: md5 of the quoted basis."""
    return F.md5(quote(id_basis(c)))


def status_id(c) -> Column:
    """First ``/digits`` group of a status URL (null when absent)."""
    return F.nullif(F.regexp_extract(as_col(c), r"/([0-9]+)/?", 1), F.lit(""))


def domain(url, fallback=None) -> Column:
    """Host of an http(s) URL, else the fallback column (the doc source)."""
    host = F.nullif(F.regexp_extract(as_col(url), r"https?://([^/]+)", 1), F.lit(""))
    return host if fallback is None else F.coalesce(host, as_col(fallback))


def is_valid_url(c) -> Column:
    """C11."""
    return F.coalesce(as_col(c).rlike(URL_VALID_PATTERN), F.lit(False))


def _alternation(patterns: list[str]) -> str:
    return "(" + ")|(".join(patterns) + ")"


def not_excluded_uri(url, patterns: list[str] | None = None) -> Column:
    """Keep URLs that match none of the exclusion patterns (search
    semantics, not anchored)."""
    pats = EXCLUDED_URIS if patterns is None else patterns
    if not pats:
        return F.lit(True)
    return ~F.coalesce(as_col(url).rlike(_alternation(pats)), F.lit(False))


def not_excluded_type(url, content_type=None, patterns: list[str] | None = None) -> Column:
    """The URL path must not end in an excluded extension and the content
    type must not match one."""
    pats = EXCLUDED_FILE_EXTENSIONS if patterns is None else patterns
    if not pats:
        return F.lit(True)
    ext_at_end = "(" + _alternation(pats) + r")([?#].*)?$"
    bad = F.coalesce(as_col(url).rlike(ext_at_end), F.lit(False))
    if content_type is not None:
        bad = bad | F.coalesce(as_col(content_type).rlike(_alternation(pats)), F.lit(False))
    return ~bad


def meta_refresh_target(html) -> Column:
    """I16: URL of ``<meta http-equiv=Refresh content="n;url=...">``."""
    pat = r"(?is)<meta[^>]*http-equiv=.?refresh[^>]*content=.?[0-9]*;\s*url=([^\"'>\s]+)"
    return F.nullif(F.regexp_extract(as_col(html), pat, 1), F.lit(""))


def share_links(title, link, topics_text, hashtags) -> Column:
    """Twitter, linkedin and reddit share URLs from the title, the link,
    the topic text and the first three hashtags (all ``quote_plus``-encoded)."""
    t, l = quote_plus(title), quote_plus(link)
    tags3 = F.slice(F.coalesce(as_col(hashtags), F.array().cast("array<string>")), 1, 3)
    tag_part = F.array_join(F.transform(tags3, lambda x: F.concat(F.lit("%20#"), quote_plus(x))), "")
    return F.struct(
        F.concat(F.lit("https://twitter.com/intent/tweet?text="), t, F.lit("%20"), l).alias("twitter"),
        F.concat(F.lit("https://www.linkedin.com/shareArticle?mini=true&url="), l,
                 F.lit("&summary="), t, F.lit("%20#"), quote_plus(F.coalesce(as_col(topics_text), F.lit(""))),
                 tag_part).alias("linkedin"),
        F.concat(F.lit("https://www.reddit.com/submit?url="), l).alias("reddit"),
    )


def cve_links(cves) -> Column:
    """Markdown link per extracted CVE id, comma separated."""
    return F.array_join(
        F.transform(as_col(cves), lambda v: F.concat(F.lit("["), v, F.lit("](https://nvd.nist.gov/vuln/detail/"), v, F.lit(")"))),
        ", ")


def registry_link(kind: str, title) -> Column:
    """Id link of a topic or model from its title."""
    return F.concat(F.lit(f"/api/{kind}/"), doc_id(F.concat(F.lit(f"{kind}:"), as_col(title))))
