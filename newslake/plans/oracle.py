"""DuckDB twins of the fixture mapping, used by the oracle SQL of every
registered query (``__spark_entry__.oracle_sql``).

``with_fixtures(body, *names)`` prefixes a query body with the CTEs it needs.
The definitions follow FIXTURES.md §3 exactly as ``newslake.sources.fixtures``
does in Spark.
"""

from __future__ import annotations


def sql_quote(expr: str) -> str:
    """DuckDB form of ``urls.quote``: keep ``/``, encode ``~``."""
    return f"replace(replace(url_encode({expr}), '%2F', '/'), '~', '%7E')"


def sql_quote_plus(expr: str) -> str:
    return f"replace(replace(url_encode({expr}), '%20', '+'), '~', '%7E')"


_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def sql_id_basis(expr: str) -> str:
    return (f"CASE WHEN contains({expr}, '//') THEN "
            f"lower(regexp_extract({expr}, '{_PARTS}', 1)) || '://' || "
            f"regexp_extract({expr}, '{_PARTS}', 2) || "
            f"regexp_replace(regexp_extract({expr}, '{_PARTS}', 3), ';[^/]*$', '') "
            f"ELSE {expr} END")


def sql_doc_id(expr: str) -> str:
    return f"md5({sql_quote(sql_id_basis(expr))})"


_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}]+'), lambda t: length(t) > 0)"

_LINK = "'https://' || d.source || '.example.com/' || d.lang || '/' || CAST(d.doc_id AS VARCHAR)"

CTES: dict[str, tuple[list[str], str]] = {
    "nd": ([], "nd AS (SELECT count(*) AS n FROM documents)"),
    "doc_updated": ([], "doc_updated AS (SELECT event_id // 5 AS doc_id, max(ts) AS updated "
                        "FROM events GROUP BY 1)"),
    "doc_topics": (["nd"], """doc_label AS (
  SELECT e.event_id % nd.n AS doc_id, e.event_type AS label, max(least(e.value, 100.0)) AS score
  FROM events e CROSS JOIN nd GROUP BY 1, 2),
doc_topics AS (
  SELECT doc_id, list(struct_pack(label := label, score := score) ORDER BY label, score) AS topics
  FROM doc_label WHERE doc_id % 7 <> 0 GROUP BY doc_id)"""),
    "doc_tags": ([], """doc_tags AS (
  SELECT doc_id, list_sort(list(token)) AS tags FROM (
    SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, token) AS rn FROM (
      SELECT doc_id, lower(regexp_replace(unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')), '[^A-Za-z]', '', 'g')) AS token FROM documents)
    WHERE length(token) > 2 GROUP BY doc_id, token) WHERE rn <= 8 GROUP BY doc_id)"""),
    "doc_titles": ([], f"""title_sents AS (
  SELECT doc_id, pos, trim(s) AS sentence FROM (
    SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM (
      SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS ss FROM documents)) WHERE length(trim(s)) > 0),
title_words AS (SELECT doc_id, pos, unnest({_WORDS.format('sentence')}) AS token FROM title_sents),
title_counts AS (SELECT doc_id, token, count(*) AS c FROM title_words GROUP BY doc_id, token),
doc_titles AS (
  SELECT doc_id, sentence AS title FROM (
    SELECT w.doc_id, w.pos FROM title_words w JOIN title_counts c ON c.doc_id = w.doc_id AND c.token = w.token
    GROUP BY w.doc_id, w.pos QUALIFY row_number() OVER (PARTITION BY w.doc_id ORDER BY avg(c.c) DESC, w.pos) = 1)
  JOIN title_sents USING (doc_id, pos))"""),
    "docs": (["doc_updated", "doc_topics", "doc_tags", "doc_titles"], f"""docs AS (
  SELECT d.doc_id, d.text, d.lang, d.source AS origin,
         {_LINK} AS link,
         {sql_doc_id(_LINK)} AS id,
         h.title,
         CASE WHEN d.doc_id % 5 <> 0 THEN 'author' || CAST(d.doc_id % 11 AS VARCHAR) END AS author,
         coalesce(g.tags, []) AS tags,
         CAST(NULL AS VARCHAR) AS summary,
         'rss' AS format, 'rss' AS source_type,
         u.updated, t.topics
  FROM documents d LEFT JOIN doc_updated u ON u.doc_id = d.doc_id
       LEFT JOIN doc_topics t ON t.doc_id = d.doc_id LEFT JOIN doc_tags g ON g.doc_id = d.doc_id
       LEFT JOIN doc_titles h ON h.doc_id = d.doc_id)"""),
    "now_t": (["docs"], "now_t AS (SELECT CAST(date_trunc('day', max(updated)) AS TIMESTAMP) "
                        "+ INTERVAL 1 DAY AS now FROM docs)"),
    "sources": ([], """sources AS (
  SELECT DISTINCT source AS id, 'Source ' || source AS title FROM documents WHERE source <> 'src19')"""),
    "topics": ([], """topics AS (
  SELECT * FROM (VALUES ('topic:articles', 'articles', ['the', 'that', 'was']),
                        ('topic:joins', 'joins', ['and', 'for']),
                        ('topic:german', 'german', ['der', 'die', 'und']),
                        ('topic:empty', 'empty', ['zzz'])) AS t(id, title, tags))"""),
    "models": ([], """models AS (
  SELECT * FROM (VALUES ('model:alpha', 'alpha', ['articles', 'joins'], 50, 'en'),
                        ('model:beta', 'beta', ['german', 'empty'], 30, 'de'))
         AS m(id, title, related_topics, "limit", lang))"""),
    "votes": (["nd"], """votes AS (
  SELECT e.event_id, e.event_id % nd.n AS doc_id, CAST(e.user_id AS VARCHAR) AS voter,
         CAST(e.user_id AS VARCHAR) AS name,
         CASE e.event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS score, e.ts
  FROM events e CROSS JOIN nd WHERE e.event_type IN ('click', 'view', 'purchase'))"""),
    "chat": ([], """chat AS (
  SELECT conv_id * 1000 + turn AS message_id, conv_id AS chat_id, turn,
         CASE turn % 3 WHEN 0 THEN '/teach https://x.example.com/' || CAST(conv_id AS VARCHAR) || ' a,b '
                       WHEN 1 THEN '/follow @u' || CAST(conv_id AS VARCHAR) || ' '
                       ELSE '/watch q' || CAST(conv_id AS VARCHAR) || ' ' END || text AS text,
         conv_id AS from_id, 'u' || CAST(conv_id AS VARCHAR) AS first_name
  FROM conversations WHERE role = 'user')"""),
}


def _resolve(names, seen, out):
    for n in names:
        if n in seen:
            continue
        deps, sql = CTES[n]
        _resolve(deps, seen, out)
        seen.add(n)
        out.append(sql)


def with_fixtures(body: str, *names: str, recursive: bool = False) -> str:
    """``WITH <fixture CTEs>, <body>``; ``body`` may start with more CTEs
    (``x AS (...), ... SELECT``) or be a plain SELECT."""
    out: list[str] = []
    _resolve(names, set(), out)
    body = body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not out:
        return body if body.upper().startswith("SELECT") else head + body
    if body.upper().startswith("SELECT"):
        return head + ",\n".join(out) + "\n" + body
    return head + ",\n".join(out) + ",\n" + body
