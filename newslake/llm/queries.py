"""The driver's queries over the operators of this folder, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.llm import chat, decontam, html_extract, licenses, neighbours, periodic_runs, pii, quality, sentencepiece_codec, token_counts, toxicity, whitening
from newslake.llm.common import Scratch, table
from newslake.llm.jaccard import jaccard_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 90 * (x.n + y.n - inter)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""


@query(OP8_SQL)
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its 3-word shingle set and the smallest
    doc_id reachable over links of Jaccard similarity 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), percent=90, k=3)


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity by a non-negative PU classifier that
    learns from the labels outside the held-out rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~toxicity.held_out("doc_id"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= toxicity.Limits().threshold).cast("int").alias("predicted"))


@query()
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = """
WITH w AS (SELECT 0 AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents
           UNION ALL SELECT 1, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') FROM benchmark),
g AS (SELECT DISTINCT side, id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT side, id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM g WHERE side = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n AS item_shingles, count(*) AS shared, round(count(*) / n.n, 6) AS containment
FROM g b JOIN n ON n.id = b.id JOIN g d ON d.side = 0 AND d.g = b.g WHERE b.side = 1
GROUP BY d.id, b.id, n.n HAVING count(*) * 100 >= 80 * n.n
"""


@query(OP3_SQL)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item of whose 5-word shingles it
    holds 80 % or more."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Where the driver's box keeps the public vocabularies; a parameter of the operators.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


@query()
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its token ids, and whether they decode to the text."""
    docs = sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{TOKENIZERS}/piece_bpe_32k.model", check="round_trip")
    return docs.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


@query()
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


OP9_SQL = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS n_letters,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters FROM w),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
ln AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) - count(DISTINCT line) FILTER (WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS n_dup_lines,
        count(*) FILTER (WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS n_lines, count(*) FILTER (WHERE line <> '') AS n_runs,
        count(*) FILTER (WHERE line LIKE '%...') AS n_cut FROM l GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
top AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY doc_id, x) GROUP BY doc_id),
b AS (SELECT c.*, n_dup_lines, n_lines, n_runs, n_cut, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(most, 0) AS most,
        n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
      FROM c JOIN ln USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN top USING (doc_id))
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words) AND NOT 4 * n_symbols > n_words AND NOT 10 * n_dup_lines > 3 * n_lines
       AND NOT 10 * n_letters < 6 * n_words AND NOT 2 * upper > letters AND NOT (n_runs >= 3 AND 10 * n_cut > 3 * n_runs) AND NOT 10 * most > 3 * n_words AS kept
FROM b
"""


@query(OP9_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base statistics and the verdict of the cascade."""
    return quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *quality.BASE, "base_failed", "kept")


OP1_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([\\[<])(~*/?(?:INST|NEXT|s)[\\]>])', '\\1~\\2', 'g')) AS n, length(regexp_replace(role, '([\\[<])(~*/?(?:INST|NEXT|s)[\\]>])', '\\1~\\2', 'g')) AS r,
        coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS again FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n + CASE WHEN again THEN 6 ELSE 17 + r END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query(OP1_SQL)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted; the figures
    are read back from the formatted string and the loss mask."""
    odd = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    out = chat.format_chats(turns.unionByName(more))
    read = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where a document holds a licence template."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact histogram of encoded lengths of all documents, with the answers for every context limit."""
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents").select("text"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", f"{TOKENIZERS}/byte_bpe_50k.json")
    # Written once: the answers read the histogram twice, and documents are encoded once.
    return token_counts.limits(Scratch(spark, "lengths").save(token_counts.histogram(lengths)))


OP13_SQL = """
WITH RECURSIVE k(i, step, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, step + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM k WHERE step < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM k WHERE step = 8),
ids AS (SELECT doc_id, text, [4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: unicode(x)::BIGINT) AS b FROM documents),
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM ids, tab),
g AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
o AS (SELECT doc_id, n, a, 1 + (n - a) // (3 + g % 8) AS p, unnest(range(n)) AS i, unnest(w) AS w FROM g),
x AS (SELECT o.doc_id, o.n, o.i, src.w FROM o JOIN o src ON src.doc_id = o.doc_id AND src.i = CASE WHEN o.a IS NULL OR o.i < o.a THEN o.i ELSE o.a + (o.i - o.a) % o.p END),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM x JOIN x y ON y.doc_id = x.doc_id AND y.w = x.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM m),
st AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isl GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM st GROUP BY doc_id, start, length),
total AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS sha FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
kept AS (SELECT x.doc_id, string_agg(x.w, ' ' ORDER BY x.i) AS t FROM x
         WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, coalesce(sha, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN total USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query(OP13_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, one in ten with a periodic end, with its periodic runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    found = periodic_runs.find_runs(docs, rewrite=periodic_runs.planted("h"))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


OP11_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query(OP11_SQL)
def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows with the largest inner product for every 20th vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every complete vector, whitened along the first 32 components. A deviation beyond a long is null."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 32)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
