"""Full-text match, BM25 relevance and the overall score.

``postings`` answers the same queries from a stored index; this module works on
the docs themselves, for stores without one.

Plan shape: the query terms are a parameter (a handful of strings), so term
frequencies are computed per doc as ``size(filter(tokens, t -> t = term))``
columns -- no explode, no shuffle of the corpus. The corpus statistics
(doc count, average length, document frequency per term) are one global
aggregate evaluated as scalar subqueries.
"""

from __future__ import annotations

import ast
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from newslake.functions._util import as_col

# BM25 parameters of the default similarity.
BM25_K1 = 1.2
BM25_B = 0.75
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# Default overall score: relevance times the mean topic probability.
DEFAULT_OVERALL_SCORE = "es_score*(sum(topics_scores)/len(topics_scores))"


def tokens(c) -> Column:
    """Lower-cased letter/digit tokens (the search analyser)."""
    return F.filter(F.split(F.lower(as_col(c)), TOKEN_SPLIT), lambda t: F.length(t) > 0)


def query_terms(q: str) -> list[str]:
    """Terms of a simple query string, analysed like the documents."""
    return re.findall(r"[^\W_]+", q.lower())  # letters and digits, as in TOKEN_SPLIT


def searchable(df: DataFrame, fields: list[str]) -> Column:
    """Concatenation of the searchable fields (the ``_all`` field)."""
    return F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])


def text_match(tok: Column, terms: list[str], mode: str = "any", phrase_text: Column | None = None) -> Column:
    """``all`` terms, ``any`` term, or ``phrase`` (normalised contains)."""
    if not terms:
        return F.lit(True)
    if mode == "phrase":
        norm = F.concat(F.lit(" "), F.array_join(tok, " "), F.lit(" "))
        return F.contains(norm, F.lit(" " + " ".join(terms) + " "))
    hits = [F.array_contains(tok, F.lit(t)) for t in terms]
    out = hits[0]
    for h in hits[1:]:
        out = (out & h) if mode == "all" else (out | h)
    return out


def query_match(df_fields: list[str], q: str, default: str = "or") -> Column:
    """C9 without an index: the query string ``q`` as one Column over the named
    text columns (see ``query_string``); phrases lie within one column."""
    from newslake.operators import query_string as Q

    def leaf(w):
        fields = [f for f in df_fields if w.field in (None, f)]
        found = [text_match(tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))), list(w.terms), "phrase" if len(w.terms) > 1 else "all") for f in fields]
        return reduce(Column.__or__, found) if found else F.lit(False)
    return Q.condition(Q.parse(q, default), leaf)


def _equals(term: str):
    return lambda t: t == F.lit(term)


def term_stats(corpus: DataFrame, fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The corpus statistics of BM25, built once per store version (the
    "index"): ``terms(term, df)`` -- documents per term -- and
    ``totals(n, avgdl)``. Stored sorted by term, a query's lookups are pushed
    filters on a small table instead of a pass over every text."""
    from newslake.operators.partitioning import spread
    fields = fields or ["text"]
    tokd = spread(corpus).select(tokens(searchable(corpus, fields)).alias("__tok"))
    per_doc = tokd.select(F.array_distinct("__tok").alias("terms"), F.size("__tok").alias("dl"))
    terms = per_doc.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    totals = per_doc.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return terms, totals


def write_term_stats(corpus: DataFrame, path: str, fields: list[str] | None = None) -> None:
    terms, totals = term_stats(corpus, fields)
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path + "/terms")
    totals.write.mode("overwrite").parquet(path + "/totals")


def read_term_stats(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(path + "/terms"), spark.read.parquet(path + "/totals")


def _matching(n: int, mode: str) -> Column:
    """Rows with ``any`` or ``all`` of ``n`` counted terms; ``score`` keeps all rows."""
    if mode == "score":
        return F.lit(True)
    return reduce(Column.__and__ if mode == "all" else Column.__or__, [F.col(f"__tf{i}") > 0 for i in range(n)])


def bm25(docs: DataFrame, q: str, fields: list[str] | None = None, corpus: DataFrame | None = None,
         score_col: str = "score", mode: str = "any", k1: float = BM25_K1, b: float = BM25_B,
         stats: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """BM25 of ``q`` over ``fields`` for every doc of ``docs`` that
    matches (``mode``). The statistics (N, avgdl, df) come from ``stats``
    (see ``term_stats``) when given, else from one aggregate over ``corpus``
    (default: ``docs`` itself). Without terms every doc scores 1.0."""
    fields = fields or ["text"]
    terms = list(dict.fromkeys(query_terms(q)))
    if not terms:
        return docs.withColumn(score_col, F.lit(1.0))
    if stats is not None:
        return _bm25_with(docs, terms, fields, stats, score_col, mode, k1, b)
    corpus = docs if corpus is None else corpus

    def with_tf(df):
        # Tokens once per row as a column, then one size per term.
        tok = F.col("__tok")
        cols = [F.size(tok).alias("__dl")]
        cols += [F.size(F.filter(tok, _equals(term))).alias(f"__tf{i}") for i, term in enumerate(terms)]
        return df.withColumn("__tok", tokens(searchable(df, fields))).select("*", *cols).drop("__tok")

    stats_src = with_tf(corpus.select(*fields))
    stats = stats_src.agg(F.count(F.lit(1)).alias("n"), F.avg("__dl").alias("avgdl"),
                          *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    # One scalar subquery (one pass over the corpus) for all statistics.
    st = stats.select(F.struct(*stats.columns)).scalar()
    n, avgdl = st.getField("n"), st.getField("avgdl")
    scored = with_tf(docs)
    total = F.lit(0.0)
    for i in range(len(terms)):
        df_i = st.getField(f"df{i}")
        idf = F.log((n - df_i + 0.5) / (df_i + 0.5) + 1.0)
        tf = F.col(f"__tf{i}").cast("double")
        norm = tf + k1 * (1 - b + b * F.col("__dl") / avgdl)
        total = total + F.when(tf > 0, idf * tf * (k1 + 1) / norm).otherwise(F.lit(0.0))
    out = scored.filter(_matching(len(terms), mode)).withColumn(score_col, total)
    return out.drop("__dl", *[f"__tf{i}" for i in range(len(terms))])


def _bm25_with(docs, terms, fields, stats, score_col, mode, k1, b) -> DataFrame:
    terms_df, totals = stats
    tot = totals.select(F.struct("n", "avgdl")).scalar()
    # One lookup of the query terms in the term table (a pushed IN filter).
    dfs = terms_df.filter(F.col("term").isin(terms)).select(
        F.map_from_entries(F.collect_list(F.struct("term", "df")))).scalar()
    tok = F.col("__tok")
    scored = (docs.withColumn("__tok", tokens(searchable(docs, fields)))
              .select("*", F.size(tok).alias("__dl"),
                      *[F.size(F.filter(tok, _equals(t))).alias(f"__tf{i}") for i, t in enumerate(terms)])
              .drop("__tok"))
    total = F.lit(0.0)
    for i, t in enumerate(terms):
        df_i = F.coalesce(F.try_element_at(dfs, F.lit(t)), F.lit(0))
        idf = F.log((tot.getField("n") - df_i + 0.5) / (df_i + 0.5) + 1.0)
        tf = F.col(f"__tf{i}").cast("double")
        norm = tf + k1 * (1 - b + b * F.col("__dl") / tot.getField("avgdl"))
        total = total + F.when(tf > 0, idf * tf * (k1 + 1) / norm).otherwise(F.lit(0.0))
    out = scored.filter(_matching(len(terms), mode)).withColumn(score_col, total)
    return out.drop("__dl", *[f"__tf{i}" for i in range(len(terms))])


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


# What a score formula may call.
FORMULA_CALLS = {
    "sum": _total, "len": F.size, "mean": lambda c: _total(c) / F.size(c), "avg": lambda c: _total(c) / F.size(c),
    "max": lambda *c: F.array_max(c[0]) if len(c) == 1 else F.greatest(*c),
    "min": lambda *c: F.array_min(c[0]) if len(c) == 1 else F.least(*c),
    "log": lambda c: F.log(c), "ln": lambda c: F.log(c), "log10": F.log10, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs,
    "pow": F.pow, "round": lambda c: F.round(c),
}
_OPERATIONS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
               ast.Div: lambda a, b: a / b, ast.Pow: F.pow}


def score_formula(text: str, names: dict[str, Column]) -> Column:
    """A formula of numbers, the given names, ``+ - * / **`` and the calls
    of ``FORMULA_CALLS`` as a Column. Anything else (sub-queries, other names
    or functions, attributes) raises ValueError."""
    def column(node) -> Column:
        if isinstance(node, ast.Expression):
            return column(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in names:
            return names[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATIONS:
            return _OPERATIONS[type(node.op)](column(node.left), column(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -column(node.operand) if isinstance(node.op, ast.USub) else column(node.operand)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FORMULA_CALLS and not node.keywords:
            return FORMULA_CALLS[node.func.id](*map(column, node.args))
        raise ValueError(f"not allowed in a score formula: {ast.dump(node)[:80]}")
    try:
        return column(ast.parse(text.strip(), mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"not a score formula: {text!r}") from e


def with_overall_score(df: DataFrame, es_score: str = "score", topics: str = "topics",
                       formula: str = DEFAULT_OVERALL_SCORE, out: str = "overall_score") -> DataFrame:
    """A user formula over ``es_score`` and ``topics_scores`` (topic
    scores scaled to 0..1, see ``score_formula``); 0 for docs without topics."""
    t = F.col(topics)
    value = score_formula(formula, {"es_score": F.col(es_score).cast("double"),
                                    "topics_scores": F.transform(t, lambda x: x["score"] / 100.0)})
    return df.withColumn(out, F.when(F.size(t) > 0, value).otherwise(F.lit(0.0)))
