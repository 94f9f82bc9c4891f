"""J8 + C9 on a stored index: postings instead of texts.

``write_index`` stores for each (term, document) how often, where, how long the
document is. The documents of a block (a few MB of text) share one row for each
term, with an array for each of these columns; a task writes the rows of its
blocks to folders by a hash of the term, sorted by term in each file, and no
posting is shuffled. A search reads only the asked terms' folders and row groups
(``PartitionFilters`` and a pushed ``IN``) and groups their entries by document; it
never opens a text. A term of half the corpus has a row in each block, so it is
dealt over many writers and readers.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.types import StructType

from newslake.operators import query_string as Q
from newslake.operators.partitioning import spread
from newslake.operators.search import BM25_B, BM25_K1, TOKEN_SPLIT, bm25, query_match

BUCKETS = 64
# Bytes of text whose documents share the rows of their terms; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
# A stored position is the number of the field times this and the token's place in the field.
FIELD = 1 << 40


@dataclass(frozen=True)
class Index:
    blocks: DataFrame  # bucket, term, df, n, and an array each: key, tf, dl, pos
    totals: DataFrame  # n, avgdl
    fields: list[str]
    key: str
    buckets: int

    @property
    def postings(self) -> DataFrame:
        """(bucket, term, key, tf, dl, pos), a row for each term of each document."""
        return entries(self.blocks, [self.key, "tf", "dl", "pos"])


def entries(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """The named arrays of the rows of ``blocks``, an element a row."""
    return blocks.select("bucket", "term", F.inline(F.arrays_zip(*columns)))


def _grouper(packed: bool):
    """The postings of documents given as a key and, for each field, its tokens
    with spaces between them: a row for each (term, document), or, ``packed``, for
    each term of a block. The tokens of a block are numbered and sorted at once."""
    at_once, apart = BLOCK_BYTES, FIELD

    def grouped(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def lists(ends, values):
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

        for batch in batches:
            sizes = sum(np.asarray(pc.binary_length(c), np.int64) for c in batch.columns[1:])
            block = np.cumsum(sizes + 1) // at_once
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
            for docs in (batch.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:]) if hi > lo):
                n, fields = docs.num_rows, docs.num_columns - 1
                begins = np.zeros((n, fields + 1), np.int32)
                words, owners, places = [], [], []
                for f, column in enumerate(docs.columns[1:]):
                    split = pc.split_pattern(column, " ")
                    found = split.flatten()
                    kept = pc.greater(pc.binary_length(found), 0)
                    doc = np.repeat(np.arange(n), np.asarray(pc.list_value_length(split)))[np.asarray(kept, bool)]
                    counts = np.bincount(doc, minlength=n)
                    words.append(found.filter(kept))
                    owners.append(doc)
                    places.append((f * apart if packed else begins[doc, f]) + np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc])
                    begins[:, f + 1] = begins[:, f] + counts + 1
                numbered = pa.concat_arrays(words).dictionary_encode()
                if not len(numbered):
                    continue
                term, doc, pos = numbered.indices.to_numpy().astype(np.int64), np.concatenate(owners), np.concatenate(places)
                order = np.argsort(term * n + doc, kind="stable")  # the tokens of one document stay in their order
                term, doc, pos = term[order], doc[order], pos[order]
                first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))))
                ends = np.append(first, len(term))
                tf, term, row = np.diff(ends), term[first], pa.array(doc[first])
                names, columns = [docs.schema.names[0], "tf", "dl"], [docs.column(0).take(row), pa.array(tf, pa.int32()), pa.array(begins[:, -1] - fields, pa.int32()).take(row)]
                if not packed:
                    names.append("starts")
                    columns.append(lists(np.arange(n + 1) * (fields + 1), pa.array(begins.ravel())).take(row))
                names.append("pos")
                columns.append(lists(ends, pa.array(pos, pa.int64() if packed else pa.int32())))
                if packed:
                    first = np.flatnonzero(np.diff(term, prepend=-1))
                    ends, term = np.append(first, len(term)), term[first]
                    columns = [pa.array(np.diff(ends), pa.int32()), pa.array(np.add.reduceat(tf, first), pa.int64()), *[lists(ends, c) for c in columns]]
                    names = ["df", "n", *names]
                yield pa.RecordBatch.from_arrays([numbered.dictionary.take(pa.array(term)), *columns], ["term", *names])
    return grouped


def postings_of(docs: DataFrame, fields: list[str], key: str, packed: bool = False) -> DataFrame:
    """(term, key, tf, dl, starts, pos): each term of each document once. The
    tokens of all fields are numbered in a row with a gap between fields;
    ``starts`` are the numbers where fields begin (and one more), ``pos`` those
    of the term. Terms are grouped block by block in Arrow batches. ``packed``: a row
    for each term of a block, with its ``df`` documents and ``n`` occurrences and
    arrays of key, tf, dl and pos; positions name their field (see ``FIELD``)
    in place of ``starts``."""
    toks = spread(docs).select(key, *[F.regexp_replace(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), TOKEN_SPLIT, " ").alias(f"__{i}") for i, f in enumerate(fields)])
    integer, ints = T.IntegerType(), T.ArrayType(T.IntegerType())
    kinds = {key: toks.schema[key].dataType, "tf": integer, "dl": integer}
    if packed:
        kinds = {"df": integer, "n": T.LongType(), **{c: T.ArrayType(k) for c, k in {**kinds, "pos": T.ArrayType(T.LongType())}.items()}}
    else:
        kinds |= {"starts": ints, "pos": ints}
    return toks.mapInArrow(_grouper(packed), T.StructType([T.StructField(c, k) for c, k in {"term": T.StringType(), **kinds}.items()]))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, path: str, fields: list[str], key: str = "id", buckets: int = BUCKETS) -> None:
    """Stores the index of ``docs`` under ``path``. A task writes the terms of its
    own documents, so nothing is shuffled and a frequent term has many writers."""
    rows = postings_of(docs, fields, key, packed=True).withColumn("bucket", bucket_of(F.col("term"), buckets))
    rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path + "/postings")
    # The lengths of all documents add up to the occurrences of all terms.
    written = docs.sparkSession.read.schema(rows.schema).parquet(path + "/postings").agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    totals = docs.agg(F.count(F.lit(1)).alias("n")).select("n", (written / F.when(F.col("n") > 0, F.col("n"))).alias("avgdl"))
    totals.select("*", F.lit(key).alias("key"), F.lit(buckets).alias("buckets"), F.array(*[F.lit(f) for f in fields]).alias("fields"),
                  F.lit(rows.schema.json()).alias("schema")).write.mode("overwrite").parquet(path + "/totals")


def read_index(spark, path: str) -> Index:
    totals = spark.read.parquet(path + "/totals")
    r = totals.select("key", "buckets", "fields", "schema").first()
    return Index(spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(path + "/postings"), totals.select("n", "avgdl"), list(r["fields"]), r["key"], r["buckets"])


def _asked(index: Index, terms: list[str]) -> DataFrame:
    """The rows of the terms: folders and row groups are skipped by literals."""
    folders = sorted({zlib.crc32(t.encode()) % index.buckets for t in terms})
    return index.blocks.filter(F.col("bucket").isin(folders) & F.col("term").isin(terms))


def hits(index: Index, query: Q.Clauses, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(key, __match, score) of each document with one of the query's terms:
    whether it matches, and the BM25 of the terms that are not forbidden, over
    all fields. Two reads of the asked terms: one for the documents, one (of the
    blocks' counts) for how many each term has."""
    terms, scored = Q.terms_of(query), Q.terms_of(query, positive=True)
    placed = {t for w in Q.leaves(query) if len(w.terms) > 1 or w.field for t in w.terms}
    rows = entries(_asked(index, terms), [index.key, "tf", "dl", *(["pos"] if placed else [])])
    aggs = [F.max("dl").alias("dl"), *[F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)]]
    if placed:
        aggs += [F.max(F.when(F.col("term") == t, F.col("pos"))).alias(f"p{i}") for i, t in enumerate(terms) if t in placed]
    found = rows.groupBy(index.key).agg(*aggs)
    number = {t: i for i, t in enumerate(terms)}

    def leaf(w: Q.Words) -> Column:
        first = number[w.terms[0]]
        if len(w.terms) == 1 and not w.field:
            return F.col(f"tf{first}").isNotNull()
        if w.field and w.field not in index.fields:
            return F.lit(False)

        def here(x):
            ok = F.lit(True)
            for k, t in enumerate(w.terms[1:], 1):
                ok = ok & F.coalesce(F.array_contains(f"p{number[t]}", x + k), F.lit(False))
            if w.field:
                f = index.fields.index(w.field)
                ok = ok & (x >= f * FIELD) & (x < (f + 1) * FIELD)
            return ok
        return F.coalesce(F.exists(f"p{first}", here), F.lit(False))

    dfs = _asked(index, terms).groupBy("term").agg(F.sum("df").alias("df")).select(
        F.map_from_entries(F.collect_list(F.struct("term", "df")))).scalar()  # a row for each asked term
    totals = index.totals.select(F.struct("n", "avgdl")).scalar()
    score = F.lit(0.0)
    for t in scored:
        tf = F.col(f"tf{number[t]}").cast("double")
        df = F.coalesce(F.try_element_at(dfs, F.lit(t)), F.lit(0))
        idf = F.log((totals.getField("n") - df + 0.5) / (df + 0.5) + 1.0)
        norm = tf + k1 * (1 - b + b * F.col("dl") / totals.getField("avgdl"))
        score = score + F.coalesce(idf * tf * (k1 + 1) / norm, F.lit(0.0))
    return found.select(index.key, Q.condition(query, leaf).alias("__match"), score.alias("__score"))


def search(docs: DataFrame, index: Index, q: str, score_col: str = "score", default: str = "or") -> DataFrame:
    """The documents of ``docs`` that match ``q`` (see ``query_string``), with their
    relevance. Only keys and scores are joined to ``docs``; an empty query
    matches all with 1.0, a document that matches only by what it lacks has 0."""
    query = Q.parse(q, default)
    if query.empty:
        return docs.withColumn(score_col, F.lit(1.0))
    found = hits(index, query)
    if not Q.matches_nothing_found(query):
        return docs.join(found.filter("__match"), index.key).withColumn(score_col, F.col("__score")).drop("__match", "__score")
    out = docs.join(found, index.key, "left").filter(F.coalesce("__match", F.lit(True)))
    return out.withColumn(score_col, F.coalesce("__score", F.lit(0.0))).drop("__match", "__score")


def search_docs(docs: DataFrame, corpus: DataFrame, q: str | None, fields: list[str], index: Index | None = None) -> DataFrame:
    """``docs`` with a ``score`` that match the query string ``q`` (all of them
    without one): from the stored index if there is one, else from the texts,
    with the statistics of ``corpus``."""
    query = Q.parse(q or "")
    if query.empty:
        return docs.withColumn("score", F.lit(1.0))
    if index is not None:
        return search(docs, index, q)
    matching = docs.filter(query_match(fields, q))
    words = Q.terms_of(query, positive=True)
    if not words:
        return matching.withColumn("score", F.lit(0.0))
    return bm25(matching, " ".join(words), fields, corpus=corpus, mode="score")
