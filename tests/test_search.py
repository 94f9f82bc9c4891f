"""Query strings and the stored index against plain Python on hand-made docs."""

import math
import re

import pytest
from pyspark.sql import functions as F

from newslake.operators import postings as PO, query_string as Q, search as S

FIELDS = ["title", "text"]
DOCS = [(1, "Red apple", "the red apple fell from the tree"), (2, "Green", "a green apple; the tree is red"), (3, None, "no fruit here"),
        (4, "apple red", ""), (5, "", None), (6, "Pear's day", "pear pear pear, apple"), (7, "Obst", "Äpfel und Birnen"), (8, "red", "apple")]


def toks(s):
    return re.findall(r"[^\W_]+", (s or "").lower())


def brute(q, default="or"):
    """Ids by evaluating the clauses on Python lists."""
    tree = Q.parse(q, default)

    def occurs(w, doc):
        for f, value in zip(FIELDS, doc[1:]):
            t = toks(value)
            n = len(w.terms)
            if w.field in (None, f) and any(tuple(t[i:i + n]) == w.terms for i in range(len(t) - n + 1)):
                return True
        return False

    def match(node, doc):
        if isinstance(node, Q.Words):
            return occurs(node, doc)
        return (all(match(c, doc) for c in node.must) and not any(match(c, doc) for c in node.must_not)
                and (bool(node.must) or not node.should or any(match(c, doc) for c in node.should)))
    return {d[0] for d in DOCS if match(tree, d)}


QUERIES = ["apple", "apple pear", '"red apple"', "red AND apple", "red && green", "apple NOT red", "apple -red", "+apple +tree -green", "(pear OR green) AND apple",
           "title:red", "title:red -text:apple", 'text:"the tree"', 'title:"red apple" OR title:"apple red"', "title:(red OR green)", "NOT red", "-apple -red", "red OR NOT apple",
           "nothing:red", "-nothing:red", "pear's", "äpfel", '"apple the"', "a AND", "((apple", '"red app', "***", "", "apple AND (NOT red)", "(-red) AND apple", "red AND NOT (apple OR tree)", '"tree is" "fell from"', "!red || apple"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id int, title string, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    PO.write_index(docs, path, FIELDS, buckets=4)
    return PO.read_index(spark, path)


def test_every_query_by_text_and_by_index(docs, index):
    rows = docs.select("id", *[S.query_match(FIELDS, q).alias(str(i)) for i, q in enumerate(QUERIES)]).collect()
    for i, q in enumerate(QUERIES):
        want = brute(q)
        assert {r["id"] for r in rows if r[str(i)]} == want, q
        found = {r["id"]: r["score"] for r in PO.search(docs, index, q).collect()}
        assert set(found) == want, q


@pytest.mark.parametrize("q", ["apple pear", '+title:red -"the tree"', "NOT red"])
def test_relevance_with_and_without_an_index(docs, index, q):
    found, direct = ({r["id"]: r["score"] for r in PO.search_docs(docs, docs, q, FIELDS, i).collect()} for i in (index, None))
    assert direct.keys() == found.keys() and all(math.isclose(direct[i], found[i], abs_tol=1e-12) for i in found)


def test_operators_of_the_parser():
    w = lambda t, f=None: Q.Words((t,), f)
    assert Q.parse("a b") == Q.Clauses(should=(w("a"), w("b")))
    assert Q.parse("a b", "and") == Q.Clauses(must=(w("a"), w("b")))
    assert Q.parse("a OR b", "and") == Q.Clauses(should=(w("a"), w("b")))
    assert Q.parse("a AND b c") == Q.Clauses(must=(w("a"), w("b")), should=(w("c"),))
    assert Q.parse("+a -b c") == Q.Clauses(must=(w("a"),), should=(w("c"),), must_not=(w("b"),))
    assert Q.parse("t:a (b OR t:c)") == Q.Clauses(should=(w("a", "t"), Q.Clauses(should=(w("b"), w("c", "t")))))
    assert Q.parse("x-ray") == Q.Clauses(should=(Q.Clauses(should=(w("x"), w("ray"))),))
    assert Q.parse("AND OR NOT").empty and Q.parse(") a").empty  # a closing parenthesis ends the text


def test_relevance_by_hand(docs, index):
    lengths = [len(toks(t)) + len(toks(x)) for _, t, x in DOCS]
    avgdl, n = sum(lengths) / len(DOCS), len(DOCS)
    tf = {d[0]: (toks(d[1]) + toks(d[2])).count("pear") for d in DOCS}
    df = sum(v > 0 for v in tf.values())
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    [r] = PO.search(docs, index, "pear").collect()
    dl = lengths[5]
    assert r["id"] == 6 and tf[6] == 4
    assert math.isclose(r["score"], idf * 4 * 2.2 / (4 + 1.2 * (0.25 + 0.75 * dl / avgdl)), rel_tol=1e-12)


def test_search_reads_the_asked_terms_only(docs, index):
    def plan(q):
        return PO.hits(index, Q.parse(q))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan('pear AND "red apple"') and "In(term, [" in plan('pear AND "red apple"') and "pos:array" in plan('pear AND "red apple"')
    assert "text" not in plan('pear AND "red apple"')
    assert "pos:array" not in plan("pear")  # positions are read for phrases and fields alone


def test_frequent_terms_have_many_writers(spark, tmp_dir):
    many = spark.range(3000).select("id", F.lit("the same words").alias("title"), F.lit("").alias("text"))
    PO.write_index(many, tmp_dir + "/i", FIELDS, buckets=2)
    ix = PO.read_index(spark, tmp_dir + "/i")
    files = ix.postings.filter("term = 'same'").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 3000
    assert PO.search(many, ix, "same -other").count() == 3000


def test_empty_store(spark, docs, tmp_dir):
    PO.write_index(docs.limit(0), tmp_dir + "/i", FIELDS)
    ix = PO.read_index(spark, tmp_dir + "/i")
    assert PO.search(docs.limit(0), ix, "apple").count() == 0 and PO.search(docs.limit(0), ix, "-apple").count() == 0


def test_postings_are_stored_by_block(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(PO, "BLOCK_BYTES", 64)  # several blocks in a task
    many = spark.range(200, numPartitions=2).select("id", F.when(F.col("id") % 3 > 0, "Same title").alias("title"), F.concat(F.lit(" same "), F.col("id").cast("string"), F.lit(" same")).alias("text"))
    PO.write_index(many, tmp_dir + "/i", FIELDS, buckets=2)
    ix = PO.read_index(spark, tmp_dir + "/i")
    rows = ix.blocks.filter("term = 'same'").collect()
    assert 2 < len(rows) < 200 and sum(r["df"] for r in rows) == 200 and sum(r["n"] for r in rows) == 533
    got = {r["id"]: (r["tf"], r["dl"], r["pos"]) for r in ix.postings.filter("term = 'same'").collect()}
    assert got == {i: (3, 5, [0, PO.FIELD, PO.FIELD + 2]) if i % 3 else (2, 3, [PO.FIELD, PO.FIELD + 2]) for i in range(200)}
    assert ix.totals.first()["avgdl"] == (133 * 5 + 67 * 3) / 200
    assert PO.search(many, ix, 'text:"same 7"').count() == 1 and PO.search(many, ix, "title:same").count() == 133
