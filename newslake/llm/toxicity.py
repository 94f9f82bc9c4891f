"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a bounded sample of all other
training documents, labelled or not, is the unlabelled set. A linear
classifier over the presence of word features (whole words and word beginnings)
minimises the class-prior-corrected risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; where the second term is
negative its gradient is turned round, so that the flexible model can't push it
below zero. Counts and sparse rows of the sample come from Spark; numpy fits
the bounded sample; every document is scored in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm import wordhash as W
from newslake.llm.common import row_blocks, text_buffers

# Words are runs of ASCII letters and digits and of all characters beyond ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
BEGINNINGS = (3, 4, 5, 6, 7)
FILTER = 1 << 16


@dataclass(frozen=True)
class Limits:
    """Bounds of what is fitted; scoring has none."""

    positives: int = 4000
    unlabelled: int = 20_000
    candidates: int = 200_000
    features: int = 1024
    least_documents: int = 3
    epochs: int = 60
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float
    prior: float


def held_out(doc_id: str) -> Column:
    """Rows kept from fitting: crc32 of the id as text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def features(text: pa.Array):
    """(first row, end row, row, hash) of the distinct features of each block of rows."""
    data, offsets = text_buffers(pc.utf8_lower(text.fill_null("") if text.null_count else text))
    for lo, hi in row_blocks(offsets):
        w = W.Words(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], space=BETWEEN)
        length = w.end - w.start
        rows, values = [w.row], [w.hashes()]
        for k in BEGINNINGS:
            longer = length > k
            rows.append(w.row[longer])
            values.append(w.hash_range(w.start[longer], w.start[longer] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
        yield lo, hi, np.concatenate(rows), np.concatenate(values)


def _known(keys: np.ndarray, value: np.ndarray, quick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``value`` is among the sorted keys, and its index."""
    at = np.flatnonzero(quick[(value & np.uint64(FILTER - 1)).astype(np.int64)])
    i = np.minimum(np.searchsorted(keys, value[at]), len(keys) - 1)
    hit = keys[i] == value[at]
    return at[hit], i[hit]


def _quick(keys: np.ndarray) -> np.ndarray:
    quick = np.zeros(FILTER, bool)
    quick[(keys & np.uint64(FILTER - 1)).astype(np.int64)] = True
    return quick


def _document_counts(texts: DataFrame, keys: np.ndarray | None) -> DataFrame:
    """``(feature, n)``: in how many rows of ``texts`` a feature occurs."""
    shared = texts.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        known = shared.value
        quick = None if known is None else _quick(known)
        for b in batches:
            for _, _, row, value in features(b.column("text")):
                if known is not None:
                    at, i = _known(known, value, quick)
                    row, value = row[at], value[at]
                row, value = W.distinct(row, value)
                value, n = np.unique(value, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["feature", "n"])
    return texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _present(b: pa.RecordBatch, keys: np.ndarray, quick: np.ndarray):
    """(row, feature index) of the known features present in each row."""
    rows, found = [], []
    if len(keys):
        for lo, _, row, value in features(b.column("text")):
            at, i = _known(keys, value, quick)
            row, i = W.distinct(row[at] + lo, i)
            rows.append(row)
            found.append(i)
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def nn_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, epochs: int = 60, rate: float = 0.05, decay: float = 1e-4, seed: int = 5):
    """Weights and bias of the linear classifier that minimises the non-negative
    PU risk with the logistic loss, by Adam over mini-batches of sparse rows."""
    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(n + 1) for _ in range(3))
    w[n] = np.log(prior / (1 - prior))

    def dense(rows):
        x = np.zeros((len(rows), n + 1))
        x[:, n] = 1
        for i, r in enumerate(rows):
            x[i, r] = 1
        return x

    step, batch = 0, 1024
    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for lo in range(0, len(order), batch):
            xu = dense([unlabelled[i] for i in order[lo: lo + batch]])
            xp = dense([positive[i] for i in rng.integers(0, len(positive), min(batch // 2, len(positive)))])
            gu, gp = xu @ w, xp @ w
            up, pp = 1 / (1 + np.exp(-gu)), 1 / (1 + np.exp(-gp))
            negative = np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp))
            grad_negative = xu.T @ up / len(up) - prior * (xp.T @ pp) / len(pp)
            grad = prior * (xp.T @ (pp - 1)) / len(pp) + grad_negative if negative >= 0 else -grad_negative
            grad[:n] += decay * w[:n]
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            w[:n] = np.maximum(w[:n], 0)  # every feature was chosen as a sign of toxicity
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, train: Column, limits: Limits = Limits()) -> Model:
    """Fit on the rows of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``
    for which ``train`` (over ``doc_id``) holds. The class prior is the share of
    toxic rows among these labels. Rows with a null id or label are left out;
    an id with several labels is toxic if one of them is. Without a confirmed
    toxic document the model scores everything 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(train & F.col("doc_id").isNotNull())
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(train & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)), F.lit(0))).first()
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf, 0.0)
    if not toxic:
        return nothing
    prior = min(toxic / n, 0.95)
    # The samples are ids in the order of a hash, at most so many; their size bounds the broadcasts.
    pick = lambda ids, most: F.broadcast(ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    p_text = docs.join(pick(marks.where("toxic > 0"), limits.positives), "doc_id")
    u_text = docs.join(pick(docs, limits.unlabelled), "doc_id")
    n_p, n_u = p_text.count(), u_text.count()
    if not n_p:
        return nothing
    in_p = _document_counts(p_text, None).where(F.col("n") >= max(limits.least_documents, n_p // 400)).orderBy(F.desc("n"), "feature").limit(limits.candidates).toPandas().sort_values("feature")
    keys = in_p["feature"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, count_p = keys[order], in_p["n"].to_numpy()[order]
    count_u = np.zeros(len(keys))
    if len(keys):
        in_u = _document_counts(u_text, keys).toPandas()
        count_u[np.searchsorted(keys, in_u["feature"].to_numpy().astype(np.int64).view(np.uint64))] = in_u["n"].to_numpy()
    share_p, share_u = (count_p + 0.5) / (n_p + 1), (count_u + 0.5) / (n_u + 1)
    z = (share_p - share_u) / np.sqrt(share_p * (1 - share_p) / n_p + share_u * (1 - share_u) / n_u + 1e-12)
    use = np.flatnonzero((share_p > 1.5 * share_u) & (z > 1))
    use = np.sort(use[np.argsort(-(z * np.log(share_p / share_u))[use], kind="stable")[: limits.features]])
    keys = keys[use]
    shared = spark.sparkContext.broadcast(keys)

    def rows(batches):
        quick = _quick(shared.value)
        for b in batches:
            row, i = _present(b, shared.value, quick)
            at = np.searchsorted(row, np.arange(len(b) + 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(i.astype(np.int32)))], ["doc_id", "present"])
    sparse = lambda t: [np.array(r["present"], np.int64) for r in sorted(t.mapInArrow(rows, "doc_id long, present array<int>").collect())]
    weights, bias = nn_pu(sparse(p_text), sparse(u_text), len(keys), prior, limits.epochs)
    return Model(keys, weights, bias, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with one more column, the probability of class 1 (0 to 1). The
    score depends on the text only; null and empty texts get the score of a
    text without features. Equal texts get equal scores. Raises ValueError if
    ``docs`` has the new column already; an empty table gives an empty one."""
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        quick = _quick(m.keys)
        for b in batches:
            text = b.column(text_col).cast(pa.string())
            row, i = _present(pa.RecordBatch.from_arrays([text], ["text"]), m.keys, quick)
            z = np.bincount(row, m.weights[i], len(b)) + m.bias if len(row) else np.full(len(b), m.bias)
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-z)))], [*b.schema.names, into])
    from pyspark.sql.types import DoubleType, StructField, StructType
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, DoubleType())]))
