"""Language detection (J1): naive Bayes on hashed character n-grams.

A text becomes lower-case runs of letters and marks between single spaces; its
n-grams of one to three characters are numbered modulo ``CELLS``. The profile
is one row of ``CELLS`` counts for each language, so it has the same size for
any corpus and travels with the task; each text is counted and scored inside
its row. No row of texts or n-grams is shuffled. Scripts without spaces
(Japanese, Chinese, Thai) need no words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from newslake.functions._util import as_col
from newslake.operators.partitioning import spread

#: Cells of a profile (a prime), and the factors that number an n-gram.
CELLS = 32_749
FACTORS = (1, 257, 66_049)
ORDERS = 3
NOT_LETTERS = r"[^\p{L}\p{M}]+"
#: Languages of a profile: it goes to every task whole.
MAX_LANGUAGES = 1000


def letters(text) -> Column:
    """The normalised text: letter runs in lower case, one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(as_col(text)), NOT_LETTERS, " ")), F.lit(" "))


def _counter():
    """A function from a normalised text to the cells of its n-grams (it goes to the tasks by value)."""
    cells, factors, orders = CELLS, FACTORS, ORDERS

    def count(text: str):
        c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        if len(c) < 3:  # nothing but the two spaces
            return np.zeros(0, np.int64)
        found = []
        for n in range(1, orders + 1):
            m = len(c) - n + 1
            if m > 0:
                found.append(sum(c[i: i + m] * factors[n - 1 - i] for i in range(n)) + n * 7919)
        return np.concatenate(found) % cells
    return count


def fit_language_profiles(train: DataFrame, text: str = "text", lang: str = "lang",
                          path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts per (lang, cell) and a table of languages (docs, n-grams), from
    rows with a language and a text. Counts are summed in the tasks first, so at
    most ``CELLS`` rows a language and task are shuffled. With ``path`` the
    profile is stored there and read back; else it is checkpointed."""
    labelled = spread(train).filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    count, cells = _counter(), CELLS

    def counts(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for pdf in batches:
            for lang_, t in zip(pdf["lang"], pdf["t"]):
                if lang_ not in sums:
                    sums[lang_], docs[lang_] = np.zeros(cells, np.int64), 0
                sums[lang_] += np.bincount(count(t), minlength=cells)
                docs[lang_] += 1
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"lang": k, "cell": np.append(at, -1).astype(np.int32), "n": np.append(v[at], docs[k])})
    found = (labelled.select(F.col(lang).cast("string").alias("lang"), letters(text).alias("t"))
             .mapInPandas(counts, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")))
    if path:
        found.write.mode("overwrite").parquet(path + "/profile")
        found = train.sparkSession.read.parquet(path + "/profile")
    else:
        found = found.checkpoint(eager=True)
    profile = found.filter(F.col("cell") >= 0)
    docs = found.filter(F.col("cell") < 0).select("lang", F.col("n").alias("docs"))
    grams = profile.groupBy("lang").agg(F.sum("n").alias("grams"))
    return profile, docs.join(grams, "lang", "left").select("lang", "docs", F.coalesce("grams", F.lit(0)).alias("grams"))


def read_language_profiles(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """A stored profile."""
    found = spark.read.parquet(path + "/profile")
    profile = found.filter(F.col("cell") >= 0)
    docs = found.filter(F.col("cell") < 0).select("lang", F.col("n").alias("docs"))
    return profile, docs.join(profile.groupBy("lang").agg(F.sum("n").alias("grams")), "lang", "left").fillna(0)


def language_of(profile: DataFrame, langs: DataFrame):
    """A function from a text Column to its most probable language (``""`` for a
    text without letters; of equal scores the first by name). The profile is
    read to the driver: ``CELLS`` numbers for each of at most
    ``MAX_LANGUAGES`` languages."""
    table = langs.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(table) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = [r["lang"] for r in table]
    weights = np.zeros((len(names), CELLS), np.float64)
    for r in profile.toPandas().groupby("lang"):
        weights[names.index(r[0]), r[1]["cell"].to_numpy()] = r[1]["n"].to_numpy()
    total = max(sum(r["docs"] for r in table), 1)
    grams = np.array([r["grams"] for r in table], np.float64)
    prior = np.log(np.array([r["docs"] for r in table], np.float64) / total)
    weights = np.log(weights + 1) - np.log(grams + CELLS)[:, None] if names else weights
    shared = profile.sparkSession.sparkContext.broadcast((names, weights, prior))
    count, cells = _counter(), CELLS

    @F.pandas_udf(T.StringType())
    def best(texts: pd.Series) -> pd.Series:
        names, weights, prior = shared.value
        out = []
        for t in texts:
            at = count(t) if t is not None and names else []
            out.append(names[int(np.argmax(prior + weights @ np.bincount(at, minlength=cells)))] if len(at) else "")
        return pd.Series(out, dtype=object)
    return lambda text: best(letters(F.coalesce(as_col(text), F.lit(""))))


def detect_language(df: DataFrame, profile: DataFrame, langs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and the most probable language of each row (``detected``)."""
    return spread(df).select(key, language_of(profile, langs)(F.col(text)).alias("detected"))
