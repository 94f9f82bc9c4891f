"""The corpus pipeline: raw documents to token ids, in five written stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its
predecessor kept and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and reads it again as the next stage's input.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.llm import decontam, jaccard, pii, sentencepiece_codec, toxicity
from newslake.llm.common import Scratch, table

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Bytes of a batch between Spark and a Python worker: both hold two of them for each running task.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, for texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score 0.3 or more. The classifier learns from the labels outside the held-out rows."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out("doc_id"))
    score = unused(docs, "score")
    return toxicity.score(docs, model, into=score).where(F.col(score) < toxicity.Limits().threshold).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.9 or more over 3-word
    shingles keep the one with the smallest id. Rows without a word, with a
    null id or linked with nothing stay. Rows with a word that repeat an id are
    one document, the one with the smallest text, before links are looked for."""
    small_batches(spark)
    scratch, key = Scratch(spark, "groups"), unused(docs, "group_id")
    again = scratch.save(docs.where(F.col("doc_id").isNotNull() & _has_word()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key)), 1)
    # Written once if ids repeat, as the search reads it several times.
    own = docs if again.isEmpty() else scratch.save(_first_of_id(docs, again, key))
    found = jaccard.jaccard_components(own, percent=90, k=3)
    lose = found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return own.join(lose, (F.col("doc_id") == F.col(key)) & _has_word(), "left_anti")


def _has_word() -> Column:
    return F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _first_of_id(docs: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """One row, with the smallest text, of the rows with a word of each id in ``again``; all other rows as they are."""
    spare = [c for c in docs.columns if c not in ("doc_id", "text")]
    single = docs.join(again, (F.col("doc_id") == F.col(key)) & _has_word(), "left_anti")
    twice = docs.where(_has_word()).join(again, F.col("doc_id") == F.col(key), "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *spare)).alias(key))
    return single.unionByName(twice.select("doc_id", f"{key}.*").select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that themselves hold 80 % or more of the 5-word shingles of
    a benchmark item, whatever other rows of their id hold."""
    small_batches(spark)
    # A key of each row, as ids may be null or repeat; written, as one that is not could change between reads.
    row = unused(docs, "row_key")
    keyed = Scratch(spark, "rows").save(docs.withColumn(row, F.monotonically_increasing_id()))
    found = decontam.contaminated(keyed.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(row)).distinct()
    return keyed.join(found, row, "left_anti").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates; ``n_chars`` follows the new text."""
    small_batches(spark)
    count = unused(docs, "n_entities")
    out = pii.pseudonymise(docs, count_into=count).drop(count)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the token ids of each text, in place of a column of that name."""
    small_batches(spark)
    return sentencepiece_codec.encode(docs.drop("token_ids"), f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [("toxicity", reject_toxic), ("ngram_jaccard_join", one_of_each_group), ("benchmark_decontamination", drop_contaminated),
          ("pii_surrogates", replace_personal_data), ("sentencepiece", encode)]

#: SQL expresses neither the classifier nor the surrogates and the codec; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
