"""A training-data pipeline over `documents`: five operators, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.

Rows: a null text has no toxic word and one empty line, is a near copy of all other texts without words
(the smallest id of them stays, an unknown id last), and has no words for the mix, which leaves it out.
A null id is judged, kept and packed like any other; a null source is a source of its own; other columns
are carried, n_chars follows a text that was shortened. Repeated rows are one near-copy group. Ties go to
the smallest id, then to the row's hash. An empty table gives no rows at every stage; without usable
labels no document is rejected. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm import lines, mixing, packing, simhash, toxicity
from sparloom.llm.common import Scratch
from sparloom.llm.queries import toxicity_model

#: Documents with this toxicity score or more are rejected.
TOXIC = 0.5


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars made to fit a text that a stage may have shortened."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by toxicity score. Rows with a null id are judged like any other."""
    model = toxicity_model(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model, TOXIC)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines found in 10 documents or more out of every text; n_chars follows the text."""
    return _with_length(lines.drop_common_lines(spark, docs, min_docs=10).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares 0.8 of its five-word shingles."""
    return simhash.drop_similar(spark, docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until every source has its target number of words."""
    return _with_length(mixing.mix(spark, docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 2048 tokens: one row per piece."""
    from public_tokenizers import path

    return packing.pack(spark, docs, path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the decoder, the fingerprints or the tokenizer; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, each written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
