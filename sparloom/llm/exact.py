"""Exact dedup by skew-safe combining, in DataFrame operations only.

1. Locally: the partial aggregate folds equal texts inside each input partition.
2. Salted: a text has at most one row per input partition left; those are merged within salts.
3. Globally: the winners of a text's salts are merged.
Every stage groups by the SHA-256 digest and the whole text, so different texts never merge
whatever their digests. No list of members is built: groups carry a maximum and a count. In the end
each row finds its group by its digest: where the global stage has met one text only under a digest,
which it tells by whole texts of all rows, that is the row's text. Should it ever meet two, the rows of
that digest find their group by the whole text once more.

Rows: a null text counts as empty. The largest id stays; null ids lose against any id, and a group
with null ids only has a null keep_id. Rows that repeat both the id and the text that stay are all
marked as kept, since nothing tells them apart. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm.common import Scratch, ascii_lower, columns_free_of


def _normal(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    slim = columns_free_of(docs, id_col, text_col).toDF("doc_id", "text")
    norm = slim.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    return norm.select("doc_id", "norm", F.sha2("norm", 256).alias("digest"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """(digest, norm, keep_id, group_size): one row per different text."""
    rows = _normal(docs, id_col, text_col).withColumn("salt", F.spark_partition_id() % salts)
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs."""
    scratch = Scratch(spark, "exact")
    found = scratch.save(groups(docs, id_col, text_col, salts).select("digest", "keep_id", "group_size"))
    twice = scratch.save(found.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"))
    rows = _normal(docs, id_col, text_col)
    if twice.isEmpty():
        met = rows.select("doc_id", "digest").join(found, "digest")
    else:
        met = _met(rows, found, groups(docs, id_col, text_col, salts), twice)
    return met.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def _met(rows: DataFrame, found: DataFrame, whole: DataFrame, twice: DataFrame) -> DataFrame:
    """(doc_id, digest, keep_id, group_size): by digest, and by whole text where digests in `twice` have several."""
    alone = rows.join(twice, "digest", "left_anti").select("doc_id", "digest").join(found, "digest")
    shared = rows.join(twice, "digest", "left_semi").join(whole, ["digest", "norm"])
    return alone.unionByName(shared.select("doc_id", "digest", "keep_id", "group_size"))
