"""The queries opN_<name> over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.llm import embedding, exact, lines, lm, mixing, packing, sharding, simhash, toxicity, urls
from sparloom.llm.common import crc_remainder, shared_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def toxicity_model(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learns from labels of ids whose crc32 leaves a remainder by 5."""
    judged = labels.filter(crc_remainder(F.col("doc_id"), 5) != 0).select(F.col("doc_id").alias("item"), (F.col("toxic") == 1).alias("toxic"))
    return toxicity.fit(spark, docs, judged)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.drop_common_lines(spark, docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(spark, _read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return packing.pack(spark, _read(spark, sf_dir, "documents"), path("word_bpe_49k.json"), capacity=2048)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, _read(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The explicit URL rules of the contract.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is unwanted if the document of its number is labelled toxic or of low quality."""
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("unwanted"))
    return urls.filter_urls(spark, _read(spark, sf_dir, "pages"), labels, URL_RULES)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(spark, _read(spark, sf_dir, "documents"))
    taken = F.aggregate("takes", F.lit(0).cast("bigint"), lambda n, t: n + t["words"])
    return drawn.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = crc_remainder(F.col("doc_id"), 5) == 1
    model = lm.fit(spark, docs.filter(~held_out))
    scored = lm.score(spark, docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(spark, _read(spark, sf_dir, "embeddings"), threshold=0.95)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in batches by id, are compacted, and are read back by the last manifest."""
    docs = _read(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, f"{shared_dir(spark)}/sparloom-shards-{uuid.uuid4().hex}")
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    store.vacuum(keep_seconds=0)  # nobody else reads or writes this store
    text = F.coalesce("text", F.lit(""))
    return store.read(schema=docs.schema).select("doc_id", "source", F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_mixing": op7_mixing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_sharding": op10_sharding,
    "pipeline": pipeline,
}

_SPACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_A, _Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    "op2_line_dedup": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lined AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM docs),
keyed AS (SELECT *, translate(trim(line, {_SPACES}), {_A}, {_Z}) AS k FROM lined),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT keyed.*, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
""",
    "op10_sharding": """
SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents
""",
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_A}, {_Z}) AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
""",
}
