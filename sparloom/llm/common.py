"""Shared folder, hashing and graph helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters other than A-Z that lower() might change; those that the JVM doesn't know yet may be
#: known to the library behind lower().
_OTHER_UPPER = r"[[\p{javaUpperCase}\p{Lt}\p{Cn}]&&[^A-Z]]"
#: The six ASCII white-space characters: 0x20 and 0x09 to 0x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the session has none, a local folder is set once if all runs in one process (as tests do);
    on a cluster the executors would not share it, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


#: Rows up to which a table is broadcast, by a count of them; more are shuffled.
FEW = 200_000
#: Bytes of a batch between the JVM and a worker; with Spark's default a few rows of long texts or
#: shingle sets fill 64 MB, several times over on its way.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on Arrow batches to BATCH_BYTES; results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy(run):
    """run, a function over a worker's batches, that hands freed memory back when its task ends: workers
    live on, and what earlier tasks have freed would count beside what later ones need."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return tidied


class Scratch:
    """Tables written to the shared folder to cut lineage; reading them never recomputes."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sparloom-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, *partition_by: str, codec: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        writer = df.write.option("compression", codec) if codec else df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.saved_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes what save() wrote, once nothing reads it any more."""
        delete(self.spark, df.saved_at)

    def free_shuffles(self) -> None:
        """Has the driver's JVM collect its garbage: Spark deletes the shuffle files of finished queries only
        then, and until it happens by itself those of a whole stage may have piled up. Python's garbage goes
        first, as it may hold on to the JVM's."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, in the JVM.

    lower() is fast but also changes other letters; texts that hold one are cut before each such
    character, which is kept, and the rest of every piece is lowered. (translate() takes several
    times as long.)
    """

    def piece(s: Column) -> Column:
        return F.when(F.regexp_like(F.left(s, F.lit(1)), F.lit(_OTHER_UPPER)), F.concat(F.left(s, F.lit(1)), F.lower(F.substr(s, F.lit(2))))).otherwise(F.lower(s))

    cut = F.array_join(F.transform(F.split(text, f"(?={_OTHER_UPPER})"), piece), "")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).when(~F.regexp_like(text, F.lit(_OTHER_UPPER)), F.lower(text)).otherwise(cut)


def crc_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that name a row by id and text; equal rows have equal keys. Nulls are told from values."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), doc_id.isNull(), F.coalesce(text, F.lit("")), text.isNull()]
    return [F.xxhash64(*parts).alias("row_hi"), F.xxhash64(F.lit(0x5EED), *parts).alias("row_lo")]


def columns_free_of(df: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns, so extra columns of any name cannot clash with internal ones."""
    return df.select(*[df[c] for c in needed])


def sql_name(path_or_name: str) -> str:
    return re.sub(r"\W", "_", path_or_name)


#: Edges whose components one task finds, in some 10 MB.
IN_ONE_TASK = 200_000


def _components_at_once(batches):
    u, v = (np.concatenate([np.zeros(0, np.int64), *(b.column(i).to_numpy() for b in some)]) for some in [list(batches)] for i in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
    far = np.nonzero(label != np.arange(len(nodes)))[0]
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], ["node", "root"])


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """Connected components of bigint edges: (node, root), root the smallest node of the component.

    Up to IN_ONE_TASK edges, by a count of them, one task finds them all. More take alternating
    large-star and small-star rounds, each written to the shared folder. The lookups of minima are
    joins whose two sides are both shuffled for the join, so that Spark can split a hub that holds a
    third of the edges. Nodes without an edge have no row; loops are ignored.
    """
    scratch = Scratch(spark, "components")
    now = scratch.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    if now.count() <= IN_ONE_TASK:
        return scratch.save(now.coalesce(1).mapInArrow(tidy(_components_at_once), "node bigint, root bigint"))
    mark = None
    for _ in range(max_rounds):
        # large star: every node hands its larger neighbours to the smallest node it knows
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.save(_to_minimum(scratch, both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # small star: among its smaller neighbours and itself
        small = _to_minimum(scratch, large)
        pairs = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = scratch.save(pairs)
        seen = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        scratch.drop(large)
        scratch.drop(now)
        now = after
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _to_minimum(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the smallest of u and u's neighbours."""
    least = grouped_for_join(edges, "u", F.min("v").alias("lowest"))
    return edges.join(least.select("u", F.least("lowest", "u").alias("m")), "u")


def grouped_for_join(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """df's aggregates by a bigint key, to be joined with df on it.

    Grouped by another expression of the key, so that the join shuffles both its sides: Spark can
    split a hot key in such a join only.
    """
    grouped = df.groupBy(F.bitwise_not(F.col(key)).alias("_flipped")).agg(*aggregates)
    return grouped.withColumn(key, F.bitwise_not(F.col("_flipped"))).drop("_flipped")
