"""Line dedup on levelled sorted runs of line hashes.

A run is an immutable table of (key_hi, key_lo, n): the 128-bit hash of a line's key and the number
of documents that hold it, bucketed and sorted by the hash. Every new batch merge-anti-joins the
runs' settled keys (already found often enough, so nothing about them can change), and what is left
becomes a run of level 0. When a level has `fan_in` runs they are compacted into one run of the
next level, where counts of the same key are added up. Runs are bucketed alike, so these joins
shuffle the batch only.

Rows: a null or empty text is one empty line; a line whose key is empty is always kept; a key
counts once per row of the input, and repeated rows count as documents of their own. Extra columns
are ignored.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparloom.llm.common import ASCII_SPACE, Scratch, columns_free_of, row_key, tidy

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = ASCII_SPACE.encode()
KEY = ["key_hi", "key_lo"]
ROW = ["row_hi", "row_lo"]


def line_key(line: bytes) -> bytes:
    return line.translate(_LOWER).strip(_SPACE)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    slim = columns_free_of(docs, id_col, text_col).toDF("doc_id", "text")
    return slim.select(*row_key(F.col("doc_id"), F.col("text")), F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(row_hi, row_lo, place, first, key_hi, key_lo): a row per line whose key has min_chars code points.

    place counts a document's lines from 0; first marks a key's first line in its document.
    """

    def run(batches):
        for batch in batches:
            rows, places, firsts, digests = [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                seen = set()
                for j, line in enumerate((text or b"").split(b"\n")):
                    key = line_key(line)
                    if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        d = xxhash.xxh3_128_digest(key)
                        rows.append(i)
                        places.append(j)
                        firsts.append(d not in seen)
                        digests.append(d)
                        seen.add(d)
            k = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32()), pa.array(firsts, pa.bool_()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], [*ROW, "place", "first", *KEY])

    return _keyed(docs, id_col, text_col).mapInArrow(tidy(run), "row_hi bigint, row_lo bigint, place int, first boolean, key_hi bigint, key_lo bigint")


class LineRuns:
    """The store of runs. add() takes a batch of (key_hi, key_lo), one row per document and key."""

    def __init__(self, spark: SparkSession, min_docs: int, fan_in: int = 3, buckets: int | None = None):
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.prefix = f"line_run_{uuid.uuid4().hex}"
        self.n = 0

    def _write(self, run: DataFrame) -> str:
        self.n += 1
        name = f"{self.prefix}_{self.n}"
        run.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        # keys are inverted on the way: Spark takes a union of tables bucketed alike for dealt out by
        # the key, which it is not, and would then add up each table by itself
        flipped = [F.bitwise_not(F.col(k)).alias(k) for k in KEY]
        runs = functools.reduce(DataFrame.unionByName, (self.spark.table(n).select(*flipped, "n") for n in names))
        return runs.groupBy(*KEY).agg(F.sum("n").alias("n")).select(*flipped, "n")

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The batch's keys and counts without those that a run has settled."""
        new = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        for level in self.levels:
            for name in level:
                new = new.join(self.spark.table(name).filter(F.col("n") >= self.min_docs).select(*KEY), KEY, "left_anti")
        return new

    def add(self, batch: DataFrame) -> None:
        self.levels[0].append(self._write(self.unsettled(batch)))
        self.compact()

    def compact(self) -> None:
        for level in range(1000):
            if level >= len(self.levels) or len(self.levels[level]) < self.fan_in:
                return
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(old)))
            self._drop(old)

    def settled(self) -> DataFrame:
        """(key_hi, key_lo) found in min_docs documents or more, over all runs."""
        names = [n for level in self.levels for n in level]
        return self._merged(names).filter(F.col("n") >= self.min_docs).select(*KEY)

    def _drop(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n} PURGE")

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = [[]]


def common_line_places(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 3) -> DataFrame:
    """(row_hi, row_lo, places): by row_key, the numbers of the lines whose key min_docs documents hold.

    The input is dealt into `batches` by row hash, as if they had arrived one after another.
    """
    scratch = Scratch(spark, "lines")
    lines = scratch.save(hashed_lines(docs, id_col, text_col, min_chars).withColumn("batch", F.expr(f"cast(pmod(row_hi, {batches}) as int)")), "batch")
    store = LineRuns(spark, min_docs)
    for b in range(batches):
        store.add(lines.filter(F.col("batch") == b).filter("first").select(*KEY))
    common = scratch.save(store.settled())
    store.close()
    # both sides are shuffled for this join, so a line that is everywhere can be split
    hit = lines.select(*ROW, "place", *KEY).join(common, KEY)
    return hit.groupBy(*ROW).agg(F.collect_set("place").alias("places"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs' columns with text_col rid of common lines, and n_lines and n_dropped, by row of docs.

    A null text stays null. n_lines and n_dropped come last, whatever docs' columns are called.
    """
    places = common_line_places(spark, docs, id_col, text_col, **options)
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    keyed = docs.select(*row_key(docs[id_col], docs[text_col]), *[docs[c].alias(o) for c, o in zip(docs.columns, own, strict=True)])
    joined = keyed.join(places, ROW, "left").select("places", *own)

    def run(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for drop, text in zip(batch.column(0).to_pylist(), batch.column(at + 1).to_pylist(), strict=True):
                if drop:
                    all_lines, gone = text.split("\n"), set(drop)
                    n_lines.append(len(all_lines))
                    n_dropped.append(len(gone))
                    kept.append("\n".join([x for j, x in enumerate(all_lines) if j not in gone]))
                else:
                    n_lines.append((text or "").count("\n") + 1)
                    n_dropped.append(0)
                    kept.append(text)
            columns = batch.columns[1:]
            columns[at] = pa.array(kept, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*own, "n_lines", "n_dropped"])

    fields = StructType([*(StructField(o, f.dataType) for o, f in zip(own, docs.schema.fields, strict=True)), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return joined.mapInArrow(tidy(run), fields).toDF(*docs.columns, "n_lines", "n_dropped")
