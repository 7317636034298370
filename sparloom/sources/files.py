"""Reading and writing around tables: reports, databases, verified publishing, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The same query on another database."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def table_size_report(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, records_count, pages_count) from a text report, by pages.

    A line "NAME (number)" begins a table; later lines give its total records and data pages, the
    last of each counting. A report is one file; its lines are numbered in it.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return size_report_of(text).orderBy("pages_count")


def size_report_of(lines: DataFrame) -> DataFrame:
    """The same of lines (file, n, line)."""
    found = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("table_name", F.last(found(r"^(\w+)\s+\(\d+\)"), ignorenulls=True).over(w))
    facts = named.select("file", "table_name", "n", found(r"^\s+.+total records:\s+(\d+)").cast("bigint").alias("r"), found(r"^\s+Data pages:\s+(\d+)").cast("bigint").alias("p")).filter("table_name is not null and (r is not null or p is not null)")
    return facts.groupBy("table_name").agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.struct("file", "n"))).alias("records_count"), F.max_by("p", F.when(F.col("p").isNotNull(), F.struct("file", "n"))).alias("pages_count"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows, and a sum of row hashes that does not depend on their order."""
    h = F.sum(F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns]).cast("decimal(38,0)"))
    n, s = df.agg(F.count(F.lit(1)), h).first()
    return int(n), int(s or 0)


def publish(df: DataFrame, path: str) -> tuple[int, int]:
    """Writes to a temporary folder beside `path`, reads it again, compares, and renames it.

    Readers never see an unverified copy; a copy that differs raises and leaves `path` as it was. What
    was there is moved aside first and deleted last; it is moved back if the new copy can't take its place.
    """
    spark, tmp = df.sparkSession, f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    df.write.parquet(tmp)
    wanted, got = fingerprint(df), fingerprint(spark.read.schema(df.schema).parquet(tmp))
    fs, t = _fs(spark, tmp)
    if wanted != got:
        fs.delete(t, True)
        raise ValueError(f"the copy differs: {got} instead of {wanted}")
    _, final = _fs(spark, path)
    _, aside = _fs(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    old = fs.exists(final)
    if old and not fs.rename(final, aside):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(t, final):
        if old:
            fs.rename(aside, final)
        raise OSError(f"{tmp} can't be renamed")
    if old:
        fs.delete(aside, True)
    return got


def expired(files: DataFrame, keep: int, group: str | None = None) -> DataFrame:
    """Files beyond the newest keep - 1, by modification time, so that one more can follow.

    files: (path, mtime[, group]). With a group, each has its own newest. Without one, every file but
    the newest keep - 1 goes; those few are found by partial top lists, not by one sort of all.
    """
    newest = [F.desc("mtime"), F.col("path")]
    if group:
        return files.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*newest))).filter(F.col("_n") >= keep).drop("_n")
    if keep <= 1:
        return files
    kept = files.orderBy(*newest).limit(keep - 1).select(F.col("mtime").alias("_m"), F.col("path").alias("_p"))
    return files.join(F.broadcast(kept), (F.col("mtime").eqNullSafe(F.col("_m"))) & (F.col("path") == F.col("_p")), "left_anti")
