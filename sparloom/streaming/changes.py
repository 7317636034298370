"""Change capture over a stream of snapshots or of row versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparloom.operators.cdc import snapshot_diff, upsert


class ChangeCapture:
    """Logs what each micro-batch of full row versions changes in a table.

    The state is the table itself at `state_path`/<version>, one folder per batch: a batch that is
    run again after a failure reads the version before it and writes its own anew, so the log of a
    batch is the same however often it runs. Rows that are absent from a batch are unchanged. Of several
    versions of a row in one batch the one with the highest `order` counts, or, without an order or where
    it is the same, the one with the highest hash, whichever task it comes from. The last `keep` versions
    of the table stay.
    """

    def __init__(self, state_path: str, keys: list[str], table: str, write_log: Callable[[DataFrame, int], None], order: str | None = None, keep: int = 3):
        self.state_path, self.keys, self.table, self.write_log, self.order, self.keep = state_path.rstrip("/"), keys, table, write_log, order, max(2, keep)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        whole = F.struct(*[batch[c] for c in batch.columns])
        rank = F.struct(*([batch[self.order]] if self.order else []), F.xxhash64(*[batch[c] for c in batch.columns]))
        rows = batch.groupBy(*self.keys).agg(F.max_by(whole, rank).alias("_row")).select("_row.*")
        before = spark.read.schema(batch.schema).parquet(f"{self.state_path}/{batch_id - 1}") if batch_id else spark.createDataFrame([], batch.schema)
        touched = before.join(rows.select(*self.keys), self.keys, "left_semi")
        self.write_log(snapshot_diff(touched, rows, self.keys, table=self.table), batch_id)
        upsert(before, rows, self.keys).write.mode("overwrite").parquet(f"{self.state_path}/{batch_id}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.state_path}/{batch_id - self.keep}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def capture_changes(stream: DataFrame, checkpoint: str, capture: ChangeCapture, **trigger) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(capture).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
