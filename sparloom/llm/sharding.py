"""Size-tiered compaction of shards under a versioned manifest, in DataFrame operations only.

Arrivals are appended as small immutable shards (a run of Parquet files). When `fan_in` runs of the
same size tier (logarithm of their bytes) are there, they are merged into one run whose files have
the target size. Merging reads files side by side, without a shuffle. A manifest lists the live runs
and the schema of all of them together. A new version is written under another name and then put in
place under its number, which fails if the number is taken; a writer that comes second reads the
newer version and tries again on top of it. Readers take the highest number and never see half a
merge. No run is removed by a merge: vacuum() removes those that a manifest has named and that no
manifest within the retention time names any more, so a run still to be committed is never touched.

Columns: runs may differ. A column that a run lacks is null in its rows; names that differ in case
only are the same column. A column of another type than before is refused, and so is the arrival.

Rows: any values are kept as they are, nulls, very long texts and repeated rows included. An empty
arrival adds no run and no column.
"""

from __future__ import annotations

import json
import math
import os
import threading
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from sparloom.llm.common import _fs, delete

#: Commits by writers of one process go one after another.
_COMMIT = threading.Lock()


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Run:
    path: str
    bytes: int
    files: int

    def tier(self, base: int, fan_in: int) -> int:
        """0 below base bytes, then one more for every factor of fan_in."""
        return 0 if self.bytes <= base else 1 + int(math.log(self.bytes / base, fan_in))


def united(old: StructType | None, new: StructType) -> StructType:
    """old's columns, then those that only new has."""
    fields = list(old.fields) if old else []
    at = {f.name.lower(): f for f in fields}
    for f in new.fields:
        known = at.get(f.name.lower())
        if known is None:
            fields.append(StructField(f.name, f.dataType))
        elif known.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {f.dataType.simpleString()}, in the store {known.dataType.simpleString()}")
    return StructType(fields)


class ShardStore:
    """A folder of runs and manifests, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4, small_bytes: int = 16 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.small_bytes = target_bytes, fan_in, small_bytes

    # manifests

    def _versions(self) -> dict[int, int]:
        """Committed versions and when each was, in milliseconds."""
        fs, p = _fs(self.spark, f"{self.root}/manifest")
        found = [(x.getPath().getName(), x.getModificationTime()) for x in fs.listStatus(p)] if fs.exists(p) else []
        return {int(n[1:]): t for n, t in found if n[:1] == "v" and n[1:].isdigit()}

    def version(self) -> int:
        """The highest committed version, -1 if none."""
        return max(self._versions(), default=-1)

    def _load(self, version: int) -> dict:
        if version < 0:
            return {"runs": [], "schema": None}
        return json.loads(self.spark.read.text(f"{self.root}/manifest/v{version}", wholetext=True).first()[0])

    def manifest(self, version: int | None = None) -> list[Run]:
        return [Run(**x) for x in self._load(self.version() if version is None else version)["runs"]]

    def schema(self, version: int | None = None) -> StructType | None:
        """The columns of all runs together, None if there has been none."""
        found = self._load(self.version() if version is None else version)["schema"]
        return StructType.fromJson(found) if found else None

    def commit(self, runs: list[Run], after: int, schema: StructType | None = None) -> int:
        """Publishes the version after `after`; raises Conflict if another writer has done so."""
        taken = Conflict(f"version {after + 1} exists: another writer committed first")
        if after < self.version():
            raise taken
        schema = schema or self.schema(after)
        text = json.dumps({"version": after + 1, "runs": [asdict(r) for r in runs], "schema": schema and schema.jsonValue()})
        fs, tmp = _fs(self.spark, f"{self.root}/manifest/.tmp-{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self._publish(fs, tmp, f"{self.root}/manifest/v{after + 1}")
        except Exception as e:
            if self._versions().keys() & {after + 1}:
                raise taken from e
            raise
        finally:
            fs.delete(tmp, False)
        return after + 1

    def _publish(self, fs, tmp, final: str) -> None:
        """Gives a finished file its name, which must be free: by a hard link on local disks, elsewhere by
        the rename of Hadoop's FileContext, which refuses to overwrite."""
        to = fs.makeQualified(_fs(self.spark, final)[1])
        if to.toUri().getScheme() == "file":
            os.link(fs.makeQualified(tmp).toUri().getPath(), to.toUri().getPath())
        else:
            self._rename(fs.makeQualified(tmp), to)

    def _rename(self, tmp, to) -> None:
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        with _COMMIT:
            context.rename(tmp, to, none)

    def _add(self, runs: list[Run], schema: StructType, tries: int = 100) -> int:
        """Commits further runs on top of whatever version is the last."""
        for _ in range(tries):
            at = self.version()
            try:
                return self.commit([*self.manifest(at), *runs], at, united(self.schema(at), schema))
            except Conflict:
                continue
        raise Conflict(f"no commit in {tries} tries")

    # runs

    def _run(self, path: str) -> Run | None:
        """What a writer has left in a folder; None without a row."""
        fs, p = _fs(self.spark, path)
        sizes = [x.getLen() for x in fs.listStatus(p) if x.getPath().getName().endswith(".parquet")] if fs.exists(p) else []
        if not sizes or not self.spark.read.parquet(path).limit(1).count():
            return None
        return Run(path, int(sum(sizes)), len(sizes))

    def append(self, arrival: DataFrame) -> None:
        """Adds the arrival as it is partitioned, as one new run."""
        united(self.schema(), arrival.schema)
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        arrival.write.parquet(path)
        run = self._run(path)
        if run:
            self._add([run], arrival.schema)
        else:
            delete(self.spark, path)

    def append_each(self, arrivals: DataFrame, by: Column, compact: bool = True) -> None:
        """Adds a run for every value of `by`, one commit after another; all are written in one pass."""
        united(self.schema(), arrivals.schema)
        name, path = f"arrival_{uuid.uuid4().hex}", f"{self.root}/runs/{uuid.uuid4().hex}"
        arrivals.withColumn(name, by).write.partitionBy(name).parquet(path)
        fs, p = _fs(self.spark, path)
        for folder in sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()):
            run = self._run(f"{path}/{folder}")
            if run:
                self._add([run], arrivals.schema)
                if compact:
                    self.compact()

    def compact(self) -> int:
        """Merges until no tier has fan_in runs; the number of merges."""
        merges = 0
        while True:
            runs = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for r in runs:
                tiers.setdefault(r.tier(self.small_bytes, self.fan_in), []).append(r)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), None)
            if not full:
                return merges
            merges += self._replace(full, self._merge(full))

    def _replace(self, old: list[Run], merged: Run) -> bool:
        """Commits the merge on top of the last version, unless another writer has taken its runs."""
        while True:
            at = self.version()
            runs = self.manifest(at)
            if not set(old) <= set(runs):
                return False
            try:
                self.commit([*(r for r in runs if r not in old), merged], at)
                return True
            except Conflict:
                continue

    def _read(self, runs: list[Run], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[r.path for r in runs])

    def _merge(self, runs: list[Run]) -> Run:
        files = max(1, math.ceil(sum(r.bytes for r in runs) / self.target_bytes))
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        self._read(runs, self.schema()).coalesce(files).write.parquet(path)
        return self._run(path)

    def vacuum(self, keep_seconds: float = 7 * 86_400) -> int:
        """Deletes manifests that a newer one replaced keep_seconds ago or earlier, and the runs that only
        they name. Readers of older versions and writers yet to commit are safe. The number of runs."""
        versions = self._versions()
        until = (time.time() - keep_seconds) * 1000
        # a version is over when the next one is committed
        gone = [v for v in versions if v + 1 in versions and versions[v + 1] <= until]
        live = {r.path for v in versions if v not in gone for r in self.manifest(v)}
        dead = {r.path for v in gone for r in self.manifest(v)} - live
        for path in dead:
            fs, p = _fs(self.spark, path)
            fs.delete(p, True)
        for v in gone:
            fs, p = _fs(self.spark, f"{self.root}/manifest/v{v}")
            fs.delete(p, False)
        return len(dead)

    def read(self, version: int | None = None, schema: StructType | None = None) -> DataFrame:
        """The rows of a version, by default the last; an empty store needs the schema."""
        version = self.version() if version is None else version
        runs, found = self.manifest(version), self.schema(version)
        if runs:
            return self._read(runs, found)
        if found is None and schema is None:
            raise ValueError("the store is empty: pass a schema")
        return self.spark.createDataFrame([], found or schema)

