"""Tables that change in steps: every state is a small numbered file that names the Parquet folders it is made of.

A state is put in place by a rename that fails where the number is taken, so of two writers that
saw the same state one wins, and what a writer left behind before that is not part of any state.
The rename is atomic on HDFS and on file systems like it; a store without such a rename needs a lock
around :meth:`Versions.put`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import latest, recovered


class Versions:
    """Numbered JSON states in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self._gateway, self._conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.folder = folder
        self._fs = self._path(folder).getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def latest(self) -> tuple[int, dict]:
        """(number, state) of the last state; 0 and an empty one before the first."""
        if not self._fs.exists(self._path(self.folder)):
            return 0, {}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        number = max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)
        if not number:
            return 0, {}
        stream = self._fs.open(self._path(self.folder, f"{number:020d}.json"))
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, number: int, state: dict) -> bool:
        """Make this the state of that number; False where there is one already."""
        draft, place = self._path(self.folder, f"draft-{uuid.uuid4()}"), self._path(self.folder, f"{number:020d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, place, options)
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def folders(self, below: str) -> list[str]:
        if not self._fs.exists(self._path(below)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(below))]


class KeyedTable:
    """The last row of every key, kept as runs of rows dealt to buckets by key.

    A batch is a run of its own under its number; a repeated batch replaces itself. ``compact`` merges
    all runs into one that has a file for each bucket. The row of the batch with the higher number
    wins, of one batch the last by ``order``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, keys, order, buckets
        self.versions = Versions(spark, f"{path}/states")

    def _write(self, rows: DataFrame, name: str) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = rows.withColumn("bucket", bucket).repartition(self.buckets, "bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/data/run={name}")

    def runs(self) -> list[dict]:
        return self.versions.latest()[1].get("runs", [])

    def append(self, batch: DataFrame, number: int) -> None:
        """Add a batch. What was merged already is not taken in again."""
        name = f"batch-{number}-{uuid.uuid4()}"
        self._write(latest(batch, self.keys, self.order).withColumn("_batch", F.lit(number).cast("long")), name)
        while True:
            version, state = self.versions.latest()
            runs = [r for r in state.get("runs", []) if r["first"] != number or r["last"] != number]
            if any(r["first"] <= number <= r["last"] for r in runs):
                return
            runs.append({"name": name, "first": number, "last": number})
            if self.versions.put(version + 1, {"runs": runs}):
                return

    def _rows(self, runs: list[dict], columns: list[str] | None = None) -> DataFrame:
        data = f"{self.path}/data"
        rows = self.spark.read.option("basePath", data).parquet(*(f"{data}/run={r['name']}" for r in runs)).drop("run", "bucket")
        if columns is not None:
            rows = rows.select(*dict.fromkeys([*self.keys, *self.order, *columns, "_batch"]))
        return rows if len(runs) == 1 else latest(rows, self.keys, ["_batch", *self.order])

    def read(self, columns: list[str] | None = None) -> DataFrame:
        """The table's rows; a compacted table is read as it lies.

        With ``columns`` only these: the others are not shuffled either, as whole rows are where runs are merged.
        """
        runs = self.runs()
        if not runs:
            raise ValueError(f"{self.path} has no batch yet")
        rows = self._rows(runs, columns)
        return rows.drop("_batch") if columns is None else rows.select(*columns)

    def compact(self) -> bool:
        """Merge all runs; False where there is nothing to merge or another writer merged them first."""
        runs = self.runs()
        if len(runs) < 2:
            return False
        name = f"merged-{uuid.uuid4()}"
        self._write(self._rows(runs), name)
        merged = {"name": name, "first": min(r["first"] for r in runs), "last": max(r["last"] for r in runs)}
        while True:
            version, state = self.versions.latest()
            if any(r not in state["runs"] for r in runs):
                return False  # merged by another, or a batch came again
            if self.versions.put(version + 1, {"runs": [merged, *(r for r in state["runs"] if r not in runs)]}):
                return True

    def clean(self) -> None:
        """Remove what is not part of the last state. No reader or writer may be at work."""
        kept = {f"run={r['name']}" for r in self.runs()}
        for name in self.versions.folders(f"{self.path}/data"):
            if name not in kept:
                self.versions.delete(f"{self.path}/data/{name}")


class ControlTable:
    """A small table that is replaced as a whole, if it is still the one that was read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.versions = Versions(spark, f"{path}/states")

    def read(self) -> tuple[int, DataFrame]:
        """(number of the state, its rows)."""
        version, state = self.versions.latest()
        if not version:
            raise ValueError(f"{self.path} has no rows yet")
        return version, self.spark.read.parquet(f"{self.path}/data/{state['name']}")

    def replace(self, rows: DataFrame, seen: int = 0) -> bool:
        """Put ``rows`` after the state ``seen``; False where another writer did so meanwhile."""
        name = str(uuid.uuid4())
        rows.write.parquet(f"{self.path}/data/{name}")
        if self.versions.put(seen + 1, {"name": name}):
            return True
        self.versions.delete(f"{self.path}/data/{name}")
        return False


def recover_leases(table: ControlTable, now: Column, lease: str = "INTERVAL 30 MINUTES", tries: int = 10) -> bool:
    """Set RUNNING runs that were not heard of for a lease to FAILED, judged by the heartbeats that still stand.

    Where another writer came first, its state is judged anew. False if no run was stale.
    """
    for _ in range(tries):
        version, runs = table.read()
        after = recovered(runs, now, lease)
        if runs.exceptAll(after).isEmpty():
            return False
        if table.replace(after, version):
            return True
    raise RuntimeError(f"{table.path} changed {tries} times meanwhile")
