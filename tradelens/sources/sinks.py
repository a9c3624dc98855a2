"""Sinks that write partitions: a repeated run changes nothing, and partitions that a run does not hold keep their files.

The id of a run is kept in ``_runs`` below the table once its partitions are written. A run that broke
off before that writes the same partitions again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import upsert
from ..shared import settle


def _run_file(spark, path: str, run_id: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_runs/{run_id}")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _once(rows: DataFrame, path: str, run_id: str, keys: list[str], make) -> bool:
    """Overwrite the partitions of ``make()`` by ``keys`` unless the run is done."""
    fs, done = _run_file(rows.sparkSession, path, run_id)
    if fs.exists(done):
        return False
    make().repartition(*keys).write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    fs.create(done, True).close()
    return True


def write_snapshots(rows: DataFrame, path: str, run_id: str, keys: tuple[str, ...] = ("account_code", "day")) -> bool:
    """Replace the snapshot of every key in ``rows`` as a whole; False if the run was written before."""
    return _once(rows, path, run_id, list(keys), lambda: rows)


def write_upsert(rows: DataFrame, path: str, run_id: str, keys: list[str], keep: tuple[str, ...] = (), buckets: int = 64) -> bool:
    """Put ``rows`` (unique keys) over the stored ones, as :func:`upsert` does; only buckets of theirs are read and written."""
    spark = rows.sparkSession
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))

    def make():
        fs, _ = _run_file(spark, path, run_id)
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            return dealt
        touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]  # at most ``buckets``
        old = spark.read.schema(dealt.schema).parquet(path).where(F.col("bucket").isin(touched))
        return settle(upsert(old, dealt, [*keys, "bucket"], keep))  # read before its partitions are replaced

    return _once(rows, path, run_id, ["bucket"], make)
