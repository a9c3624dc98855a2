"""Upserts, chunked scans and checkpoints of order and catalog ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (aggregated before the shuffle, so a hot key costs one row a task)."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` (unique keys) put over it; columns in ``keep`` stay as they were.

    Old rows without a new one are never deleted. Keys must not be null.
    """
    a, b = old.withColumn("_old", F.lit(True)), new.withColumn("_new", F.lit(True))
    joined = a.alias("a").join(b.alias("b"), keys, "full_outer")
    fresh = F.col("_new").isNotNull()

    def value(c):
        if c not in new.columns or c in keep:
            return F.when(F.col("_old").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}") if c in new.columns else F.lit(None))
        return F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return joined.select(*keys, *(value(c).alias(c) for c in old.columns if c not in keys))


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: created and updated rows of an upsert, before it is done."""
    seen = new.join(old.select(*keys, F.lit(True).alias("_seen")), keys, "left")
    return seen.agg(F.count_if(F.col("_seen").isNull()).alias("created"), F.count_if("_seen").alias("updated"))


def chunk_windows(ranges: DataFrame, days: int) -> DataFrame:
    """Each [from_day, to_day) in pieces of ``days`` days, the last one cut; none for an empty range."""
    some = ranges.where(F.col("from_day") < F.col("to_day"))
    starts = F.explode(F.sequence("from_day", F.date_sub("to_day", 1), F.make_interval(days=F.lit(days))))
    rows = some.select("*", starts.alias("chunk_from"))
    return rows.withColumn("chunk_to", F.least(F.date_add("chunk_from", days), "to_day"))


def sync_start(latest_sale: Column, latest_run: Column, now: Column) -> Column:
    """Start of the next incremental scan: two hours behind the newest checkpoint or now, 90 days back without one."""
    checkpoint = F.least(F.greatest(latest_sale, latest_run), now)  # both skip nulls
    known = latest_sale.isNotNull() | latest_run.isNotNull()
    return F.when(known, checkpoint - F.expr("INTERVAL 2 HOURS")).otherwise(now - F.expr("INTERVAL 90 DAYS"))


def run_rollup(chunks: DataFrame) -> DataFrame:
    """Counters of each run from its chunks: run_id, chunk counts, rows, and whether all chunks are complete."""
    return chunks.groupBy("run_id").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.coalesce(F.sum("processed"), F.lit(0)).alias("processed"), F.coalesce(F.bool_and(F.col("status") == "COMPLETED"), F.lit(False)).alias("complete"),
    )


def pending_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks a resumed run still has to read, from their next offset; a partial page never completes one."""
    return chunks.where(F.col("status") != "COMPLETED").select("run_id", "chunk_from", F.coalesce("next_offset", F.lit(0)).cast("long").alias("next_offset"))


def recovered(runs: DataFrame, now: Column, lease: str = "INTERVAL 30 MINUTES") -> DataFrame:
    """Runs with status FAILED where a RUNNING one has not been heard of for a lease."""
    stale = (F.col("status") == "RUNNING") & (F.col("heartbeat_at") < now - F.expr(lease))
    return runs.withColumn("status", F.when(stale, "FAILED").otherwise(F.col("status")))


#: Civil days that each replay of landed orders goes back.
REPLAYS = {"daily": 7, "weekly": 90}


def replay(stored: DataFrame, landed: DataFrame, kind: str, now: Column) -> DataFrame:
    """Stored orders with those landed for the replay's window, [now - days, now), put over them: late changes arrive this way.

    ``landed`` may hold an order several times; the last arrival counts. Orders are never deleted.
    """
    start = now - F.make_dt_interval(F.lit(REPLAYS[kind]))
    own = landed.where((F.col("sold_at") >= start) & (F.col("sold_at") < now))
    return upsert(stored, latest(own, ["order_id"], ["arrived_at"]).select(*stored.columns), ["order_id"])


def replace_whole(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, actions): of each key in ``new`` all old rows go and the new ones come; other keys stay as they were.

    ``actions`` says CREATED or UPDATED for each key of ``new``.
    """
    given = new.select(*keys).distinct()
    rows = old.join(given, keys, "left_anti").unionByName(new.select(*old.columns))
    known = old.select(*keys, F.lit(True).alias("_known")).distinct()
    return rows, given.join(known, keys, "left").select(*keys, F.when(F.col("_known"), "UPDATED").otherwise("CREATED").alias("action"))
