"""Incremental order ingestion: landed payloads arrive as files and are put over the stored orders."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.landing import parse_orders
from .tables import KeyedTable

LANDED = "payload STRING, arrived_at TIMESTAMP"


def landed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of payload files: parsed orders with their time of arrival; unreadable payloads are left out."""
    raw = spark.readStream.schema(LANDED).json(folder)
    return parse_orders(raw, "arrived_at").where(F.col("order_id").isNotNull())


def sync_orders(orders: DataFrame, table: str, checkpoint: str, every: str | None = None, compact_after: int = 50) -> StreamingQuery:
    """Puts each batch over the stored orders, under its number; a repeated batch replaces itself.

    Batches hold one row per order, so that a scan that overlaps the last one adds no duplicates.
    Once there are ``compact_after`` batches they are merged. ``every`` is a processing-time trigger
    such as ``10 minutes``; without it all that is available is processed.
    """

    def write(batch: DataFrame, number: int) -> None:
        stored = KeyedTable(batch.sparkSession, table, ["order_id"], ["arrived_at"])
        stored.append(batch, number)
        if len(stored.runs()) > compact_after:
            stored.compact()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return orders.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current_orders(spark: SparkSession, table: str, columns: list[str] | None = None) -> DataFrame:
    """The state of every order (``columns`` of it): the batch processed last wins, whatever the order's own times say."""
    return KeyedTable(spark, table, ["order_id"], ["arrived_at"]).read(columns)


class LastStates(StatefulProcessor):
    """Keeps the last processed row of every order of a bucket and gives on the rows that say something new; forgets an order some time after its arrival.

    Orders are kept as one Arrow table a bucket (order_id, said, until), so a bucket is read and
    written once a batch, however many of its orders arrive.
    """

    def __init__(self, forget: datetime.timedelta):
        self.forget = int(forget.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "orders binary")

    def _stored(self) -> dict[str, tuple[str, int]]:
        kept = self.last.get()
        if kept is None:
            return {}
        order_id, said, until = (c.to_pylist() for c in pa.ipc.open_stream(kept[0]).read_all().columns)
        return dict(zip(order_id, zip(said, until)))

    def _store(self, orders: dict[str, tuple[str, int]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not orders:
            self.last.clear()
            return
        said, until = zip(*orders.values())
        table = pa.table([pa.array(orders, pa.string()), pa.array(said, pa.string()), pa.array(until, pa.int64())], names=["order_id", "said", "until"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.last.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(min(until))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = {}
        for part in rows:  # what is held is bounded by the bucket's orders, not by their arrivals
            for order, said, at in zip(part["order_id"].tolist(), part["said"].tolist(), part["arrived_us"].tolist()):
                if order not in new or new[order][1] < at:
                    new[order] = said, at
        now, old = timerValues.getCurrentWatermarkInMs(), self._stored()
        told = [(order, said) for order, (said, _) in new.items() if order not in old or old[order][0] != said]
        kept = {order: x for order, x in old.items() if x[1] > now}
        self._store(kept | {order: (said, max(at // 1000, now) + self.forget) for order, (said, at) in new.items()})
        yield pd.DataFrame(told, columns=["order_id", "said"], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self._store({order: x for order, x in self._stored().items() if x[1] > now})
        return iter(())

    def close(self) -> None:
        pass


#: Instants keep their microseconds in what is stored of an order.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def changed_states(orders: DataFrame, columns: str = "status string", forget: datetime.timedelta = datetime.timedelta(days=90), late: str = "0 seconds", buckets: int = 2048) -> DataFrame:
    """A stream of orders (order_id, ``columns``, arrived_at) as a stream of new states: the last processed row wins.

    The state of an order is dropped ``forget`` after its last arrival (or after the watermark it met), which
    is as far as replays go back; so what is kept is bounded by the orders of that time. Orders are
    dealt to ``buckets`` by their id, and a batch reads and writes the buckets that it touches as a
    whole: a call of Python for each bucket, not for each order. It needs the RocksDB state store.
    """
    schema = StructType.fromDDL(columns)
    rows = orders.withWatermark("arrived_at", late).select(
        "order_id", F.to_json(F.struct(*schema.fieldNames()), _JSON).alias("said"), F.unix_micros("arrived_at").alias("arrived_us"), "arrived_at", F.pmod(F.xxhash64("order_id"), F.lit(buckets)).alias("bucket"),
    )
    told = rows.groupBy("bucket").transformWithStateInPandas(LastStates(forget), "order_id string, said string", "Update", "EventTime")
    return told.select("order_id", F.from_json("said", schema, _JSON).alias("said")).select("order_id", "said.*")


#: What a session needs for ``changed_states``.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
