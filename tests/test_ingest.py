"""Landed payloads, upserts and the order stream on small rows."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tradelens.operators import finance, ingest, matching
from tradelens.sources import landing
from tradelens.streaming.orders import current_orders, landed_orders, sync_orders


def payload(k, status, at, **more):
    return json.dumps({"payload": json.dumps({"id": k, "status": status, "total_amount": "10.00", "order_items": [], **more}), "arrived_at": at})


def test_stream_takes_the_last_processed_state(spark, tmp_path):
    land, table, mark = (tmp_path / x for x in ("land", "table", "mark"))
    land.mkdir()
    source = lambda: landed_orders(spark, str(land))
    (land / "a.json").write_text("\n".join([payload(1, "payment_required", "2026-01-02T00:00:00Z"), payload(2, "paid", "2026-01-02T00:00:00Z"), payload(1, "confirmed", "2026-01-02T00:01:00Z")]))
    sync_orders(source(), str(table), str(mark)).awaitTermination()
    # a later batch wins although its payload arrived with an older time
    (land / "b.json").write_text("\n".join([payload(2, "cancelled", "2026-01-01T00:00:00Z"), payload(3, "odd", "2026-01-03T00:00:00Z")]) + '\n{"payload": "not json"}')
    sync_orders(source(), str(table), str(mark)).awaitTermination()
    got = {r.order_id: r.status for r in current_orders(spark, str(table)).collect()}
    assert got == {"1": "PROCESSING", "2": "CANCELLED", "3": "UNKNOWN"}


def test_pages_must_cover_a_scan_once(spark):
    schema = "scan string, page_offset long, page_limit long, total long, results array<string>"
    good = [("a", 0, 2, 3, ["1", "2"]), ("a", 2, 2, 3, ["3"]), ("b", 0, 2, 0, [])]
    assert {r.payload for r in landing.paged(spark.createDataFrame(good, schema)).collect()} == {"1", "2", "3"}
    for bad in ([("a", 0, 2, 3, ["1"]), ("a", 0, 2, 3, ["1"])], [("a", 0, 0, 1, ["1"])], [("a", 0, 2, 5, ["1"]), ("a", 2, 2, 4, ["2"])]):
        with pytest.raises(Exception, match="inconsistent pagination"):
            landing.paged(spark.createDataFrame(bad, schema)).collect()


def test_refunds_need_a_payments_array(spark):
    rows = [(json.dumps({"id": 1, "payments": []}),), (json.dumps({"id": 2}),), ("",), (None,)]
    got = sorted((r.order_id or "", r.refunded_amount) for r in landing.parse_orders(spark.createDataFrame(rows, "payload string")).collect())
    assert got == [("", None), ("", None), ("1", 0), ("2", None)]


def test_upsert_keeps_what_the_payload_lacks(spark):
    old = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "k int, status string, product_id int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", None)], "k int, status string, product_id int")
    assert sorted(map(tuple, ingest.upsert(old, new, ["k"], keep=("product_id",)).collect())) == [(1, "a", 7), (2, None, 8), (3, "c", None)]
    assert tuple(ingest.upsert_counts(old, new, ["k"]).first()) == (1, 1)
    assert ingest.upsert(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_checkpoints_and_chunks(spark):
    at = lambda x: F.lit(x).cast("timestamp")
    none, now = F.lit(None).cast("timestamp"), at("2026-05-01 12:00:00")
    starts = spark.range(1).select(ingest.sync_start(none, none, now), ingest.sync_start(at("2026-04-01"), none, now), ingest.sync_start(at("2027-01-01"), at("2026-04-01"), now)).first()
    assert [str(x) for x in starts] == ["2026-01-31 12:00:00", "2026-03-31 22:00:00", "2026-05-01 10:00:00"]
    day = datetime.date
    spans = spark.createDataFrame([(day(2026, 1, 1), day(2026, 1, 6)), (day(2026, 1, 1), day(2026, 1, 1))], "from_day date, to_day date")
    assert [(r.chunk_from.day, r.chunk_to.day) for r in ingest.chunk_windows(spans, 2).collect()] == [(1, 3), (3, 5), (5, 6)]
    runs = spark.createDataFrame([("a", "RUNNING", "2026-05-01 11:00:00"), ("b", "RUNNING", "2026-05-01 11:59:00"), ("c", "DONE", None)], "run_id string, status string, heartbeat_at string")
    got = ingest.recovered(runs.withColumn("heartbeat_at", F.col("heartbeat_at").cast("timestamp")), now).collect()
    assert [r.status for r in got] == ["FAILED", "RUNNING", "DONE"]


def test_attempts_that_hit_different_orders_conflict(spark):
    market = spark.createDataFrame([("1", "p"), ("2", "p"), ("3", None)], "order_id string, pack_id string")
    erp = spark.createDataFrame([(1, "1", "1"), (2, "p", None), (3, "1", "3"), (4, "x", None), (5, None, None), (6, "x", "3")], "erp_id int, ecommerce_id string, channel_id string")
    got = {r.erp_id: (r.status, r.attempt, r.order_id) for r in matching.match_orders(erp, market).collect()}
    assert got == {1: ("MATCHED_EXACT", 1, "1"), 2: ("AMBIGUOUS", 2, None), 3: ("CONFLICT", 1, None), 4: ("UNMATCHED", None, None), 5: ("UNMATCHED", None, None), 6: ("MATCHED_EXACT", 3, "3")}


def test_channels_must_name_one_account(spark):
    frame = lambda *x: spark.createDataFrame([(c,) for c in x], "channel string")
    assert finance.account_of_channels(frame("Shop 2", "Depot 2 ", "Other")).first().ordinal == 2
    for bad in (frame("Shop 1", "Shop 2"), frame("Shop"), frame().limit(0)):
        with pytest.raises(Exception, match="no single account"):
            finance.account_of_channels(bad).collect()


def test_a_scroll_that_stands_still_is_an_error(spark):
    frame = lambda rows: spark.createDataFrame(rows, "scan string, page int, item_id string, payload string")
    rows = [("a", 0, "x", "1"), ("a", 0, "y", "2"), ("a", 1, "x", "1"), ("a", 1, "z", "3"), ("b", 0, "x", "1")]
    assert sorted((r.scan, r.page, r.item_id) for r in landing.scrolled(frame(rows)).collect()) == [("a", 0, "x"), ("a", 0, "y"), ("a", 1, "z"), ("b", 0, "x")]
    with pytest.raises(Exception, match="no new item"):
        landing.scrolled(frame([*rows, ("a", 2, "x", "1")])).collect()
    assert landing.scrolled(frame([])).collect() == []


def test_a_snapshot_is_replaced_as_a_whole(spark):
    ddl = "k int, day int, name string, value int"
    old = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "a", 3)], ddl)
    rows, actions = ingest.replace_whole(old, spark.createDataFrame([(1, 1, "a", 9), (2, 1, "a", 8)], ddl), ["k", "day"])
    assert sorted(map(tuple, rows.collect())) == [(1, 1, "a", 9), (1, 2, "a", 3), (2, 1, "a", 8)]
    assert sorted(map(tuple, actions.collect())) == [(1, 1, "UPDATED"), (2, 1, "CREATED")]


def test_a_failed_day_leaves_the_others_and_its_snapshot_alone(spark):
    plan = spark.createDataFrame([(1, "LOCAL_REFRESH"), (2, "FULL_EXTERNAL_PROCESS"), (3, "FULL_EXTERNAL_PROCESS"), (4, "SKIPPED"), (5, "BLOCKED_LEGACY")], "sold_on int, action string")
    stored = spark.createDataFrame([(1, "old", 1, 1, 50), (2, "old", 1, 1, 51), (4, "d4", 1, 1, 52), (5, None, 1, 1, 53), (9, "d9", 1, 1, 54)], "sold_on int, daily_sha256 string, margin int, products int, visits int")
    report = spark.createDataFrame([(i, f"d{i}", 7, 8) for i in range(1, 6)], "sold_on int, daily_sha256 string, margin int, products int")
    kept, days = finance.backfill(plan, stored, report, spark.createDataFrame([(3, 99)], "sold_on int, visits int"))
    assert {r.sold_on: (r.daily_sha256, r.margin, r.visits) for r in kept.collect()} == {1: ("d1", 7, 50), 2: ("old", 1, 51), 3: ("d3", 7, 99), 4: ("d4", 1, 52), 5: (None, 1, 53), 9: ("d9", 1, 54)}
    assert {r.sold_on: r.outcome for r in days.collect()} == {1: "UPDATED", 2: "FAILED", 3: "CREATED", 4: "SKIPPED", 5: "BLOCKED"}
