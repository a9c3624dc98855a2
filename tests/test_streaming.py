"""Tables that change in steps, sinks, the stream of landed pages and keyed state."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tradelens.operators import ingest
from tradelens.sources.sinks import write_snapshots, write_upsert
from tradelens.streaming.orders import STATE_STORE, changed_states
from tradelens.streaming.pages import LandedPages
from tradelens.streaming.tables import ControlTable, KeyedTable, Versions, recover_leases

START = datetime.datetime(2026, 1, 1)


def files_of(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_number_is_taken_once(spark, tmp_path):
    one, other = (Versions(spark, str(tmp_path / "v")) for _ in range(2))
    assert one.latest() == (0, {})
    assert one.put(1, {"a": 1}) and not other.put(1, {"b": 2})
    assert other.latest() == (1, {"a": 1}) and other.put(2, {"c": 3}) and one.latest() == (2, {"c": 3})
    assert not [f for f in os.listdir(tmp_path / "v") if f.startswith("draft")]


def keyed(spark, path):
    return KeyedTable(spark, str(path), ["k"], ["at"], buckets=4)


def test_fifty_batches_are_merged_to_one_file_a_bucket(spark, tmp_path):
    table, rng, want = keyed(spark, tmp_path), random.Random(1), {}
    for number in range(50):
        rows = [(rng.randrange(20), number, rng.randrange(3)) for _ in range(6)]
        for k, v, at in sorted(rows, key=lambda r: r[2]):
            want[k] = want[k] if k in want and want[k][0] == number and want[k][1] > at else (number, at)
        table.append(spark.createDataFrame(rows, "k int, v int, at int").coalesce(1), number)
    state = lambda: {r.k: r.v for r in table.read().collect()}
    assert state() == {k: v for k, (v, _) in want.items()}
    assert len(table.runs()) == 50 and table.compact() and len(table.runs()) == 1
    assert state() == {k: v for k, (v, _) in want.items()}
    read = {f for f in table.read().select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(read) <= 4
    # a batch that comes again after it was merged, and one after it
    table.append(spark.createDataFrame([(1, -1, 0)], "k int, v int, at int"), 7)
    table.append(spark.createDataFrame([(1, 99, 0)], "k int, v int, at int"), 50)
    assert state() == {k: v for k, (v, _) in want.items()} | {1: 99}
    table.clean()
    assert state()[1] == 99 and len(os.listdir(tmp_path / "data")) == 2


def test_a_broken_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    table = keyed(spark, tmp_path)
    for number in range(3):
        table.append(spark.createDataFrame([(number, number, 0), (9, number, 0)], "k int, v int, at int"), number)
    before = sorted(map(tuple, table.read().collect()))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(table.versions, "put", killed)
    with pytest.raises(KeyboardInterrupt):
        table.compact()
    monkeypatch.undo()
    again = keyed(spark, tmp_path)
    assert sorted(map(tuple, again.read().collect())) == before and len(again.runs()) == 3
    assert again.compact() and sorted(map(tuple, again.read().collect())) == before


def test_batches_that_come_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    table = keyed(spark, tmp_path)
    for number in range(2):
        table.append(spark.createDataFrame([(number, number, 0)], "k int, v int, at int"), number)
    write = table._write

    def slow(rows, name):
        write(rows, name)
        if name.startswith("merged"):
            keyed(spark, tmp_path).append(spark.createDataFrame([(0, 7, 0)], "k int, v int, at int"), 2)

    monkeypatch.setattr(table, "_write", slow)
    assert table.compact() and len(table.runs()) == 2
    assert {r.k: r.v for r in table.read().collect()} == {0: 7, 1: 1}
    # a repeated batch during a compaction: the merge is given up
    monkeypatch.setattr(table, "_write", lambda rows, name: (write(rows, name), keyed(spark, tmp_path).append(spark.createDataFrame([(0, 8, 0)], "k int, v int, at int"), 2) if name.startswith("merged") else None))
    assert not table.compact()
    assert {r.k: r.v for r in keyed(spark, tmp_path).read().collect()} == {0: 8, 1: 1}


RUNS = "run_id int, status string, heartbeat_at timestamp"


def test_of_two_writers_of_leases_one_wins(spark, tmp_path):
    table = ControlTable(spark, str(tmp_path))
    old, now = START, F.lit("2026-01-01 01:00:00").cast("timestamp")
    assert table.replace(spark.createDataFrame([(1, "RUNNING", old), (2, "RUNNING", old), (3, "COMPLETED", old)], RUNS))
    version, seen = table.read()
    # the run is heard of between the look and the write of a recovery
    beat = seen.withColumn("heartbeat_at", F.when(F.col("run_id") == 1, F.lit("2026-01-01 00:59:00").cast("timestamp")).otherwise(F.col("heartbeat_at")))
    assert table.replace(beat, version)
    assert not table.replace(ingest.recovered(seen, now), version)
    assert recover_leases(table, now)
    assert {r.run_id: r.status for r in table.read()[1].collect()} == {1: "RUNNING", 2: "FAILED", 3: "COMPLETED"}
    assert not recover_leases(table, now)


def test_a_recovery_that_lost_judges_the_new_heartbeat(spark, tmp_path, monkeypatch):
    table, now = ControlTable(spark, str(tmp_path)), F.lit("2026-01-01 01:00:00").cast("timestamp")
    table.replace(spark.createDataFrame([(1, "RUNNING", START)], RUNS))
    replace, done = table.replace, []

    def beaten(rows, seen=0):
        if not done:
            done.append(1)
            assert replace(spark.createDataFrame([(1, "RUNNING", START + datetime.timedelta(minutes=50))], RUNS), seen)
        return replace(rows, seen)

    monkeypatch.setattr(table, "replace", beaten)
    assert not recover_leases(table, now)
    assert table.read()[1].first().status == "RUNNING"


def test_snapshots_are_replaced_by_partition_and_a_run_once(spark, tmp_path):
    path, ddl = str(tmp_path / "snapshots"), "account_code string, day date, metric string, value int"
    day = [datetime.date(2026, 1, d) for d in (1, 2, 3)]
    first = spark.createDataFrame([("C1", day[0], "a", 1), ("C1", day[0], "b", 2), ("C1", day[1], "a", 3), ("C2", day[0], "a", 4)], ddl)
    assert write_snapshots(first, path, "r1")
    before = files_of(path)
    second = spark.createDataFrame([("C1", day[0], "a", 10), ("C2", day[2], "a", 11)], ddl)
    assert write_snapshots(second, path, "r2")
    got = lambda: sorted((r.account_code, r.day, r.metric, r.value) for r in spark.read.parquet(path).collect())
    want = [("C1", day[0], "a", 10), ("C1", day[1], "a", 3), ("C2", day[0], "a", 4), ("C2", day[2], "a", 11)]
    assert got() == want
    kept = {f: t for f, t in before.items() if "C1/day=2026-01-01" not in f}
    after = files_of(path)
    assert kept.items() <= after.items() and len(kept) == 2
    assert not write_snapshots(second, path, "r2") and not write_snapshots(first, path, "r1")
    assert files_of(path) == after and got() == want


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    path, ddl = str(tmp_path / "catalog"), "k int, sku string, product_id int"
    assert write_upsert(spark.createDataFrame([(i, "old", i) for i in range(40)], ddl), path, "r1", ["k"], keep=("product_id",), buckets=8)
    before = files_of(path)
    new = spark.createDataFrame([(3, "new", None), (77, "new", None)], ddl)
    assert write_upsert(new, path, "r2", ["k"], keep=("product_id",), buckets=8) and not write_upsert(new, path, "r2", ["k"], keep=("product_id",), buckets=8)
    got = {r.k: (r.sku, r.product_id) for r in spark.read.parquet(path).collect()}
    assert got == {i: ("old", i) for i in range(40)} | {3: ("new", 3), 77: ("new", None)}
    assert len(set(before) & set(files_of(path))) >= len(before) - 2


def land(folder, chunk, offset, results, limit=3, total=7):
    os.makedirs(f"{folder}/{chunk}", exist_ok=True)
    with open(f"{folder}/{chunk}/{offset}.json", "w") as f:
        json.dump({"limit": limit, "total": total, "results": results}, f)


def test_pages_go_on_where_a_partial_page_held_them_up(spark, tmp_path):
    spark.dataSource.register(LandedPages)
    folder = str(tmp_path / "land")

    def run():
        stream = spark.readStream.format("landed_pages").load(folder)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.chunk, r.position, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    def want(chunk, n):
        return [(chunk, i, f"{chunk}:{i}") for i in range(n)]

    full = {c: [f"{c}:{i}" for i in range(7)] for c in ("2026-01", "2026-02")}
    land(folder, "2026-01", 0, full["2026-01"][:3])
    land(folder, "2026-01", 3, full["2026-01"][3:5])  # one result is missing
    land(folder, "2026-02", 0, full["2026-02"][:3])
    assert run() == want("2026-01", 3) == run()
    land(folder, "2026-01", 3, full["2026-01"][3:6])
    assert run() == want("2026-01", 6)
    land(folder, "2026-01", 6, full["2026-01"][6:])  # the chunk ends, so the next one goes on
    assert run() == want("2026-01", 7) + want("2026-02", 3)
    land(folder, "2026-02", 3, full["2026-02"][3:6])
    land(folder, "2026-02", 6, full["2026-02"][6:])
    land(folder, "2026-03", 0, [], total=0)
    land(folder, "2026-04", 0, ["2026-04:0"], total=1)
    assert run() == want("2026-01", 7) + want("2026-02", 7) + want("2026-04", 1) == run()


def test_keyed_state_equals_the_batch_query_and_is_forgotten(spark, tmp_path):
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        rng = random.Random(6)
        rows = [(str(rng.randrange(12)), rng.choice("ABC"), START + datetime.timedelta(minutes=i)) for i in range(60)]
        parts = [rows[:20], rows[20:45], rows[45:]]
        ddl = "order_id string, status string, arrived_at timestamp"
        told, sizes = {}, []

        def keep(batch, number):
            told.update({r.order_id: r.status for r in batch.collect()})

        def run(part, number):
            spark.createDataFrame(rng.sample(part, len(part)), ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
            stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "land"))
            out = changed_states(stream, forget=datetime.timedelta(days=90))
            query = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
            query.awaitTermination()
            sizes.append(max((p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]), default=0))

        for number, part in enumerate(parts):
            run(part, number)
        batch = ingest.latest(spark.createDataFrame([(o, s, at, n) for n, p in enumerate(parts) for o, s, at in p], ddl + ", batch int"), ["order_id"], ["batch", "arrived_at"])
        assert told == {r.order_id: r.status for r in batch.collect()}
        many = sizes[-1]
        # after 90 days of newer arrivals the old orders are gone from the state
        for step in (1, 2):
            run([("new", "A" if step == 1 else "B", START + datetime.timedelta(days=100 * step))], 3 + step)
        assert sizes[-1] < many and sizes[-1] <= 6
    finally:
        for k in STATE_STORE:
            spark.conf.unset(k)


def test_keyed_state_is_one_value_a_bucket_and_tells_every_change(spark, tmp_path):
    """Fifty orders in two buckets; a state that comes back is told again, a repeated one is not, nulls are values."""
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        ddl, told, sizes = "order_id string, status string, total decimal(14,2), arrived_at timestamp", [], []
        for number, (status, total) in enumerate([("A", None), ("A", None), ("B", None), ("A", 5), ("A", None)]):
            at = START + datetime.timedelta(minutes=number)
            rows = [(str(i), "old", None, at) for i in range(50)] + [(str(i), status if i else "A", total, at + datetime.timedelta(microseconds=1)) for i in range(50)]
            spark.createDataFrame(rows, ddl.replace("decimal(14,2)", "int")).withColumn("total", F.col("total").cast("decimal(14,2)")).write.mode("append").parquet(str(tmp_path / "land"))
            out = changed_states(spark.readStream.schema(ddl).parquet(str(tmp_path / "land")), "status string, total decimal(14,2)", buckets=2)
            now = []
            query = out.writeStream.outputMode("update").foreachBatch(lambda batch, _, now=now: now.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
            query.awaitTermination()
            told.append({r.order_id: (r.status, r.total) for r in now})
            sizes.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
        ids = {str(i) for i in range(50)}
        assert [set(x) for x in told] == [ids, set(), ids - {"0"}, ids, ids]
        assert told[2]["1"] == ("B", None) and told[3]["1"] == ("A", 5) and told[4]["0"] == ("A", None)
        assert max(sizes) <= 6
    finally:
        for k in STATE_STORE:
            spark.conf.unset(k)


def test_only_the_columns_asked_for_are_shuffled_where_runs_are_merged(spark, tmp_path):
    table = keyed(spark, tmp_path)
    for number in range(2):
        table.append(spark.createDataFrame([(1, number, "x" * 50, 0), (2 + number, number, "y", 0)], "k int, v int, wide string, at int"), number)
    few = table.read(["k", "v"])
    assert few.columns == ["k", "v"] and sorted((r.k, r.v) for r in few.collect()) == [(1, 1), (2, 0), (3, 1)]
    assert "wide" not in few._jdf.queryExecution().executedPlan().toString()
