"""Every query of the library against its SQL in DuckDB, and rules of the domain on small frames."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tradelens.functions import scalars as s
from tradelens.operators import abc, metrics, products
from tradelens.plans import registry


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", registry.queries())
def test_query_equals_its_sql(spark, duck, small, name):
    assert name in registry.oracle_sql()
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_curve_of_four_listings(spark):
    rows = spark.createDataFrame([("1", 79), ("2", 14), ("3", 5), ("4", 2)], "listing_id string, units long").withColumn("revenue", F.lit(1))
    out = {r.listing_id: (r["rank"], r.abc_class, r.cumulative_share) for r in abc.listing_curve(rows).collect()}
    assert out == {"1": (1, "A", 79.0), "2": (2, "A", 93.0), "3": (3, "B", 98.0), "4": (4, "C", 100.0)}


def test_curve_without_sales_is_all_a(spark):
    rows = spark.createDataFrame([("1", 0), ("2", 0)], "listing_id string, units long")
    assert {r.abc_class for r in abc.listing_curve(rows).collect()} == {"A"}


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "text,value", [("R$ 1.234,56", "1234.56"), ("(10,00)", "-10"), ("-3,5", "-3.5"), ("R$ -7", "-7"), ("12.50", "12.50"), ("abc", None), ("", None)]
)
def test_money_text(spark, text, value):
    got = one(spark, s.parse_brl(F.lit(text)))
    assert got is None if value is None else got == decimal.Decimal(value)


@pytest.mark.parametrize("text,value", [("2026-02-28", datetime.date(2026, 2, 28)), ("2026-02-30", None), ("2026-2-3", None), (None, None)])
def test_strict_days(spark, text, value):
    assert one(spark, s.parse_day(F.lit(text).cast("string"))) == value


def test_rate_and_redaction(spark):
    assert one(spark, s.parse_rate(F.lit("12,3%"))) == decimal.Decimal("0.123")
    assert one(spark, s.redact(F.lit("mail a.b@c.com or 123.456.789-09"))) == "mail [REDACTED] or [REDACTED]"
    assert one(spark, s.identity_key(F.lit("a"), F.lit(None), F.lit("c"))) == "a||c"


def test_two_links_of_one_item_are_an_error(spark):
    rows = spark.createDataFrame([(1, 2)], "product_id long, listed long")
    with pytest.raises(Exception, match="different products"):
        products.resolved(rows, "product_id", "listed").collect()


def test_mixed_currencies_are_an_error(spark):
    rows = spark.createDataFrame([("BRL",), ("USD",)], "currency string")
    with pytest.raises(Exception, match="mix currencies"):
        metrics.single_currency(rows).collect()


def test_overlay_replaces_also_with_null(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, value int")
    new = spark.createDataFrame([("b", None), ("c", 3)], "k string, value int")
    assert {(r.k, r.value) for r in metrics.overlay(old, new, ["k"]).collect()} == {("a", 1), ("b", None), ("c", 3)}


def test_a_day_without_value_leaves_no_average(spark):
    rows = spark.createDataFrame([("C1", datetime.date(2026, 1, 1), 5), ("C1", datetime.date(2026, 1, 2), 5), ("C2", datetime.date(2026, 1, 1), None), ("C2", datetime.date(2026, 1, 2), 3)], "account_code string, day date, visits int")
    out = {r.account_code: (r.peak_day.day, r.day_average) for r in metrics.peaks(rows, "visits").collect()}
    assert out["C1"] == (1, 5.0) and out["C2"][1] is None


def test_the_rest_works_without_the_corpus_part(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "tradelens.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    importlib.reload(entry)
    assert set(entry.queries()) == set(registry.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_ranks_of_equal_values_do_not_meet_in_one_task(spark):
    """Nine of ten listings with one value: ranges are cut by the ties, so no range holds many more than another."""
    from tradelens.operators.ranking import ranked

    rows = spark.range(8000).selectExpr("id as listing_id", "if(id % 10 = 0, id % 7 + 2, 1) as units", "if(id % 3 = 0, 'a', 'b') as scope").repartition(3)
    out = ranked(rows, F.desc("units"), F.asc("listing_id"), within=("scope",), value="units").collect()
    for scope in "ab":
        want = sorted((r for r in rows.where(F.col("scope") == scope).collect()), key=lambda r: (-r.units, r.listing_id))
        got = sorted((r for r in out if r.scope == scope), key=lambda r: r["rank"])
        assert [(r.listing_id, r.units) for r in got] == [(r.listing_id, r.units) for r in want]
        assert [r["rank"] for r in got] == list(range(1, len(want) + 1))
        ahead = 0
        for r in got:
            assert (r.before, r.total) == (ahead, sum(x.units for x in want))
            ahead += r.units
    dealt = rows.repartitionByRange(4, F.desc("units"), F.asc("listing_id"))
    sizes = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 4 and sizes[-1] < 1.5 * sizes[1]


def test_the_window_reaches_the_lines_before_they_are_added_up(spark, small):
    plan = registry.queries()["agg_listing_sales"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") <= 1 and plan.count("Relation") == 3
    lines = plan.splitlines()
    depth = {name: min(len(x) - len(x.lstrip(" :+-")) for x in lines if name in x) for name in ("Aggregate [order_id", "o_orderdate")}
    assert depth["o_orderdate"] > depth["Aggregate [order_id"]


def test_sales_meet_the_history_of_their_account_without_being_dealt_by_account(spark):
    """No hint of size: without a broadcast of the bounds, all sales of an account met in one task."""
    from tradelens.operators import stale

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([("C1", 1, 1), ("C1", 2, 2), ("C2", 3, 9), (None, 4, 3)], "account_code string, order_id long, day int").select("account_code", "order_id", F.timestamp_seconds(F.col("day") * 86400).alias("sold_at"))
        bounds = stale.history_coverage(rows.where("order_id <> 2"))
        found = stale.within_history(rows, bounds)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r.order_id for r in found.collect()) == [1, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
