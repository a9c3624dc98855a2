"""The driver's tables seen as seller tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, account_code, sold_at, gross_amount, currency, status."""
    state, priority = F.col("o_orderstatus"), F.col("o_orderpriority")

    def by(**kinds):
        out = F.lit("PAID")
        for level, name in kinds.items():
            out = F.when(priority == {"urgent": "1-URGENT", "high": "2-HIGH", "low": "5-LOW"}[level], name).otherwise(out)
        return out

    status = (
        F.when(state == "F", by(urgent="DELIVERED", high="SHIPPED"))
        .when(state == "O", by(urgent="PENDING", high="PROCESSING", low="UNKNOWN"))
        .otherwise(by(urgent="CANCELLED", high="REFUNDED", low="PARTIALLY_REFUNDED"))
    )
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.when(F.col("o_custkey") % 2 == 0, "C1").otherwise("C2").alias("account_code"),
        F.col("o_orderdate").cast("timestamp").alias("sold_at"), F.col("o_totalprice").cast("decimal(14,2)").alias("gross_amount"), F.lit("BRL").alias("currency"), status.alias("status"),
    )


def items(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """One row per (order, listing, sellable): quantity, item_gross, product_id; with the columns of the orders ``of`` if given.

    Where ``of`` is a part of the orders, lines meet it before they are added up, so only its lines are.
    """
    product = F.when(F.col("l_returnflag") != "R", F.col("l_partkey") % 50)
    lines, key = read(spark, sf_dir, "lineitem"), F.col("l_orderkey").alias("order_id")
    more = []
    if of is not None:
        lines, key = lines.join(of, F.col("l_orderkey") == F.col("order_id")), F.col("order_id")
        more = [c for c in of.columns if c != "order_id"]
    return lines.groupBy(key, F.col("l_partkey").alias("listing_id"), F.col("l_suppkey").alias("sellable_id")).agg(
        *(F.any_value(c).alias(c) for c in more), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).cast("decimal(38,2)").alias("item_gross"), F.max(product).alias("product_id")
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing_id, title, listing_status, unit_price, pack (composition quantity)."""
    kind = F.col("p_size") % 4
    status = F.when(kind == 0, "paused").when(kind == 1, F.lit(None).cast("string")).otherwise("active")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("listing_id"), F.col("p_name").alias("title"), status.alias("listing_status"), F.col("p_retailprice").cast("decimal(14,2)").alias("unit_price"), (1 + kind).cast("long").alias("pack")
    )


def sales(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Order items with order, account and listing: the fact view of all sales operators; of the orders ``of`` (all)."""
    rows = items(spark, sf_dir, of)
    if of is None:  # added up first: the orders are joined to fewer rows
        rows = rows.join(orders(spark, sf_dir), "order_id")
    return rows.join(listings(spark, sf_dir), "listing_id").withColumn("revenue", F.col("unit_price") * F.col("quantity"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty products and one that never sold."""
    return spark.range(0, 51).select(F.col("id").alias("product_id"), F.format_string("SKU-%02d", F.col("id")).alias("sku"))


def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_code, day, visits, sales_count, gross: one row per account and day, days divisible by 7 missing."""
    e = read(spark, sf_dir, "events")
    day = F.to_date(F.col("ts"))
    rows = e.select(F.when(F.col("user_id") % 2 == 0, "C1").otherwise("C2").alias("account_code"), day.alias("day"), "event_type", F.col("value").cast("decimal(14,2)").alias("value"))
    bought = F.col("event_type") == "purchase"
    return (
        rows.where(F.dayofmonth("day") % 7 != 0)
        .groupBy("account_code", "day")
        .agg(F.count(F.when(F.col("event_type") == "view", 1)).alias("visits"), F.count(F.when(bought, 1)).alias("sales_count"), F.coalesce(F.sum(F.when(bought, F.col("value"))), F.lit(0)).cast("decimal(38,2)").alias("gross"))
    )


#: Last instant of the data: what "now" is to the queries.
ANCHOR = "2001-08-01 00:00:00"

SQL = """
o AS (SELECT o_orderkey AS order_id, CASE WHEN o_custkey % 2 = 0 THEN 'C1' ELSE 'C2' END AS account_code, CAST(o_orderdate AS TIMESTAMP) AS sold_at,
  CAST(o_totalprice AS DECIMAL(14,2)) AS gross_amount, 'BRL' AS currency,
  CASE o_orderstatus
    WHEN 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'DELIVERED' WHEN '2-HIGH' THEN 'SHIPPED' ELSE 'PAID' END
    WHEN 'O' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'PENDING' WHEN '2-HIGH' THEN 'PROCESSING' WHEN '5-LOW' THEN 'UNKNOWN' ELSE 'PAID' END
    ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'CANCELLED' WHEN '2-HIGH' THEN 'REFUNDED' WHEN '5-LOW' THEN 'PARTIALLY_REFUNDED' ELSE 'PAID' END END AS status
  FROM orders),
i AS (SELECT l_orderkey AS order_id, l_partkey AS listing_id, l_suppkey AS sellable_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(38,2)) AS item_gross, max(CASE WHEN l_returnflag <> 'R' THEN l_partkey % 50 END) AS product_id
  FROM lineitem GROUP BY ALL),
li AS (SELECT p_partkey AS listing_id, p_name AS title, CASE p_size % 4 WHEN 0 THEN 'paused' WHEN 1 THEN NULL ELSE 'active' END AS listing_status,
  CAST(p_retailprice AS DECIMAL(14,2)) AS unit_price, CAST(1 + p_size % 4 AS BIGINT) AS pack FROM part),
s AS (SELECT *, CAST(unit_price AS DECIMAL(38,2)) * quantity AS revenue FROM i JOIN o USING (order_id) JOIN li USING (listing_id)),
pr AS (SELECT range AS product_id, printf('SKU-%02d', range) AS sku FROM range(0, 51)),
dm AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'C1' ELSE 'C2' END AS account_code, CAST(ts AS DATE) AS day,
  count(*) FILTER (event_type = 'view') AS visits, count(*) FILTER (event_type = 'purchase') AS sales_count,
  CAST(coalesce(sum(CAST(value AS DECIMAL(14,2))) FILTER (event_type = 'purchase'), 0) AS DECIMAL(38,2)) AS gross
  FROM events WHERE day(CAST(ts AS DATE)) % 7 <> 0 GROUP BY 1, 2)
"""


def pct(n: str, d: str) -> str:
    """SQL for n / d * 100 with 6 decimals, half up, of whole numbers n, d >= 0; 0 for d = 0."""
    return f"(CASE WHEN ({d}) = 0 THEN 0.0 ELSE CAST((2 * CAST({n} AS HUGEINT) * 100000000 + CAST({d} AS HUGEINT)) // (2 * CAST({d} AS HUGEINT)) AS DOUBLE) / 1e6 END)"


def signed_pct(n: str, d: str) -> str:
    """The same for any n, null for d = 0 or null."""
    return f"(CASE WHEN ({d}) <> 0 THEN sign({n}) * CAST((2 * CAST(abs({n}) AS HUGEINT) * 100000000 + CAST({d} AS HUGEINT)) // (2 * CAST({d} AS HUGEINT)) AS DOUBLE) / 1e6 END)"
