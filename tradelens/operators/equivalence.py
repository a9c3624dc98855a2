"""Listings of two accounts that sell the same goods, compared in units of their components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EFFECTIVE, delta_percent, money


def orient(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """Undirected edges (a, b) as (left in C1, right in C2); edges inside one account are dropped."""
    one, two = (accounts.select(F.col("listing_id").alias(c), F.col("account_code").alias(f"{c}_account")) for c in ("a", "b"))
    rows = edges.join(one, "a").join(two, "b")
    straight = (F.col("a_account") == "C1") & (F.col("b_account") == "C2")
    turned = (F.col("a_account") == "C2") & (F.col("b_account") == "C1")
    return rows.where(straight | turned).select(F.when(straight, F.col("a")).otherwise(F.col("b")).alias("left"), F.when(straight, F.col("b")).otherwise(F.col("a")).alias("right"), "state")


def component_rows(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Components of both sides of each pair, null where one side has none."""
    one = pairs.join(components, pairs.left == components.listing_id).select("left", "right", "component", F.col("quantity").alias("left_quantity"))
    two = pairs.join(components, pairs.right == components.listing_id).select("left", "right", "component", F.col("quantity").alias("right_quantity"))
    return one.join(two, ["left", "right", "component"], "full_outer")


def comparable(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Confirmed pairs that are one to one and whose sides have the same components."""
    own = components.groupBy("listing_id").agg(F.array_sort(F.collect_set("component")).alias("ids"))
    confirmed = pairs.where(F.col("state") == "CONFIRMED")
    once = confirmed.groupBy("left").agg(F.count("*").alias("n")).where("n = 1").select("left")
    single = confirmed.groupBy("right").agg(F.count("*").alias("n")).where("n = 1").select("right")
    rows = confirmed.join(once, "left", "left_semi").join(single, "right", "left_semi")
    rows = rows.join(own.select(F.col("listing_id").alias("left"), F.col("ids").alias("left_ids")), "left").join(own.select(F.col("listing_id").alias("right"), F.col("ids").alias("right_ids")), "right")
    return rows.where(F.col("left_ids") == F.col("right_ids")).select("left", "right")


def side_metrics(sales: DataFrame, components: DataFrame) -> DataFrame:
    """Per account and listing: distinct orders, units, revenue and component units of effective sales."""
    packs = components.groupBy("listing_id").agg(F.sum("quantity").alias("pieces"))
    rows = sales.where(F.col("status").isin(EFFECTIVE)).join(packs, "listing_id", "left")
    return rows.groupBy("account_code", "listing_id").agg(F.countDistinct("order_id").alias("orders"), F.sum("quantity").alias("units"), money(F.sum("revenue")).alias("revenue"), F.sum(F.col("quantity") * F.coalesce("pieces", F.lit(1))).alias("pieces"))


def compare(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Both sides of each pair with absolute and percentage differences (C1 against C2); no sales count as zero."""

    def side(account, key):
        rows = metrics.where(F.col("account_code") == account)
        return rows.select(F.col("listing_id").alias(key), *(F.col(c).alias(f"{key}_{c}") for c in ("orders", "units", "revenue", "pieces")))

    rows = pairs.join(side("C1", "left"), "left", "left").join(side("C2", "right"), "right", "left")
    zero = {f"{k}_{c}": F.coalesce(f"{k}_{c}", F.lit(0)).cast("long") for k in ("left", "right") for c in ("orders", "units", "pieces")}
    rows = rows.withColumns(zero | {f"{k}_revenue": money(F.coalesce(f"{k}_revenue", F.lit(0))) for k in ("left", "right")})
    return rows.select(
        "left", "right", *zero, "left_revenue", "right_revenue", (F.col("left_pieces") - F.col("right_pieces")).alias("pieces_delta"), money(F.col("left_revenue") - F.col("right_revenue")).alias("revenue_delta"),
        delta_percent("left_revenue", "right_revenue").alias("revenue_delta_percent"),
    )
