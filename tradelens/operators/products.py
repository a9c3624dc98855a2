"""Product curves, coverage, rankings, comparison of accounts and stale products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import STATUSES, business_days, ratio_percent
from .ranking import by_locale, ranked


def resolved(sales: DataFrame, direct: str = "product_id", listed: str | None = None) -> DataFrame:
    """``product``: the item's own link, else its listing's; two different links are an error."""
    if listed is None:
        return sales.withColumn("product", F.col(direct))
    clash = F.col(direct).isNotNull() & F.col(listed).isNotNull() & (F.col(direct) != F.col(listed))
    return sales.withColumn("product", F.when(clash, F.raise_error(F.lit("an item and its listing name different products"))).otherwise(F.coalesce(direct, listed)))


def link_audit(sales: DataFrame, direct: str, listed: str) -> DataFrame:
    """Items by how their product is found: their own link, their listing's, none, or two that differ (the caller's error)."""
    a, b = F.col(direct), F.col(listed)
    clash = F.coalesce(a != b, F.lit(False))
    return sales.agg(
        F.count("*").alias("items"), F.count_if(a.isNotNull() & ~clash).alias("direct_links"), F.count_if(a.isNull() & b.isNotNull()).alias("listing_links"),
        F.count_if(a.isNull() & b.isNull()).alias("unlinked"), F.count_if(clash).alias("conflicts"),
    )


def closed_window(sales: DataFrame, until: str, days: int = 30) -> DataFrame:
    """Closed window of raw instants [until - days, until]."""
    end = F.to_timestamp(F.lit(until))
    return sales.where(F.col("sold_at").between(end - F.expr(f"INTERVAL {days} DAYS"), end))


def product_sales(products: DataFrame, sales: DataFrame) -> DataFrame:
    """Units by account, distinct orders and last sale of every product, PAID items only; products without sales stay."""
    paid = sales.where((F.col("status") == "PAID") & F.col("product").isNotNull())

    def units(account):
        return F.sum(F.when(F.col("account_code") == account, F.col("quantity")).otherwise(0)).alias(f"units_{account.lower()}")

    facts = paid.groupBy(F.col("product").alias("product_id")).agg(F.sum("quantity").alias("units"), units("C1"), units("C2"), F.countDistinct("order_id").alias("orders"), F.max("sold_at").alias("last_sale_at"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("units", "units_c1", "units_c2", "orders")]
    return products.join(facts, "product_id", "left").select("product_id", "sku", *zero, "last_sale_at")


def product_curve(per_product: DataFrame) -> DataFrame:
    """Units in descending order, then sku, then id; classes from the double percentage before a row (<80 A, <95 B)."""
    out = ranked(per_product, F.desc("units"), by_locale("sku"), F.asc("product_id"), value="units")
    ahead = ratio_percent("before", "total")
    kind = F.when(ahead < 80, "A").when(ahead < 95, "B").otherwise("C")
    return out.select(*per_product.columns, "rank", kind.alias("abc_class"), ratio_percent("units", "total").alias("share"), ratio_percent(F.col("before") + F.col("units"), "total").alias("cumulative_share"))


def coverage(sales: DataFrame) -> DataFrame:
    has = F.col("product").isNotNull()
    n, u = F.count("*"), F.sum("quantity")
    return sales.agg(n.alias("items"), F.count(F.when(has, 1)).alias("items_with_product"), u.alias("units"), F.coalesce(F.sum(F.when(has, F.col("quantity"))), F.lit(0)).alias("units_with_product")).select(
        "items", "items_with_product", (F.col("items") - F.col("items_with_product")).alias("items_without_product"), "units", "units_with_product",
        ratio_percent("items_with_product", "items").alias("items_percent"), ratio_percent("units_with_product", "units").alias("units_percent"),
    )


def status_impact(sales: DataFrame) -> DataFrame:
    """Per status: orders, items, units, linked items; the order's amount counts once."""
    per_order = sales.groupBy("status", "order_id").agg(F.max("gross_amount").alias("amount"), F.count("*").alias("items"), F.sum("quantity").alias("units"), F.count("product").alias("linked"))
    return per_order.groupBy("status").agg(F.count("*").alias("orders"), F.sum("items").alias("items"), F.sum("units").alias("units"), F.sum("linked").alias("linked_items"), F.sum(F.coalesce("amount", F.lit(0))).cast("decimal(38,2)").alias("amount"))


def account_comparison(curve: DataFrame, shared: DataFrame) -> DataFrame:
    """Products known in both accounts: difference of units, also in percent of the mean, and each account's part."""
    a, b = F.col("units_c1"), F.col("units_c2")
    rows = ranked(curve.join(shared, "product_id", "left_semi"), F.desc("units"), by_locale("sku"), F.asc("product_id"), name="position")
    return rows.select(
        "product_id", "sku", "units_c1", "units_c2", F.abs(a - b).alias("difference"), ratio_percent(F.abs(a - b), (a + b) / 2).alias("difference_percent"), ratio_percent(a, a + b).alias("share_c1"), ratio_percent(b, a + b).alias("share_c2"), "position",
    )


def shared_products(sales: DataFrame) -> DataFrame:
    both = F.collect_set("account_code")
    return sales.where(F.col("product").isNotNull()).groupBy(F.col("product").alias("product_id")).agg(both.alias("codes")).where(F.array_contains("codes", "C1") & F.array_contains("codes", "C2")).select("product_id")


def rankings(per_product: DataFrame, sales: DataFrame) -> DataFrame:
    """Ranks by units of the sums of products: over all, over members of C1 and over members of C2."""
    members = sales.where(F.col("product").isNotNull()).select(F.col("product").alias("product_id"), F.col("account_code").alias("scope")).distinct()
    rows = per_product.select("product_id", "sku", F.lit("ALL").alias("scope"), F.col("units").alias("value")).unionByName(
        per_product.join(members, "product_id").select("product_id", "sku", "scope", F.when(F.col("scope") == "C1", F.col("units_c1")).otherwise(F.col("units_c2")).alias("value"))
    )
    return ranked(rows, F.desc("value"), by_locale("sku"), F.asc("product_id"), within=("scope",), name="position")


def last_sales(sales: DataFrame) -> DataFrame:
    return sales.where((F.col("status") == "PAID") & F.col("product").isNotNull()).groupBy(F.col("product").alias("product_id")).agg(F.max("sold_at").alias("last_sale_at"))


def stale_products(curve: DataFrame, history: DataFrame, until: str, days: int = 30) -> DataFrame:
    """Products without PAID units in the window whose last sale is at least ``days`` civil days old."""
    now = F.to_timestamp(F.lit(until))
    rows = curve.where("units = 0").drop("last_sale_at").join(history.where(F.col("last_sale_at") <= now), "product_id", "left")
    since = business_days("last_sale_at", now)
    return rows.where(F.col("last_sale_at").isNull() | (since >= days)).select("product_id", "sku", "last_sale_at", F.when(F.col("last_sale_at").isNotNull(), since).cast("long").alias("days_since_sale"))


def status_order(column: str = "status"):
    """Position of a status in its declared order."""
    return F.array_position(F.array(*(F.lit(s) for s in STATUSES)), F.col(column))
