"""Landed payloads of web services as tables: orders, catalog items and paged responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import map_values

ORDER = """id STRING, pack_id STRING, status STRING, date_created TIMESTAMP, total_amount DECIMAL(14,2), paid_amount DECIMAL(14,2),
payments ARRAY<STRUCT<transaction_amount_refunded: DECIMAL(14,2)>>,
order_items ARRAY<STRUCT<item: STRUCT<id: STRING, variation_id: STRING, seller_sku: STRING>, quantity: BIGINT, unit_price: DECIMAL(14,2), gross_price: DECIMAL(14,2)>>"""
CATALOG = """id STRING, title STRING, status STRING, seller_custom_field STRING, attributes ARRAY<STRUCT<id: STRING, value_name: STRING>>,
variations ARRAY<STRUCT<id: STRING, seller_custom_field: STRING, attributes: ARRAY<STRUCT<id: STRING, value_name: STRING>>, attribute_combinations: ARRAY<STRUCT<name: STRING, value_name: STRING>>>>"""
# Raw order states and the normalised ones.
RAW_STATUS = {
    "confirmed": "PROCESSING", "payment_required": "PENDING", "payment_in_process": "PENDING", "partially_paid": "PENDING", "paid": "PAID",
    "partially_refunded": "PARTIALLY_REFUNDED", "pending_cancel": "CANCELLED", "cancelled": "CANCELLED", "invalid": "UNKNOWN",
}


def paged(pages: DataFrame) -> DataFrame:
    """Rows of landed pages after the checks of a paged search.

    ``pages``: request ``scan``, ``page_offset``, ``page_limit``, ``total``, ``results`` (array of JSON).
    Raises an error for limits under 1, totals that differ within a scan, repeated offsets and gaps.
    A scan is checked by counts (its pages cover 0 to total once), so no page list is gathered.
    """
    span = F.greatest(F.lit(0), F.least("page_limit", F.col("total") - F.col("page_offset")))
    checks = pages.groupBy("scan").agg(
        ((F.min("page_limit") >= 1) & (F.min("total") == F.max("total")) & (F.sum(span) == F.max("total")) & (F.count_distinct("page_offset") == F.count("*"))).alias("good")
    )
    checked = pages.join(checks, "scan").withColumn("results", F.when(F.col("good"), F.col("results")).otherwise(F.raise_error(F.lit("inconsistent pagination")).cast("array<string>")))
    return checked.select("scan", F.explode("results").alias("payload"))


def within(rows: DataFrame, instant: str, start: Column, end: Column) -> DataFrame:
    """Rows of the half-open interval [start, end)."""
    return rows.where((F.col(instant) >= start) & (F.col(instant) < end))


def scrolled(pages: DataFrame) -> DataFrame:
    """The items of a scroll, each once; an error if a page brought nothing new, so that the scroll stood still.

    ``pages``: ``scan``, ``page`` (whole numbers in order), ``item_id``, and other columns, equal for equal items.
    """
    rest = [c for c in pages.columns if c not in ("scan", "page", "item_id")]
    items = pages.groupBy("scan", "item_id").agg(F.min("page").alias("page"), *(F.first(c).alias(c) for c in rest))
    fresh = items.select("scan", "page").distinct()
    stuck = pages.select("scan", "page").distinct().join(fresh, ["scan", "page"], "left_anti").agg(F.count("*").alias("_stuck"))  # one row
    checked = F.when(F.col("_stuck") > 0, F.raise_error(F.lit("a page of a scroll brought no new item")).cast("boolean")).otherwise(True)
    return items.join(F.broadcast(stuck)).where(checked).select(*pages.columns)


def bulk(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bodies with code 200, and one row counting all requests and failures. ``responses``: code, body."""
    good = F.coalesce(F.col("code") == 200, F.lit(False))
    return responses.where(good).select("body"), responses.agg(F.count("*").alias("requested"), F.count_if(~good).alias("failed"))


def parse_orders(payloads: DataFrame, *keep: str) -> DataFrame:
    """One row per payload: the order's columns, its lines, refunds (null without a payments array), and ``keep``.

    An unreadable payload gives a row of nulls.
    """
    o = payloads.select(F.from_json("payload", ORDER).alias("o"), *keep).select("o.*", *keep)
    refunded = F.when(F.col("payments").isNotNull(), F.aggregate("payments", F.lit(0).cast("decimal(38,2)"), lambda a, p: (a + F.coalesce(p["transaction_amount_refunded"], F.lit(0))).cast("decimal(38,2)")))
    return o.select(
        F.col("id").alias("order_id"), "pack_id", map_values("status", RAW_STATUS, "UNKNOWN").alias("status"), F.col("date_created").alias("sold_at"),
        F.col("total_amount").alias("gross_amount"), F.col("paid_amount"), refunded.alias("refunded_amount"), F.col("order_items").alias("lines"), *keep,
    )


def order_lines(parsed: DataFrame) -> DataFrame:
    """One row per order line; the sellable is the variation, else the listing."""
    line = parsed.select("order_id", F.explode("lines").alias("l"))
    listing = F.col("l.item.id")
    return line.select(
        "order_id", listing.alias("listing_id"), F.coalesce("l.item.variation_id", listing).alias("sellable_id"), F.col("l.item.seller_sku").alias("seller_sku"),
        F.col("l.quantity").alias("quantity"), F.col("l.unit_price").alias("unit_price"),
        F.coalesce(F.col("l.gross_price"), F.col("l.unit_price") * F.col("l.quantity")).cast("decimal(38,2)").alias("item_gross"),
    )


def _sku(attributes: Column, direct: Column) -> Column:
    """The SELLER_SKU attribute, else the direct field; blanks are null."""
    named = F.filter(attributes, lambda a: (a["id"] == "SELLER_SKU") & (F.trim(a["value_name"]) != ""))
    return F.coalesce(F.trim(F.get(named, F.lit(0))["value_name"]), F.nullif(F.trim(direct), F.lit("")))


def catalog_rows(payloads: DataFrame) -> DataFrame:
    """One row per variation, or one for an item without variations.

    listing_id, title, listing_status, variation_id, label (``name: value / ...``), sku, sku_source
    (item, variation or none).
    """
    c = payloads.select(F.from_json("payload", CATALOG).alias("c")).select("c.*")
    rows = c.select("id", "title", "status", _sku(F.col("attributes"), F.col("seller_custom_field")).alias("item_sku"), F.explode_outer("variations").alias("v"))
    own = _sku(F.col("v.attributes"), F.col("v.seller_custom_field"))
    label = F.array_join(F.transform("v.attribute_combinations", lambda a: F.concat_ws(": ", a["name"], a["value_name"])), " / ")
    rows = rows.select(F.col("id").alias("listing_id"), "title", F.col("status").alias("listing_status"), F.col("v.id").alias("variation_id"), F.nullif(label, F.lit("")).alias("label"), own.alias("own"), "item_sku")
    source = F.when(F.col("own").isNotNull(), "variation").when(F.col("item_sku").isNotNull(), "item").otherwise("none")
    return rows.select("listing_id", "title", "listing_status", "variation_id", "label", F.coalesce("own", "item_sku").alias("sku"), source.alias("sku_source"))
