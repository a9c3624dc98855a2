"""Landed ERP orders and shipments: the day's summaries with their details, and shipment kinds by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ZONE, col, local_day


def civil_day(text, zone: str = ZONE) -> Column:
    """The day that a landed time names: its own date if it has no offset, else that of its instant in ``zone``; null if it is no time."""
    text = col(text)
    plain = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss[.SSS]")]
    zoned = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSS]XX", "yyyy-MM-dd HH:mm:ssXXX")]
    return F.coalesce(F.to_date(F.coalesce(*plain)), local_day(F.coalesce(*zoned), zone))


def on_local_day(text, day: Column, zone: str = ZONE) -> Column:
    """Whether a landed time falls on a civil day; false for null. Text that names no time stops the job with an error."""
    text = col(text)
    named = civil_day(text, zone)
    unknown = text.isNotNull() & named.isNull()
    return F.when(unknown, F.raise_error(F.concat(F.lit("no time can be read from "), text)).cast("boolean")).otherwise(F.coalesce(named == day, F.lit(False)))


def erp_orders(summaries: DataFrame, details: DataFrame, day: Column, zone: str = ZONE) -> DataFrame:
    """The day's orders: identifiers, channel and state of the detail, else of the summary; amounts of the detail.

    Both tables have erp_id (unique), number, ecommerce_id, channel_id, channel, status_code; summaries
    created_at, details total. A summary without its detail raises an error.
    """
    shared = ["number", "ecommerce_id", "channel_id", "channel", "status_code"]
    own = details.select("erp_id", "total", F.lit(True).alias("_found"), *(F.col(c).alias(f"_{c}") for c in shared))
    rows = summaries.where(on_local_day("created_at", day, zone)).join(own, "erp_id", "left")
    rows = rows.where(F.when(F.col("_found").isNull(), F.raise_error(F.lit("an order has no detail")).cast("boolean")).otherwise(True))
    return rows.select("erp_id", "created_at", *(F.coalesce(f"_{c}", c).alias(c) for c in shared), "total")


def with_shipments(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Orders with the number of their landed shipments and their distinct kinds in order; none for an order not found."""
    by = shipments.groupBy("order_id").agg(F.count("*").alias("shipments"), F.array_sort(F.collect_set("logistic_type")).alias("kinds"))
    none = F.array().cast("array<string>")
    return orders.join(by, "order_id", "left").withColumn("shipments", F.coalesce("shipments", F.lit(0))).withColumn("kinds", F.coalesce("kinds", none))
