"""Listings without recent sales, judged only where the order history reaches far enough back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EFFECTIVE, business_days, money, operational_status
from .ranking import ranked


def history_coverage(orders: DataFrame) -> DataFrame:
    """First and last instant that each account's history covers."""
    return orders.groupBy("account_code").agg(F.min("sold_at").alias("history_from"), F.max("sold_at").alias("history_through"))


def watermark(coverage: DataFrame, accounts: int) -> DataFrame:
    """The instant up to which every account is covered; null while one is missing."""
    return coverage.agg(F.when(F.count("history_through") == accounts, F.min("history_through")).alias("data_through"))


def within_history(sales: DataFrame, coverage: DataFrame) -> DataFrame:
    """Sales inside their account's bounds; the coverage has one row per account.

    It is broadcast: dealt by account, all sales would meet in as many tasks as there are accounts.
    """
    bounds = F.broadcast(coverage.withColumnRenamed("account_code", "covered"))
    inside = (F.col("account_code") == F.col("covered")) & F.col("sold_at").between(F.col("history_from"), F.col("history_through"))
    return sales.join(bounds, inside).drop("covered")


def evaluate(sales: DataFrame, coverage: DataFrame, created: Column) -> DataFrame:
    """Per account and listing: first seen (any status), last effective sale, and effective sales of the last 30 days."""
    rows = within_history(sales, coverage)
    done = F.col("status").isin(EFFECTIVE)
    late = done & (F.col("sold_at") > F.col("history_through") - F.expr("INTERVAL 30 DAYS"))
    facts = rows.groupBy("account_code", "listing_id").agg(
        F.min("sold_at").alias("first_order"), F.max(F.when(done, F.col("sold_at"))).alias("last_sale"), F.countDistinct(F.when(late, F.col("order_id"))).alias("orders_30"),
        F.coalesce(F.sum(F.when(late, F.col("quantity"))), F.lit(0)).cast("long").alias("units_30"), money(F.coalesce(F.sum(F.when(late, F.col("revenue"))), F.lit(0))).alias("gross_30"),
        F.first("history_from").alias("history_from"), F.first("history_through").alias("history_through"),
    )
    seen = facts.withColumn("first_seen", F.least("first_order", created))
    since = F.when(F.col("last_sale").isNotNull(), business_days("last_sale", "history_through"))
    return seen.select(
        "account_code", "listing_id", "first_seen", "last_sale", "orders_30", "units_30", "gross_30", since.cast("long").alias("days_since"),
        business_days("first_seen", "history_through").cast("long").alias("observed_days"), business_days("history_from", "history_through").cast("long").alias("history_days"),
    )


def qualifies(days: int) -> Column:
    """Seen and covered for at least ``days``, and not sold for as long."""
    return (F.col("observed_days") >= days) & (F.col("history_days") >= days) & (F.col("days_since").isNull() | (F.col("days_since") >= days))


def no_sale(evaluated: DataFrame, listings: DataFrame, days: int = 30, account: str | None = None, status: str = "ALL", search: str | None = None) -> DataFrame:
    """Listings without an effective sale for ``days``, longest first in ``position`` order columns."""
    rows = evaluated.join(listings.select("listing_id", "title", "listing_status"), "listing_id").where(qualifies(days))
    if account is not None:
        rows = rows.where(F.col("account_code") == account)
    kind = F.col("listing_status")
    if status == "INACTIVE":
        rows = rows.where(kind.isNull() | ~kind.isin("active", "paused"))
    elif status != "ALL":
        rows = rows.where(kind == status.lower())
    if search is not None and search.strip():
        pattern = f"%{search.strip()}%"
        rows = rows.where(F.col("title").ilike(pattern) | F.col("listing_id").cast("string").ilike(pattern))
    return rows.select("account_code", "listing_id", "title", "listing_status", "last_sale", "days_since", "observed_days", operational_status("days_since").alias("operational_status"), F.coalesce("days_since", "observed_days").alias("sort_days"))


def threshold_counts(evaluated: DataFrame, thresholds: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """How many listings pass each cumulative threshold, by account."""
    return evaluated.groupBy("account_code").agg(F.count("*").alias("listings"), *(F.count(F.when(qualifies(d), 1)).alias(f"no_sale_{d}") for d in thresholds))


# Falls between classes in the order in which they are shown.
FALLS = ["A_TO_C", "A_TO_B", "B_TO_C"]


def attention_center(compared: DataFrame, rows: DataFrame) -> DataFrame:
    """What needs attention, as ordered lists: section, position, account_code, listing_id, transition, revenue_delta, days.

    CURVE_DROP: listings of a compared curve that fell, by kind of fall, then by revenue lost. REVENUE_DROP:
    listings whose revenue fell, the largest fall first. NO_SALE_90, _60 and _30: listings of
    ``no_sale`` by days without a sale, longest first. Equal ones go by account and id; a difference
    that is not known counts as none.
    """
    lost = F.coalesce("revenue_delta", F.lit(0)).cast("decimal(38,2)")
    kind = F.array_position(F.array(*map(F.lit, FALLS)), F.col("transition"))
    none = F.lit(None)
    own = [none.cast("string").alias("account_code"), "listing_id", "transition", "revenue_delta", none.cast("long").alias("days")]
    falls = compared.where("movement = 'DECLINED'").select(F.lit("CURVE_DROP").alias("section"), F.when(kind > 0, kind).otherwise(len(FALLS) + 1).alias("_first"), lost.alias("_second"), *own)
    drops = compared.where("revenue_movement = 'DECLINED'").select(F.lit("REVENUE_DROP").alias("section"), F.lit(0).alias("_first"), lost.alias("_second"), *own)
    d = F.col("sort_days")
    section = F.when(d >= 90, "NO_SALE_90").when(d >= 60, "NO_SALE_60").when(d >= 30, "NO_SALE_30")
    still = rows.where(d >= 30).select(section.alias("section"), (-d).alias("_first"), F.lit(0).cast("decimal(38,2)").alias("_second"), "account_code", "listing_id", none.cast("string").alias("transition"), none.cast("decimal(38,2)").alias("revenue_delta"), d.cast("long").alias("days"))
    whole = falls.unionByName(drops).unionByName(still)
    order = [F.asc(c) for c in ("_first", "_second", "account_code", "listing_id")]
    return ranked(whole, *order, within=("section",), name="position").drop("_first", "_second")


def attention(rows: DataFrame) -> DataFrame:
    """Buckets 30-59, 60-89 and 90+ days."""
    d = F.col("sort_days")
    return rows.groupBy("account_code", F.when(d >= 90, "90+").when(d >= 60, "60-89").otherwise("30-59").alias("bucket")).agg(F.count("*").alias("listings"))
