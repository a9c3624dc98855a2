"""Financial records: totals, breakdowns, day digests, inspection and the backfill plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The money columns of a financial record, in workbook order.
MONEY = ["product_sold", "discount", "total_products", "customer_shipping", "total_sale", "product_cost", "fees", "tax", "net", "margin"]


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)").alias(c) for c in MONEY]


def _rate() -> Column:
    base = F.nullif(F.col("total_products").cast("decimal(20,4)"), F.lit(0))
    return F.round(F.col("margin").cast("decimal(20,4)") / base, 10).cast("double").alias("margin_rate")


def totals(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Record count, sums of the ten money columns and the ratio of summed margin to summed products (null on 0)."""
    out = records.groupBy(*(keys or [])).agg(F.count("*").alias("records"), *_sums())
    return out.withColumn("margin_rate", _rate())


def breakdown(records: DataFrame) -> DataFrame:
    """The same by channel and by status in one pass: dimension, value and the totals."""
    out = records.groupingSets([["channel"], ["status"]], "channel", "status").agg(F.grouping("channel").alias("by_status"), F.count("*").alias("records"), *_sums())
    which = F.col("by_status") == 1
    named = out.withColumn("dimension", F.when(which, "status").otherwise("channel")).withColumn("value", F.when(which, F.col("status")).otherwise(F.col("channel")))
    return named.withColumn("margin_rate", _rate()).select("dimension", "value", "records", *MONEY, "margin_rate")


def canonical_decimal(x) -> Column:
    """Plain decimal text without trailing zeros."""
    text = F.col(x).cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def day_digests(records: DataFrame, version: str = "daily-aggregates") -> DataFrame:
    """sold_on, sha256 of the day's sums by channel code, independent of the order of rows.

    Channel codes come from a fixed table, so the list of a day is short.
    """
    sums = records.groupBy("sold_on", "channel_code").agg(*(F.sum(c).cast("decimal(38,2)").alias(c) for c in ("total_products", "margin")))
    day = F.date_format("sold_on", "yyyy-MM-dd")
    row = F.concat(F.lit('["'), day, F.lit('","'), "channel_code", F.lit('","'), canonical_decimal("total_products"), F.lit('","'), canonical_decimal("margin"), F.lit('"]'))
    rows = sums.select("sold_on", F.struct("channel_code", row.alias("row")).alias("entry")).groupBy("sold_on").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    return rows.select("sold_on", F.sha2(F.concat(F.lit(f'["{version}",['), F.array_join("entries.row", ","), F.lit("]]")), 256).alias("sha256"))


def inspect(records: DataFrame) -> DataFrame:
    """Records per day, with the number of channels of the day."""
    by = records.groupBy("sold_on", "channel").agg(F.count("*").alias("n"))
    return by.groupBy("sold_on").agg(F.sum("n").alias("records"), F.count("*").alias("channels"))


def backfill_plan(days: DataFrame, snapshots: DataFrame, today: Column, include_today: bool = False) -> DataFrame:
    """sold_on, action for each report day.

    ``snapshots`` has sold_on and daily_sha256; a snapshot without a digest blocks the plan
    (BLOCKED_LEGACY) unless its day is ignored.
    """
    old = snapshots.select("sold_on", "daily_sha256", F.lit(True).alias("exists"))
    late = F.lit(False) if include_today else F.col("sold_on") >= today
    action = (
        F.when(late, "CURRENT_DAY_IGNORED")
        .when(F.col("exists").isNull(), "FULL_EXTERNAL_PROCESS")
        .when(F.col("daily_sha256").isNull(), "BLOCKED_LEGACY")
        .when(F.col("daily_sha256") == F.col("sha256"), "SKIPPED")
        .otherwise("LOCAL_REFRESH")
    )
    return days.join(old, "sold_on", "left").select("sold_on", action.alias("action"))


def account_of_channels(records: DataFrame) -> DataFrame:
    """The one trailing account number of all channel names; an error when there is none or more than one."""
    number = F.regexp_extract("channel", r"(\d+)\s*$", 1)
    found = records.select(F.nullif(number, F.lit("")).alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    good = F.col("low") == F.col("high")
    return found.select(F.when(good, F.col("low").cast("int")).otherwise(F.raise_error(F.lit("the channels name no single account")).cast("int")).alias("ordinal"))


def backfill(plan: DataFrame, snapshots: DataFrame, report: DataFrame, external: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots, days): a plan carried out on stored snapshots, each day on its own.

    ``plan``: sold_on, action. ``snapshots`` and ``report``: sold_on, daily_sha256, margin, products
    and, of snapshots, visits. ``external``: sold_on, visits, for days whose sources answered. A local
    refresh takes the report's values and keeps the rest; an external day takes both, and fails
    when a source gave nothing. Days skipped, ignored, blocked or failed leave their snapshot alone.
    """
    ends = [report.select("sold_on", *(F.col(c).alias(f"new_{c}") for c in ("daily_sha256", "margin", "products"))), external.select("sold_on", F.col("visits").alias("new_visits"), F.lit(True).alias("answered"))]
    old = snapshots.select("*", F.lit(True).alias("stored"))
    rows = plan.join(old, "sold_on", "full_outer").join(ends[0], "sold_on", "left").join(ends[1], "sold_on", "left")
    local, outside = F.col("action") == "LOCAL_REFRESH", F.col("action") == "FULL_EXTERNAL_PROCESS"
    fails = (local & F.col("stored").isNull()) | (outside & F.col("answered").isNull()) | ((local | outside) & F.col("new_daily_sha256").isNull())
    works = F.coalesce((local | outside) & ~fails, F.lit(False))
    done = F.when(fails, "FAILED").when(works, F.when(F.col("stored"), "UPDATED").otherwise("CREATED")).otherwise(F.when(F.col("action") == "BLOCKED_LEGACY", "BLOCKED").otherwise(F.when(local | outside, "FAILED").otherwise("SKIPPED")))
    values = [F.when(works, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("daily_sha256", "margin", "products")]
    visits = F.when(works & outside, F.col("new_visits")).otherwise(F.col("visits")).alias("visits")
    kept = rows.where(works | F.col("stored")).select("sold_on", *values, visits)
    return kept, rows.where("action is not null").select("sold_on", "action", done.alias("outcome"))
