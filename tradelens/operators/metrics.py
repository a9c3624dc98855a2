"""Daily seller metrics: summaries, snapshots, reconciliation of sources, comparison of accounts and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import STATUSES, VOID, col, local_day, money


def daily_summary(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Per account and civil day: orders, units, cancelled and other gross, average ticket of the others.

    Orders and items are summed apart and then joined, so that an order's amount counts once.
    """
    day = local_day("sold_at").alias("day")
    void = F.col("status").isin(VOID)
    rows = orders.select("order_id", "account_code", "gross_amount", "status", day)
    own = rows.groupBy("account_code", "day").agg(
        F.count("*").alias("orders"), F.count(F.when(~void, 1)).alias("kept_orders"), money(F.coalesce(F.sum(F.when(void, F.col("gross_amount"))), F.lit(0))).alias("cancelled_gross"),
        money(F.coalesce(F.sum(F.when(~void, F.col("gross_amount"))), F.lit(0))).alias("kept_gross"),
    )
    units = items.join(rows.select("order_id", "account_code", "day"), "order_id").groupBy("account_code", "day").agg(F.sum("quantity").alias("units"))
    ticket = F.when(F.col("kept_orders") == 0, F.lit(0)).otherwise(F.col("kept_gross").cast("decimal(20,4)") / F.col("kept_orders").cast("decimal(20,0)"))
    return own.join(units, ["account_code", "day"], "left").select("account_code", "day", "orders", F.coalesce("units", F.lit(0)).alias("units"), "kept_orders", "cancelled_gross", "kept_gross", money(ticket).alias("average_ticket"))


def single_currency(orders: DataFrame) -> DataFrame:
    """The one currency of the orders; more than one is an error."""
    found = orders.agg(F.countDistinct("currency").alias("n"), F.max("currency").alias("currency"))
    return found.select(F.when(F.col("n") > 1, F.raise_error(F.lit("orders mix currencies")).cast("string")).otherwise(F.col("currency")).alias("currency"))


def status_breakdown(orders: DataFrame) -> DataFrame:
    """Orders and gross by status with the status's place in its declared order."""
    place = F.array_position(F.array(*(F.lit(s) for s in STATUSES)), F.col("status"))
    return orders.groupBy("status").agg(F.count("*").alias("orders"), money(F.sum("gross_amount")).alias("gross")).withColumn("place", place)


def ticket(gross, count) -> Column:
    """Gross by sale with two decimals; null without sales."""
    return F.round(F.try_divide(col(gross).cast("decimal(20,4)"), col(count).cast("decimal(20,0)")), 2).cast("decimal(38,2)")


def conversion(count, visits) -> Column:
    """Sales in percent of visits, ten decimals; null without visits."""
    return F.round(F.try_divide((col(count) * 100).cast("decimal(20,0)"), col(visits).cast("decimal(14,0)")), 10).cast("double")


NAMES = ["visits", "sales_count", "gross", "ticket"]


def snapshot(daily: DataFrame) -> DataFrame:
    """One row for each account, day and metric; an unknown value is null."""
    wide = daily.withColumn("ticket", ticket("gross", "sales_count"))
    return wide.select("account_code", "day", *(F.col(c).cast("decimal(30,10)").alias(c) for c in NAMES)).unpivot(["account_code", "day"], NAMES, "name", "value")


# The metrics of a stored day.
DAY_METRICS = ["salesCount", "unitsSold", "grossSales", "marginRate", "fullSalesCount", "fullUnitsSold", "fullGrossSales", "visits", "averageTicket", "conversionRate"]


def day_snapshot(orders: DataFrame, items: DataFrame, flags: DataFrame, margins: DataFrame, visits: DataFrame) -> DataFrame:
    """account_code, day, name, value, status: the ten metrics of every day with orders; one that is not known is null and UNAVAILABLE.

    ``flags``: order_id, is_full; while one of a day's orders has an unknown flag, so are its three
    fulfilment metrics. ``margins``: order_id, margin; an order without one leaves the day's rate
    unknown. ``visits``: account_code, day, visits. Void orders are no sales.
    """
    day = local_day("sold_at")
    own = orders.withColumn("day", day).select("order_id", "account_code", "day", "status", "gross_amount")
    lines = items.groupBy("order_id").agg(F.sum("quantity").alias("units"))
    rows = own.join(lines, "order_id", "left").join(flags, "order_id", "left").join(margins, "order_id", "left")
    kept = ~F.col("status").isin(VOID)
    full, known = F.coalesce("is_full", F.lit(False)) & kept, F.count_if(F.col("is_full").isNull()) == 0
    total = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
    sums = rows.groupBy("account_code", "day").agg(
        F.count_if(kept).alias("salesCount"), F.coalesce(F.sum("units"), F.lit(0)).alias("unitsSold"), money(total(kept, "gross_amount")).alias("grossSales"),
        F.when(F.count("margin") == F.count("*"), F.sum("margin")).cast("decimal(16,4)").alias("_margin"), F.sum("gross_amount").cast("decimal(16,4)").alias("_base"),
        F.when(known, F.count_if(full)).alias("fullSalesCount"), F.when(known, total(full, "units")).alias("fullUnitsSold"), F.when(known, money(total(full, "gross_amount"))).alias("fullGrossSales"),
    )
    sums = sums.join(visits.select("account_code", "day", "visits"), ["account_code", "day"], "left").withColumns({
        "marginRate": F.round(F.try_divide((F.col("_margin") * 100).cast("decimal(18,4)"), F.col("_base")), 10), "averageTicket": ticket("grossSales", "salesCount"),
        "conversionRate": F.round(F.try_divide((F.col("salesCount") * 100).cast("decimal(20,0)"), F.col("visits").cast("decimal(14,0)")), 10),
    })
    long = sums.select("account_code", "day", *(F.col(c).cast("decimal(30,10)").alias(c) for c in DAY_METRICS)).unpivot(["account_code", "day"], DAY_METRICS, "name", "value")
    return long.withColumn("status", F.when(F.col("value").isNull(), "UNAVAILABLE").otherwise("AVAILABLE"))


def pivoted(long: DataFrame) -> DataFrame:
    """Snapshots with one column for each metric; a snapshot without one of them is an error."""
    wide = long.groupBy("account_code", "day").pivot("name", NAMES).agg(F.first("value"))
    n = long.groupBy("account_code", "day").agg(F.count("*").alias("n"))
    rows = wide.join(n, ["account_code", "day"])
    return rows.where(F.when(F.col("n") < len(NAMES), F.raise_error(F.lit("a snapshot lacks a metric")).cast("boolean")).otherwise(True)).drop("n")


def overlay(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Upsert on keys: new values replace old ones, rows of either side stay."""
    fresh = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_given"))
    return old.join(fresh, keys, "full_outer").select(*keys, F.when(F.col("_given"), F.col("_new")).otherwise(F.col(value)).alias(value))


def fill_missing(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values that are null take the new one; ``outcome`` says FILLED, KEPT or MISSING."""
    rows = old.join(new.select(*keys, F.col(value).alias("_new")), keys, "left")
    outcome = F.when(F.col(value).isNotNull(), "KEPT").when(F.col("_new").isNotNull(), "FILLED").otherwise("MISSING")
    return rows.select(*keys, F.coalesce(value, "_new").alias(value), outcome.alias("outcome"))


def densified(daily: DataFrame, first: str, last: str) -> DataFrame:
    """Every account on every day of the range; ``state`` is AVAILABLE or MISSING_SNAPSHOT."""
    spark = daily.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    grid = daily.select("account_code").distinct().join(F.broadcast(days))  # one row a day of a range
    state = F.when(F.col("found"), "AVAILABLE").otherwise("MISSING_SNAPSHOT").alias("state")
    return grid.join(daily.withColumn("found", F.lit(True)), ["account_code", "day"], "left").select("account_code", "day", state, *(c for c in daily.columns if c not in ("account_code", "day")))


def period(dense: DataFrame) -> DataFrame:
    """Sums over a range by account: null when no day has a value; ticket from the sums; days missing."""
    rows = dense.groupBy("account_code").agg(
        F.sum("visits").alias("visits"), F.sum("sales_count").alias("sales_count"), money(F.sum("gross")).alias("gross"), F.count(F.when(F.col("state") != "AVAILABLE", 1)).alias("missing_days"),
    )
    return rows.withColumn("ticket", ticket("gross", "sales_count")).withColumn("partial", F.col("missing_days") > 0)


def peaks(daily: DataFrame, metric: str) -> DataFrame:
    """The day with the largest value of each account, the earliest of equals, and the average over days (null if one is null)."""
    best = F.max_by("day", F.struct(F.col(metric), -F.unix_date("day")))
    average = F.when(F.count(metric) == F.count("*"), F.round(F.avg(F.col(metric).cast("double")), 6))
    return daily.groupBy("account_code").agg(best.alias("peak_day"), F.max(metric).alias("peak_value"), average.alias("day_average"))


def temporal(now, before) -> list[Column]:
    """Difference, percentage and direction of a metric against an earlier value."""
    now, before = col(now), col(before)
    change = F.round(F.try_divide((now - before).cast("decimal(20,4)") * 100, before.cast("decimal(16,4)")), 6).cast("double")
    way = F.when(now.isNull() | before.isNull(), "UNKNOWN").when(now > before, "UP").when(now < before, "DOWN").otherwise("EQUAL")
    return [F.abs(now - before).alias("difference"), change.alias("variation"), way.alias("direction")]


def reconcile(evidence: DataFrame) -> DataFrame:
    """Each source's value against the reference of its metric: the preferred source, else the first that has one.

    ``evidence`` has account_code, day, metric, source, ordinal, preferred, value.
    """
    keys = ["account_code", "day", "metric"]
    order = Window.partitionBy(*keys).orderBy(F.desc("preferred"), "ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = evidence.withColumn("reference", F.first("value", ignorenulls=True).over(order))
    gap = F.abs(F.col("value") - F.col("reference"))
    state = F.when(F.col("value").isNull(), "UNAVAILABLE").when(gap == 0, "EXACT").otherwise("DIFFERENT")
    percent = F.round(F.try_divide(gap.cast("decimal(20,4)") * 100, F.abs("reference").cast("decimal(16,4)")), 4).cast("double")
    return rows.select(*keys, "source", "value", "reference", state.alias("state"), gap.alias("difference"), percent.alias("difference_percent"))


def resolve(evidence: DataFrame, policy: DataFrame) -> DataFrame:
    """The value of each metric's primary source; other sources never stand in for it."""
    keys = ["account_code", "day", "metric"]
    wanted = evidence.select(*keys).distinct().join(F.broadcast(policy), "metric")  # one row for each metric
    rows = wanted.join(evidence.select(*keys, F.col("source").alias("primary_source"), "value"), [*keys, "primary_source"], "left")
    return rows.select(*keys, "primary_source", "value", F.when(F.col("value").isNull(), "UNAVAILABLE").otherwise("RESOLVED").alias("state"))


def operations_report(orders: DataFrame, items: DataFrame, flags: DataFrame, visits: DataFrame, reference: DataFrame) -> DataFrame:
    """Per account: what its orders, shipments and visits add up to, beside the values noted by hand.

    Columns account_code, metric, calculated, reference, status. The two kinds of values mean
    different things, so no row has both and none a difference. ``flags``: order_id, is_full (null
    when a lookup failed, which leaves the account's fulfilment unknown); ``visits``: account_code,
    visits (null when the lookup failed); ``reference``: account_code, metric, value, for the metrics of ``NOTED``.
    """
    lines = items.groupBy("order_id").agg(F.sum("quantity").alias("units"))
    rows = orders.join(lines, "order_id", "left").join(flags, "order_id", "left")
    full, known = F.col("is_full"), F.count_if(F.col("is_full").isNull()) == 0
    number = lambda x: x.cast("decimal(38,2)")
    own = rows.groupBy("account_code").agg(
        number(F.sum("gross_amount")).alias("orders.gross_amount"), number(F.count("*")).alias("orders.count"), number(F.coalesce(F.sum("units"), F.lit(0))).alias("orders.units"),
        F.when(known, number(F.coalesce(F.sum(F.when(full, F.col("gross_amount"))), F.lit(0)))).alias("fulfillment.gross_amount"),
        F.when(known, number(F.count_if("is_full"))).alias("fulfillment.orders"), F.when(known, number(F.coalesce(F.sum(F.when(full, F.col("units"))), F.lit(0)))).alias("fulfillment.units"),
    )
    own = own.join(visits.select("account_code", number(F.col("visits")).alias("visits")), "account_code", "left")
    names = [c for c in own.columns if c != "account_code"]
    none = F.lit(None).cast("decimal(38,2)")
    found = own.unpivot(["account_code"], [F.col(f"`{c}`") for c in names], "metric", "calculated").select("account_code", "metric", "calculated", none.alias("reference"), F.lit("OPERATIONAL_DIAGNOSTIC").alias("status"))
    noted = own.select("account_code", F.explode(F.array(*(F.lit(m) for m in NOTED))).alias("metric")).join(reference, ["account_code", "metric"], "left")
    state = F.when(F.col("value").isNull(), "NO_REFERENCE").otherwise("SELLER_BI_REFERENCE")
    return found.unionByName(noted.select("account_code", F.concat(F.lit("noted."), "metric").alias("metric"), none.alias("calculated"), number(F.col("value")).alias("reference"), state.alias("status")))


#: Metrics that are noted by hand for a day.
NOTED = ["gross", "sales_count", "units", "full_gross", "full_units", "full_sales", "ticket", "margin_percent"]


def comparison_facts(periods: DataFrame, highest: tuple[str, ...], growth: str) -> DataFrame:
    """What stands out between accounts: fact, account_code, metric, value.

    ``periods``: account_code, metric, now, before. HIGHEST: the account with the larger value now
    (TIE for equals; none while a value is missing). GROWTH: the largest relative change of
    ``growth``, if it is a growth. DROP: the largest relative fall of any metric. Equal changes go
    to the first account, then to the first metric.
    """
    change, now = temporal("now", "before")[1], F.col("now")
    rows = periods.select("account_code", "metric", "now", (F.signum(now - F.col("before")) * F.abs(change)).alias("change"))
    top = rows.where(F.col("metric").isin(*highest)).groupBy("metric").agg(F.max("now").alias("high"), F.min("now").alias("low"), F.count("now").alias("known"), F.count("*").alias("n"), F.max_by("account_code", "now").alias("account_code"))
    top = top.where("known = n and n > 1").select(F.lit("HIGHEST").alias("fact"), F.when(F.col("high") == F.col("low"), "TIE").otherwise(F.col("account_code")).alias("account_code"), "metric", F.col("high").cast("double").alias("value"))
    first = lambda sign: F.min(F.struct((sign * F.col("change")).alias("order"), "account_code", "metric", "change")).alias("first")
    grown = rows.where((F.col("metric") == growth) & F.col("change").isNotNull()).agg(first(-1)).where("first.change > 0").withColumn("fact", F.lit("GROWTH"))
    fallen = rows.where("change < 0").agg(first(1)).where("first is not null").withColumn("fact", F.lit("DROP"))
    return top.unionByName(grown.unionByName(fallen).select("fact", "first.account_code", "first.metric", F.col("first.change").alias("value")))
