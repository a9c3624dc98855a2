"""ABC (Pareto) curves of listings, their movement against a shifted window, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import class_movement, class_of, delta_percent, local_midnight, money, percentage, revenue_movement
from .ranking import ranked


def curve_totals(rows: DataFrame, value: str, *ties: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``rank``, ``before`` (running total of the rows ahead) and ``total`` in descending order of a value >= 0, in each group of ``within``."""
    return ranked(rows, F.desc(value), *(F.asc(c) for c in ties), within=within, value=value)


def listing_sales(sales: DataFrame, *more: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """Per listing (and group of ``within``): distinct orders, units, revenue (price x quantity, every status), accounts, first title by account."""
    titled = F.when(F.col("title").isNotNull(), F.col("account_code"))
    return sales.groupBy(*within, "listing_id").agg(
        F.countDistinct("order_id").alias("sales_count"), F.sum("quantity").alias("units"), F.sum("revenue").cast("decimal(38,2)").alias("revenue"),
        F.array_join(F.array_sort(F.collect_set("account_code")), ",").alias("accounts"), F.min_by("title", titled).alias("title"), *more,
    )


def in_window(sales: DataFrame, start, end) -> DataFrame:
    """Half-open window on the sale's instant."""
    return sales.where((F.col("sold_at") >= start) & (F.col("sold_at") < end))


def window_bounds(today: str, days: int, shift: int = 0, zone: str | None = None) -> tuple[Column, Column]:
    """[local midnight of today + 1 - days, local midnight of tomorrow), moved back by ``shift`` civil days."""
    extra = {} if zone is None else {"zone": zone}
    day = F.to_date(F.lit(today))
    return local_midnight(F.date_sub(day, days - 1 + shift), **extra), local_midnight(F.date_add(day, 1 - shift), **extra)


def in_periods(sales: DataFrame, periods: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Each sale once for every half-open window it lies in, named by ``period``: overlapping windows need one scan."""
    t = F.col("sold_at")
    names = F.filter(F.array(*(F.when((t >= start) & (t < end), F.lit(name)) for name, (start, end) in periods.items())), lambda x: x.isNotNull())
    return sales.withColumn("period", F.explode(names))


def listing_curve(per_listing: DataFrame, metric: str = "units", within: tuple[str, ...] = ()) -> DataFrame:
    """Rank, class, share and running share of each listing by one metric (ties by listing id), in each group of ``within``."""
    out = curve_totals(per_listing, metric, "listing_id", within=within)
    return out.select(
        *per_listing.columns, "rank", class_of("before", "total").alias("abc_class"),
        percentage(metric, "total").alias("share"), percentage(F.col("before") + F.col(metric), "total").alias("cumulative_share"),
    )


def compare_curves(now: DataFrame, before: DataFrame) -> DataFrame:
    """Current listings with their class, rank and revenue in the earlier window; listings that only the earlier has are dropped."""
    old = before.select("listing_id", F.col("abc_class").alias("previous_class"), F.col("rank").alias("previous_rank"), F.col("units").alias("previous_units"), F.col("revenue").alias("previous_revenue"))
    delta = F.col("revenue") - F.col("previous_revenue")
    return now.join(old, "listing_id", "left").select(
        *now.columns, "previous_class", "previous_rank", "previous_units", "previous_revenue", class_movement("abc_class", "previous_class").alias("movement"),
        F.when(F.col("previous_class").isNotNull(), F.concat("previous_class", F.lit("_TO_"), "abc_class")).alias("transition"), (F.col("previous_rank") - F.col("rank")).alias("rank_delta"),
        (F.col("units") - F.col("previous_units")).alias("units_delta"), money(delta).alias("revenue_delta"), delta_percent("revenue", "previous_revenue").alias("revenue_delta_percent"), revenue_movement(delta).alias("revenue_movement"),
    )


def movement_summary(compared: DataFrame) -> DataFrame:
    """Counts by movement, and revenue lost and gained by listings that have an earlier window."""
    kinds = [F.count(F.when(F.col("movement") == k, 1)).alias(k.lower()) for k in ("IMPROVED", "DECLINED", "STABLE", "NEW")]
    d = F.col("revenue_delta")
    moves = [F.count(F.when(F.col("transition") == t, 1)).alias(t.lower()) for t in ("A_TO_B", "A_TO_C", "B_TO_C")]
    return compared.agg(*kinds, *moves, money(F.coalesce(F.sum(F.when(d < 0, -d)), F.lit(0))).alias("revenue_lost"), money(F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0))).alias("revenue_gained"))


def class_totals(curve: DataFrame, share: str = "share", **more: Column) -> DataFrame:
    """Always three rows: members, summed share and ``more`` sums (whole numbers) of each class."""
    classes = curve.sparkSession.createDataFrame([("A",), ("B",), ("C",)], "abc_class string")
    sums = curve.groupBy("abc_class").agg(F.count("*").alias("members"), F.round(F.sum(share), 4).alias("share"), *(F.sum(c).alias(k) for k, c in more.items()))
    zero = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in more]
    return classes.join(sums, "abc_class", "left").select("abc_class", F.coalesce("members", F.lit(0)).alias("members"), *zero, F.coalesce("share", F.lit(0.0)).alias("share"))


def window_edges(sales: DataFrame, days: int, today: str) -> DataFrame:
    """Per listing: units and revenue of the window, of the window a day earlier, and of the days that entered and left."""
    (start, end), (old_start, old_end) = window_bounds(today, days), window_bounds(today, days, 1)
    t = F.col("sold_at")
    pieces = {"now": (t >= start) & (t < end), "previous": (t >= old_start) & (t < old_end), "entering": (t >= old_end) & (t < end), "leaving": (t >= old_start) & (t < start)}
    sums = []
    for name, inside in pieces.items():
        sums += [F.coalesce(F.sum(F.when(inside, F.col("quantity"))), F.lit(0)).cast("long").alias(f"units_{name}"), money(F.coalesce(F.sum(F.when(inside, F.col("revenue"))), F.lit(0))).alias(f"revenue_{name}")]
    return in_window(sales, old_start, end).groupBy("listing_id").agg(*sums)
