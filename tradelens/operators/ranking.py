"""Positions and running totals over a whole report without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settle


def by_locale(column: str, locale: str = "pt") -> Column:
    """Ascending in the order of a language: case and accents decide only between otherwise equal texts."""
    return F.collate(column, locale).asc()


def ranked(rows: DataFrame, *order: Column, within: tuple[str, ...] = (), value: str | None = None, name: str = "rank") -> DataFrame:
    """``rows`` with their place in ``order``, counted in each group of ``within``; with ``value`` (>= 0) also ``before`` and ``total``.

    ``order`` must leave no ties. Rows are dealt to ranges of (group, order), so equal values are
    cut by the ties too; totals of each range and group give every range its start. Those totals
    are as many as there are ranges and groups: ``within`` is for groups whose number is fixed by
    their meaning, such as accounts or periods. ``before`` is the sum of ``value`` of the rows ahead.
    """
    groups = [F.col(c) for c in within]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(rows.repartitionByRange(parts, *groups, *order).withColumn("_range", F.spark_partition_id()))
    v = F.col(value) if value else F.lit(0)
    sums = dealt.groupBy(*groups, "_range").agg(F.count("*").alias("_rows"), F.sum(v).alias("_sum"))
    group = Window.partitionBy(*groups)
    ahead = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = [F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}_before") for c in ("_rows", "_sum")]
    starts = sums.select(*(F.col(c).alias(f"_at_{c}") for c in within), F.col("_range").alias("_at_range"), *starts, F.sum("_sum").over(group).alias("_total"))
    same = F.col("_range") == F.col("_at_range")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    own = Window.partitionBy(*groups, "_range").orderBy(*order)
    out = dealt.withColumn("_place", F.row_number().over(own))
    columns = [*(F.col(c) for c in rows.columns), (F.col("__rows_before") + F.col("_place")).cast("long").alias(name)]
    if value:
        out = out.withColumn("_inside", F.coalesce(F.sum(v).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        columns += [(F.col("__sum_before") + F.col("_inside")).alias("before"), F.col("_total").alias("total")]
    return out.join(F.broadcast(starts), same).select(*columns)
