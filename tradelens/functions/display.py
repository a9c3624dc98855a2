"""Text for people: Brazilian numbers, escaped table cells, currency of data, and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import col


def number_ptbr(x, digits: int = 2) -> Column:
    """1234.5 as ``1.234,50``; null stays null."""
    return F.translate(F.format_number(col(x), digits), ",.", ".,")


def currency_ptbr(x) -> Column:
    """``R$ 1.234,50``, with the sign before the symbol."""
    x = col(x)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit("R$ "), number_ptbr(F.abs(x)))


def signed_percent_ptbr(x, digits: int = 2) -> Column:
    """``+12,30%``; zero has no sign."""
    x = col(x)
    return F.concat(F.when(x > 0, "+").otherwise(""), number_ptbr(x, digits), F.lit("%"))


def cell(x) -> Column:
    """Text for a table cell: bars escaped, line ends as blanks, a dash for null."""
    return F.coalesce(F.regexp_replace(F.replace(col(x).cast("string"), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "), F.lit("-"))


def table_line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_lines(rows: DataFrame, order: str, columns: dict[str, Column]) -> DataFrame:
    """line_number and line of a table: header, rule, then one line per row in ``order`` (unique whole numbers from 1)."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(-1, f"| {' | '.join(columns)} |"), (0, f"|{' --- |' * len(columns)}")], "line_number long, line string")
    return head.unionByName(rows.select(F.col(order).cast("long").alias("line_number"), table_line(*columns.values()).alias("line")))


def stale_banner(through, now) -> Column:
    """Whole days since the data end, as a sentence; null within one day, a fixed sentence without data."""
    days = F.datediff(col(now), col(through))
    return F.when(col(through).isNull(), "no data").when(days > 1, F.format_string("data end %d days ago", days))
