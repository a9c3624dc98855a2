"""Scalar rules of the seller domain as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Business time zone unless a caller gives another.
ZONE = "America/Sao_Paulo"
# Order states in their declared order, and what counts as a sale where.
STATUSES = ["PENDING", "PAID", "PROCESSING", "SHIPPED", "DELIVERED", "CANCELLED", "PARTIALLY_REFUNDED", "REFUNDED", "UNKNOWN"]
EFFECTIVE = ["PAID", "PROCESSING", "SHIPPED", "DELIVERED", "PARTIALLY_REFUNDED"]
VOID = ["CANCELLED", "REFUNDED"]


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def exact(x) -> Column:
    """Operand of an exact division: wide enough that quotients keep 18 decimals."""
    return col(x).cast("decimal(20,4)")


def percentage(value, total, digits: int = 6) -> Column:
    """value / total * 100, half up, 0 for a zero total (decimal arithmetic, double result)."""
    return F.when(col(total) == 0, F.lit(0.0)).otherwise(F.round(exact(value) * 100 / F.nullif(exact(total), F.lit(0)), digits).cast("double"))


def ratio_percent(value, total) -> Column:
    """The double quotient times 100, 0 for a zero total."""
    return F.coalesce(F.try_divide(col(value).cast("double"), col(total).cast("double")) * 100, F.lit(0.0))


def delta_percent(now, before, digits: int = 6) -> Column:
    """Change in percent of ``before``; null when that is null or zero."""
    return F.round((exact(now) - exact(before)) * 100 / F.nullif(exact(before), F.lit(0)), digits).cast("double")


def money(x) -> Column:
    return F.round(col(x), 2).cast("decimal(38,2)")


def class_of(before, total) -> Column:
    """ABC class from the running total before a row: A under 80 %, B under 95 %, else C; A for an empty total."""
    before, total = col(before), col(total)
    return F.when((total == 0) | (before * 100 < total * 80), "A").when(before * 100 < total * 95, "B").otherwise("C")


def class_movement(now, before) -> Column:
    now, before = col(now), col(before)
    return F.when(before.isNull(), "NEW").when(now < before, "IMPROVED").when(now > before, "DECLINED").otherwise("STABLE")


def revenue_movement(delta) -> Column:
    delta = col(delta)
    return F.when(delta.isNull(), "NEW").when(delta > 0, "IMPROVED").when(delta < 0, "DECLINED").otherwise("STABLE")


def local_midnight(day, zone: str = ZONE) -> Column:
    """Instant (UTC) at which a civil day starts in the zone."""
    return F.to_utc_timestamp(col(day).cast("timestamp"), zone)


def local_day(instant, zone: str = ZONE) -> Column:
    """Civil day of an instant in the zone."""
    return F.to_date(F.from_utc_timestamp(col(instant), zone))


def business_days(earlier, later, zone: str = ZONE) -> Column:
    """Civil days between two instants, never negative."""
    return F.greatest(F.lit(0), F.datediff(local_day(later, zone), local_day(earlier, zone)))


def operational_status(days) -> Column:
    days = col(days)
    return F.when(days.isNull(), "IN_AVAILABLE_HISTORY").when(days >= 90, "90D").when(days >= 60, "60D").otherwise("30D")


def parse_day(text) -> Column:
    """Strict YYYY-MM-DD, else null."""
    text = col(text)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def parse_sale_day(text) -> Column:
    """Strict DD/MM/YYYY, else null."""
    text = col(text)
    return F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(text, "dd/MM/yyyy"))


def parse_brl(text) -> Column:
    """``R$ 1.234,56`` to a decimal; parentheses or a minus sign make it negative; null when unreadable."""
    plain = F.regexp_replace(col(text), r"[R$\s()\-]", "")
    number = F.when(plain.contains(","), F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(plain)
    value = number.try_cast("decimal(20,4)")
    negative = col(text).rlike(r"^\s*(\(|-|R\$\s*-)")
    return F.when(negative, -value).otherwise(value).cast("decimal(20,4)")


def parse_rate(text) -> Column:
    """``12,3%`` to 0.123; plain numbers stay."""
    number = F.replace(F.regexp_replace(col(text), r"[%\s]", ""), F.lit(","), F.lit(".")).try_cast("decimal(20,10)")
    return F.when(col(text).contains("%"), F.round(number / 100, 10)).otherwise(number).cast("decimal(20,10)")


# What is taken out of free text, in this order: e-mail addresses, personal and company tax ids, phone numbers.
SENSITIVE = [
    r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}",
    r"\b\d{3}[.\s-]?\d{3}[.\s-]?\d{3}[-\s]?\d{2}\b",
    r"\b\d{2}[.\s-]?\d{3}[.\s-]?\d{3}[/]?\d{4}[-\s]?\d{2}\b",
    r"\b(?:\+?55\s*)?(?:\(?\d{2}\)?\s*)?9?\d{4}[-\s]?\d{4}\b",
]


def redact(text) -> Column:
    """E-mail addresses, tax ids and phone numbers (with or without country and area code, groups parted by dots, blanks or dashes) become ``[REDACTED]``."""
    out = col(text)
    for pattern in SENSITIVE:
        out = F.regexp_replace(out, pattern, "[REDACTED]")
    return out


def identity_key(*parts) -> Column:
    """Parts joined by ``|``, nulls as empty."""
    return F.concat_ws("|", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts))


def map_values(value, table: dict[str, str], default: str) -> Column:
    """Lookup in a small fixed table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.lower(col(value))], F.lit(default))


def current(rows: DataFrame) -> DataFrame:
    """Rows of a validity table that have not ended."""
    return rows.where(F.col("valid_to").isNull())


def primary_title(names) -> Column:
    """First of the distinct trimmed names, with the number of the others; null without a name."""
    trimmed = F.array_distinct(F.filter(F.transform(col(names), lambda n: F.trim(n)), lambda n: n != ""))
    more = F.size(trimmed) - 1
    first = F.get(trimmed, F.lit(0))
    return F.when(more > 0, F.concat(first, F.lit(" (+"), more.cast("string"), F.lit(" componentes)"))).otherwise(first)


def is_stale(generated, now, limit: str = "INTERVAL 10 MINUTES") -> Column:
    """Older than the limit; a missing or unreadable instant is stale too."""
    made = col(generated).try_cast("timestamp")
    return F.coalesce(made < col(now) - F.expr(limit), F.lit(True))
