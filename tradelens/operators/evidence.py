"""Evidence lists of metrics: canonical text, cleaning, exact margin components and their backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col

# The two components from which a margin rate can be summed over days.
AMOUNT, BASE = "MARGIN_AMOUNT", "MARGIN_BASE_AMOUNT"
ENTRY = "struct<component: string, source: string, status: string, value: string>"
DECIMAL = "decimal(38,10)"


def canonical_json(text) -> Column:
    """JSON text with the keys of every object in order and no blanks; null for text that is no JSON."""
    return F.to_json(F.try_parse_json(col(text)))


def sanitized(text, allowed: dict[str, list[str]]) -> Column:
    """The objects of a JSON array with known fields only; other entries go, and text that is no array gives no entries.

    ``allowed`` names the text fields and their values: any other value becomes null. ``value`` and the
    two differences stay where they are decimals.
    """
    entries = F.coalesce(F.try_variant_get(F.try_parse_json(col(text)), "$", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(entries, lambda e: F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False)))

    def known(e, name):
        found = F.try_variant_get(e, f"$.{name}", "string")
        return F.when(found.isin(allowed[name]), found).alias(name)

    def decimal(e, name):
        return F.try_variant_get(e, f"$.{name}", "string").try_cast(DECIMAL).alias(name)

    numbers = ["value", "absolute_difference", "percentage_difference"]
    return F.transform(objects, lambda e: F.struct(*(known(e, n) for n in allowed), *(decimal(e, n) for n in numbers)))


def _component(evidence: Column, name: str, source: str) -> Column:
    """Values of the available entries of a component."""
    good = F.filter(evidence, lambda e: (e["component"] == name) & (e["source"] == source) & (e["status"] == "AVAILABLE") & e["value"].try_cast(DECIMAL).isNotNull())
    return F.transform(good, lambda e: e["value"].try_cast(DECIMAL))


def margin(snapshots: DataFrame, keys: list[str], source: str, evidence: str = "evidence") -> DataFrame:
    """Margin in percent from summed components, with its status; null where a day lacks exactly one of each.

    ``evidence`` is an array of ``ENTRY``.
    """
    parts = snapshots.select(*keys, _component(F.col(evidence), AMOUNT, source).alias("a"), _component(F.col(evidence), BASE, source).alias("b"))
    whole = F.coalesce((F.size("a") == 1) & (F.size("b") == 1), F.lit(False))
    sums = parts.groupBy(*keys).agg(F.bool_and(whole).alias("whole"), F.sum(F.get("a", F.lit(0))).alias("amount"), F.sum(F.get("b", F.lit(0))).alias("base"))
    status = F.when(~F.col("whole"), "UNAVAILABLE_COMPONENTS").when(F.col("base") == 0, "UNAVAILABLE_ZERO_BASE").otherwise("AVAILABLE")
    rate = F.round(F.try_divide(F.col("amount").cast("decimal(20,4)") * 100, F.col("base").cast("decimal(16,4)")), 10).cast("double")
    return sums.select(*keys, status.alias("margin_status"), F.when(F.col("whole"), rate).alias("margin_rate"))


def margin_backfill(snapshots: DataFrame, components: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Evidence with both components put in, and ``outcome`` for each row of ``components`` (unique keys).

    UNCHANGED where both are stored with these values and nothing else under their names, ENRICHED where
    they were put in the place of what was there, MISSING_SNAPSHOT without a snapshot. A second run is UNCHANGED.
    """
    rows = components.select(*keys, "amount", "base").join(snapshots.select(*keys, "evidence", F.lit(True).alias("_found")), keys, "left")
    now = F.coalesce("evidence", F.array().cast(f"array<{ENTRY}>"))
    named = lambda e: F.coalesce(e["component"].isin(AMOUNT, BASE), F.lit(False))
    same = [F.coalesce(_component(now, name, source) == F.array(F.col(c).cast(DECIMAL)), F.lit(False)) for name, c in ((AMOUNT, "amount"), (BASE, "base"))]
    stored = same[0] & same[1] & (F.size(F.filter(now, named)) == 2)
    entry = lambda name, c: F.struct(F.lit(name).alias("component"), F.lit(source).alias("source"), F.lit("AVAILABLE").alias("status"), F.col(c).cast("string").alias("value"))
    added = F.concat(F.filter(now, lambda e: ~named(e)), F.array(entry(AMOUNT, "amount"), entry(BASE, "base")))
    outcome = F.when(F.col("_found").isNull(), "MISSING_SNAPSHOT").when(stored, "UNCHANGED").otherwise("ENRICHED")
    return rows.select(*keys, outcome.alias("outcome"), F.when(F.col("_found"), F.when(stored, now).otherwise(added)).alias("evidence"))
