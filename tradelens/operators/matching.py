"""Matching of ERP orders with marketplace orders, and of financial references with both.

Market orders: ``order_id``, ``pack_id`` (strings). ERP orders: ``erp_id``, ``ecommerce_id``, ``channel_id``.
Null identifiers match nothing. Ids of orders are unique; erp_id too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Attempts in order: which ERP field is looked up as which market identifier.
ATTEMPTS = [("ecommerce_id", "order_id"), ("ecommerce_id", "pack_id"), ("channel_id", "order_id"), ("channel_id", "pack_id")]


def _attempts(erp: DataFrame) -> DataFrame:
    """One row per ERP order and usable attempt."""
    tries = F.array(*(F.struct(F.lit(i).alias("attempt"), F.lit(key).alias("kind"), F.col(field).alias("value")) for i, (field, key) in enumerate(ATTEMPTS, 1)))
    return erp.select("erp_id", F.inline(tries)).where(F.col("value").isNotNull())


def _identifiers(market: DataFrame) -> DataFrame:
    """One row per market order and identifier."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("order_id", "pack_id")))
    return market.select("order_id", F.inline(kinds)).where(F.col("value").isNotNull())


def match_orders(erp: DataFrame, market: DataFrame) -> DataFrame:
    """erp_id, status, attempt, order_id (of exact matches), candidates (of the first attempt).

    Candidate sets are compared as count, bounds and two hash sums of their ids, computed once per
    identifier before the join: an order or pack named by many rows is never gathered, and each
    attempt joins at most one row.
    """
    sets = _identifiers(market).groupBy("kind", "value").agg(
        F.count("*").alias("n"), F.min("order_id").alias("low"), F.max("order_id").alias("high"),
        F.sum(F.xxhash64("order_id").cast("decimal(20,0)")).alias("h1"), F.sum(F.hash("order_id").cast("long")).alias("h2"),
    )
    found = _attempts(erp).join(sets, ["kind", "value"]).select("erp_id", "attempt", F.struct("n", "low", "high", "h1", "h2").alias("found"))
    best = found.groupBy("erp_id").agg(F.min_by("found", "attempt").alias("first"), F.min("attempt").alias("attempt"), (F.min("found") != F.max("found")).alias("differ"))
    status = F.when(F.col("first").isNull(), "UNMATCHED").when(F.col("differ"), "CONFLICT").when(F.col("first.n") == 1, "MATCHED_EXACT").otherwise("AMBIGUOUS")
    out = erp.select("erp_id").join(best, "erp_id", "left").withColumn("status", status)
    exact = F.when(F.col("status") == "MATCHED_EXACT", F.col("first.low"))
    return out.select("erp_id", "status", "attempt", exact.alias("order_id"), F.coalesce("first.n", F.lit(0)).cast("long").alias("candidates"))


def union_attempts(erp: DataFrame, market: DataFrame) -> DataFrame:
    """erp_id, attempt, order_id: every hit of every attempt."""
    return _attempts(erp).join(_identifiers(market), ["kind", "value"]).select("erp_id", "attempt", "order_id")


def reference_evidence(erp: DataFrame, market: DataFrame) -> DataFrame:
    """reference, conflict, ambiguous, first, last: what the matches say that name an order or pack id.

    A match names the market orders of the identifier that it was found by (of all its identifiers
    where they contradict each other), with their packs. ERP orders are added up by identifier
    before they meet the market orders that it stands for, and those by reference: an identifier
    of m ERP orders and n market orders makes m + n rows, not m * n. ``first`` and ``last`` are the
    bounds of the ERP ids; they differ where there are several.
    """
    verdict = match_orders(erp, market).select("erp_id", "status", F.col("attempt").alias("first"))
    used = _attempts(erp).join(verdict, "erp_id").where((F.col("status") == "CONFLICT") | (F.col("attempt") == F.col("first")))
    parts = [F.bool_or("conflict").alias("conflict"), F.bool_or("ambiguous").alias("ambiguous"), F.min("first").alias("first"), F.max("last").alias("last")]
    named = used.select("kind", "value", (F.col("status") == "CONFLICT").alias("conflict"), (F.col("status") == "AMBIGUOUS").alias("ambiguous"), F.col("erp_id").alias("first"), F.col("erp_id").alias("last"))
    by_key = named.groupBy("kind", "value").agg(*parts)
    packs = market.select("order_id", "pack_id")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("order_id", "pack_id")))
    met = packs.select("*", F.inline(kinds)).join(by_key, ["kind", "value"])
    references = met.select(F.explode(F.array("order_id", "pack_id")).alias("reference"), "conflict", "ambiguous", "first", "last")
    return references.where(F.col("reference").isNotNull()).groupBy("reference").agg(*parts)


def three_way(records: DataFrame, erp: DataFrame, market: DataFrame) -> DataFrame:
    """order_reference, status for each distinct reference of financial records."""
    by = reference_evidence(erp, market)
    status = F.when(F.col("conflict").isNull(), "UNMATCHED").when(F.col("conflict"), "CONFLICT").when((F.col("first") != F.col("last")) | F.col("ambiguous"), "AMBIGUOUS").otherwise("MATCHED_EXACT")
    refs = records.select("order_reference").distinct()
    return refs.join(by, F.col("order_reference") == F.col("reference"), "left").select("order_reference", status.alias("status"))


#: What two lines must share to be partners, from the strictest to the loosest.
LINE_KEYS = [("sku", "unit_price", "quantity"), ("sku", "unit_price"), ("sku",), ("unit_price", "quantity")]


def aligned_lines(matches: DataFrame, erp_lines: DataFrame, market_lines: DataFrame) -> DataFrame:
    """erp_id, level, erp_line, market_line: a one-to-one assignment of the lines of matched orders.

    Lines (``line``, sku, unit_price, quantity) of a side are numbered from 1, by ``line`` and then by
    their other columns. Those of one match that share a key are paired in the order of their
    numbers; what is over goes on to the next looser key of ``LINE_KEYS`` (``level`` from 1), and
    lines without a partner have a null on the other side and no level. Lines are counted within
    their key and side, so no pairs are made: all levels work on one exchange by ERP order. Nulls in
    a key have no partner there. Other columns of the lines are in the structs.
    """
    keys = ["line", "sku", "unit_price", "quantity"]
    # a number keeps partitions from being merged to 64 MB: every sort of a task below holds its rows
    parts = 2 * int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(lines, name, key):
        more = [c for c in lines.columns if c not in (key, *keys)]
        number = F.row_number().over(Window.partitionBy("erp_id").orderBy(*keys, *more)).alias("line")
        rows = matches.select("erp_id", key).join(lines, key).repartition(parts, "erp_id").select("erp_id", F.lit(name).alias("side"), number, *keys[1:], *more)
        return rows.select("erp_id", "side", *keys, F.struct(*keys, *more).alias(name))

    rows = side(erp_lines, "erp_line", "erp_id").unionByName(side(market_lines, "market_line", "order_id"), allowMissingColumns=True)
    rows = rows.withColumns({"level": F.lit(None).cast("int"), "pair": F.lit(None).cast("int")})
    for level, key in enumerate(LINE_KEYS, 1):
        open_ = F.col("level").isNull()
        for k in key:
            open_ = open_ & F.col(k).isNotNull()
        group = Window.partitionBy("erp_id", *key)
        number = F.row_number().over(Window.partitionBy("erp_id", *key, "side", "open").orderBy("line"))
        both = F.least(*(F.count_if(F.col("open") & (F.col("side") == s)).over(group) for s in ("erp_line", "market_line")))
        rows = rows.withColumn("open", open_).withColumns({"number": number, "both": both})
        now = F.col("open") & (F.col("number") <= F.col("both"))
        rows = rows.withColumns({"level": F.coalesce("level", F.when(now, level)), "pair": F.coalesce("pair", F.when(now, F.col("number")))})
    # partners share their level, its key and their number in it
    shared = [F.when(F.array_contains(F.array(*(F.lit(i) for i, key in enumerate(LINE_KEYS, 1) if k in key)), F.col("level")), F.col(k)).alias("key_" + k) for k in keys[1:]]
    alone = F.when(F.col("level").isNull(), F.struct("side", "line")).alias("alone")
    paired = rows.groupBy("erp_id", "level", "pair", *shared, alone).agg(F.any_value("erp_line", True).alias("erp_line"), F.any_value("market_line", True).alias("market_line"))
    return paired.select("erp_id", "level", "erp_line", "market_line")


def matched_comparisons(erp: DataFrame, market: DataFrame, flags: DataFrame, erp_lines: DataFrame, market_lines: DataFrame) -> DataFrame:
    """One row per exact match: both orders, their units and gross amounts, fulfilment, and how their lines correspond.

    ``erp_lines`` and ``market_lines`` are lists of lines in their order; ``pairs`` has (level, erp_line,
    market_line) by line number, ``erp_only`` and ``market_only`` the numbers of lines without a partner.
    Market orders: order_id, pack_id, status, raw_status, gross_amount. ERP: erp_id, status_code, products.
    """
    method = F.element_at(F.array(*(F.lit(f"{field}->{key}") for field, key in ATTEMPTS)), F.col("attempt")).alias("method")
    exact = match_orders(erp, market).where("status = 'MATCHED_EXACT'").select("erp_id", "order_id", method)
    pairs = aligned_lines(exact, erp_lines, market_lines)

    def all_of(name):
        return F.array_sort(F.collect_list(name), lambda a, b: F.when(a.line < b.line, -1).when(a.line > b.line, 1).otherwise(0)).alias(name + "s")

    def total(name, value):
        # decimals of one scale all the way, so sums are exact
        return F.aggregate(name + "s", F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + value(x)).cast("decimal(38,2)"))

    lines = pairs.groupBy("erp_id").agg(
        all_of("erp_line"), all_of("market_line"),
        F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", F.col("erp_line.line").alias("erp_line"), F.col("market_line.line").alias("market_line"))))).alias("pairs"),
        F.array_sort(F.collect_list(F.when(F.col("market_line").isNull(), F.col("erp_line.line")))).alias("erp_only"),
        F.array_sort(F.collect_list(F.when(F.col("erp_line").isNull(), F.col("market_line.line")))).alias("market_only"),
    )
    ours = market.select("order_id", "pack_id", "raw_status", F.col("status").alias("market_status"), F.col("gross_amount").alias("market_amount"))
    theirs = erp.select("erp_id", "status_code", F.col("products").alias("erp_products"))
    rows = exact.join(ours, "order_id").join(theirs, "erp_id").join(flags, "order_id", "left").join(lines, "erp_id", "left")
    none = {c: F.coalesce(c, F.array()) for c in ("erp_lines", "market_lines", "pairs", "erp_only", "market_only")}
    rows = rows.withColumns(none)
    amounts = {
        "erp_units": total("erp_line", lambda x: x.quantity), "market_units": total("market_line", lambda x: x.quantity),
        "erp_gross": total("erp_line", lambda x: x.quantity * x.unit_price), "market_gross": total("market_line", lambda x: x.quantity * x.unit_price),
    }
    return rows.withColumns(amounts)


def match_rates(matches: DataFrame) -> DataFrame:
    """status, attempt, orders, percent of all orders."""
    total = matches.agg(F.count("*").alias("total"))  # one row
    rows = matches.groupBy("status", "attempt").agg(F.count("*").alias("orders")).join(F.broadcast(total))
    return rows.select("status", "attempt", "orders", F.round(F.col("orders").cast("decimal(20,4)") * 100 / F.col("total"), 6).cast("double").alias("percent"))


def shipment_flags(market: DataFrame, shipments: DataFrame) -> DataFrame:
    """order_id, is_full: any shipment is fulfilment; false without shipments; null when the lookup failed.

    Shipments: ``order_id``, ``logistic_type``, ``failed`` (the lookup of that order gave an error).
    """
    kinds = shipments.groupBy("order_id").agg(F.bool_or(F.col("failed")).alias("failed"), F.bool_or(F.lower("logistic_type") == "fulfillment").alias("full"))
    flag = F.when(F.coalesce("failed", F.lit(False)), F.lit(None).cast("boolean")).otherwise(F.coalesce("full", F.lit(False)))
    return market.select("order_id").join(kinds, "order_id", "left").select("order_id", flag.alias("is_full"))


def full_evidence(matches: DataFrame, flags: DataFrame) -> DataFrame:
    """erp_id, result: what the shipments of the matched order say about fulfilment."""
    rows = matches.join(flags.withColumn("known", F.lit(True)), "order_id", "left")
    result = (
        F.when(F.col("status").isin("CONFLICT", "AMBIGUOUS"), F.col("status"))
        .when((F.col("status") == "UNMATCHED") | (F.col("known") & F.col("is_full").isNull()), "NOT_PROVEN")
        .when(F.col("is_full"), "CORROBORATED")
        .otherwise("CONFLICT")
    )
    return rows.select("erp_id", result.alias("result"))


def erp_totals(erp: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of ERP orders; products and other expenses only where every order has a value.

    ``residual`` is total - products - freight + discount - other, null when one of them is.
    """

    def covered(name):
        return F.when(F.count(name) == F.count("*"), F.sum(name)).cast("decimal(38,2)").alias(name)

    out = erp.groupBy(*keys).agg(
        F.count("*").alias("orders"), *(F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)").alias(c) for c in ("total", "freight", "discount")),
        covered("products"), covered("other"), F.count_if(F.col("products").isNull()).alias("missing_products"),
    )
    return out.withColumn("residual", F.expr("CAST(total - products - freight + discount - other AS DECIMAL(38,2))"))


def operational_report(market: DataFrame, items: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Orders, item lines, units, fulfilment split and unknown shipments per group."""
    lines = items.groupBy("order_id").agg(F.count("*").alias("lines"), F.sum("quantity").alias("units"))
    rows = market.join(lines, "order_id", "left").join(flags, "order_id", "left")
    return rows.groupBy(*keys).agg(
        F.min("sold_at").alias("first_sale"), F.max("sold_at").alias("last_sale"), F.count("*").alias("orders"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
        F.count_if("is_full").alias("full_orders"), F.count_if(~F.col("is_full")).alias("other_orders"), F.count_if(F.col("is_full").isNull()).alias("missing_shipments"),
    )


def sku_breakdown(lines: DataFrame) -> DataFrame:
    """sku, product (of the line with the least ``place``), item lines and units; a line without a SKU counts under a dash."""
    by = lines.groupBy(F.coalesce("sku", F.lit("-")).alias("sku"))
    return by.agg(F.min_by("product", "place").alias("product"), F.count("*").alias("lines"), F.sum("quantity").alias("units"))
