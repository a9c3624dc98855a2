"""Queries on ERP matching and financial records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..binding import items, orders, read
from ..operators import finance as fin
from ..operators import matching as mt
from ..functions.scalars import map_values
from .base import Queries

R = Queries()

# An ERP order and a financial record for every order; identifiers are missing, shared or wrong on purpose.
VIEW = """, m AS (SELECT CAST(order_id AS VARCHAR) AS order_id, CASE WHEN order_id % 3 = 0 THEN 'P' || CAST(order_id // 6 AS VARCHAR) END AS pack_id, order_id AS k, account_code, sold_at, gross_amount FROM o),
erp AS (SELECT k AS erp_id, CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN 'P' || CAST(k // 6 AS VARCHAR) WHEN 2 THEN CAST(k + 1 AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS ecommerce_id,
  CASE k % 4 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN 'P' || CAST(k // 6 AS VARCHAR) END AS channel_id, CASE WHEN k % 12 < 11 THEN CAST(k % 12 AS INTEGER) END AS status_code,
  account_code, year(sold_at) AS year, gross_amount AS total, CASE WHEN k % 997 <> 0 THEN gross_amount - 10 END AS products, CAST(10 AS DECIMAL(14,2)) AS freight, CAST(k % 3 AS DECIMAL(14,2)) AS discount, CAST(k % 2 AS DECIMAL(14,2)) AS other FROM m),
sh AS (SELECT order_id, CASE WHEN k % 3 = 0 THEN 'Fulfillment' ELSE 'self_service' END AS logistic_type, k % 11 = 0 AS failed FROM m WHERE k % 4 <> 1),
fr AS (SELECT CASE k % 7 WHEN 0 THEN 'X' || CAST(k AS VARCHAR) WHEN 1 THEN coalesce(pack_id, order_id) ELSE order_id END AS order_reference, CAST(sold_at AS DATE) AS sold_on,
  CASE k % 4 WHEN 0 THEN 'Store 1' WHEN 1 THEN 'Store 2' WHEN 2 THEN 'Warehouse 2' ELSE 'Other shop' END AS channel, CASE WHEN k % 5 = 0 THEN 'cancelled' ELSE 'paid' END AS status,
  gross_amount AS product_sold, CAST(k % 5 AS DECIMAL(14,2)) AS discount, CAST(gross_amount - k % 5 AS DECIMAL(14,2)) AS total_products, CAST(k % 20 AS DECIMAL(14,2)) AS customer_shipping, CAST(gross_amount - k % 5 + k % 20 AS DECIMAL(14,2)) AS total_sale,
  CAST(k % 100 AS DECIMAL(14,2)) AS product_cost, CAST(k % 30 AS DECIMAL(14,2)) AS fees, CAST(k % 10 AS DECIMAL(14,2)) AS tax, CAST(gross_amount - k % 5 + k % 20 - k % 30 - k % 10 AS DECIMAL(14,2)) AS net,
  CAST(gross_amount - k % 5 + k % 20 - k % 30 - k % 10 - k % 100 AS DECIMAL(14,2)) AS margin FROM m)"""
MATCH = f"""{VIEW}, hits AS (SELECT erp_id, 1 AS attempt, m.order_id, pack_id FROM erp JOIN m ON ecommerce_id = m.order_id UNION ALL SELECT erp_id, 2, m.order_id, pack_id FROM erp JOIN m ON ecommerce_id = pack_id
  UNION ALL SELECT erp_id, 3, m.order_id, pack_id FROM erp JOIN m ON channel_id = m.order_id UNION ALL SELECT erp_id, 4, m.order_id, pack_id FROM erp JOIN m ON channel_id = pack_id),
sets AS (SELECT erp_id, attempt, list(order_id ORDER BY order_id) AS ids FROM hits GROUP BY ALL),
best AS (SELECT erp_id, min(attempt) AS attempt, arg_min(ids, attempt) AS ids, count(DISTINCT ids) AS kinds FROM sets GROUP BY 1),
mo AS (SELECT erp_id, CASE WHEN kinds IS NULL THEN 'UNMATCHED' WHEN kinds > 1 THEN 'CONFLICT' WHEN len(ids) = 1 THEN 'MATCHED_EXACT' ELSE 'AMBIGUOUS' END AS status, attempt, CASE WHEN kinds = 1 AND len(ids) = 1 THEN ids[1] END AS order_id, coalesce(len(ids), 0) AS candidates FROM erp LEFT JOIN best USING (erp_id))"""
FLAGS = ", fl AS (SELECT m.order_id, CASE WHEN coalesce(failed, false) THEN NULL ELSE coalesce(lower(logistic_type) = 'fulfillment', false) END AS is_full FROM m LEFT JOIN sh USING (order_id))"
SUMS = ", ".join(f"CAST(sum({c}) AS DECIMAL(38,2)) AS {c}" for c in fin.MONEY)
# quotient of whole numbers of cents, half away from zero
RATE = "CASE WHEN sum(total_products) <> 0 THEN sign(sum(margin)) * CAST((2 * CAST(abs(sum(margin)) * 100 AS HUGEINT) * 10000000000 + CAST(sum(total_products) * 100 AS HUGEINT)) // (2 * CAST(sum(total_products) * 100 AS HUGEINT)) AS DOUBLE) / 1e10 END AS margin_rate"
# Channel names of the binding and their codes; labels of ERP states by code.
CHANNEL_CODES = {"store 1": "ACCOUNT_1", "store 2": "ACCOUNT_2", "warehouse 2": "FULFILLMENT_2"}
ERP_LABELS = {8: "DADOS_INCOMPLETOS", 0: "ABERTA", 3: "APROVADA", 4: "PREPARANDO_ENVIO", 1: "FATURADA", 7: "PRONTO_ENVIO", 5: "ENVIADA", 6: "ENTREGUE", 2: "CANCELADA", 9: "NAO_ENTREGUE"}
CODE = f"CASE lower(channel) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CHANNEL_CODES.items())} ELSE 'OTHER' END"


def _views(spark, d):
    """market, erp, shipments and financial records, as in VIEW."""
    k, price = F.col("k"), F.col("gross_amount")
    text, pack = k.cast("string"), F.concat(F.lit("P"), F.floor(k / 6).cast("string"))
    base = orders(spark, d).withColumnRenamed("order_id", "k").withColumn("order_id", text).withColumn("pack_id", F.when(k % 3 == 0, pack))
    amount = lambda x: x.cast("decimal(14,2)")
    erp = base.select(
        k.alias("erp_id"), F.when(k % 10 == 1, pack).when(k % 10 == 2, (k + 1).cast("string")).when(k % 10 != 0, text).alias("ecommerce_id"), F.when(k % 4 == 0, text).when(k % 4 == 1, pack).alias("channel_id"),
        F.when(k % 12 < 11, (k % 12).cast("int")).alias("status_code"), "account_code", F.year("sold_at").alias("year"), price.alias("total"), F.when(k % 997 != 0, price - 10).alias("products"),
        amount(F.lit(10)).alias("freight"), amount(k % 3).alias("discount"), amount(k % 2).alias("other"),
    )
    ships = base.where(k % 4 != 1).select("order_id", F.when(k % 3 == 0, "Fulfillment").otherwise("self_service").alias("logistic_type"), (k % 11 == 0).alias("failed"))
    steps = {"product_sold": price, "discount": k % 5, "total_products": price - k % 5, "customer_shipping": k % 20, "total_sale": price - k % 5 + k % 20, "product_cost": k % 100, "fees": k % 30, "tax": k % 10}
    steps["net"] = steps["total_sale"] - k % 30 - k % 10
    steps["margin"] = steps["net"] - k % 100
    records = base.select(
        F.when(k % 7 == 0, F.concat(F.lit("X"), text)).when(k % 7 == 1, F.coalesce("pack_id", "order_id")).otherwise(text).alias("order_reference"), F.to_date("sold_at").alias("sold_on"),
        F.when(k % 4 == 0, "Store 1").when(k % 4 == 1, "Store 2").when(k % 4 == 2, "Warehouse 2").otherwise("Other shop").alias("channel"),
        F.when(k % 5 == 0, "cancelled").otherwise("paid").alias("status"), *(amount(x).alias(c) for c, x in steps.items()),
    ).withColumn("channel_code", map_values("channel", CHANNEL_CODES, "OTHER"))
    return base, erp, ships, records


def _matches(spark, d):
    base, erp, _, _ = _views(spark, d)
    return mt.match_orders(erp, base)


@R.add("join_multi_key_match", f"{MATCH} SELECT * FROM mo")
def join_multi_key_match(spark, d):
    return _matches(spark, d)


@R.add("set_union_attempts", f"{MATCH} SELECT erp_id, attempt, order_id FROM hits")
def set_union_attempts(spark, d):
    base, erp, _, _ = _views(spark, d)
    return mt.union_attempts(erp, base)


@R.add("join_three_way_match", f"""{MATCH}, hi AS (SELECT DISTINCT erp_id, mo.status, unnest([h.order_id, h.pack_id]) AS reference FROM hits h JOIN mo USING (erp_id) WHERE mo.status = 'CONFLICT' OR h.attempt = mo.attempt)
SELECT order_reference, CASE WHEN count(erp_id) = 0 THEN 'UNMATCHED' WHEN bool_or(hi.status = 'CONFLICT') THEN 'CONFLICT' WHEN count(DISTINCT erp_id) > 1 OR bool_or(hi.status = 'AMBIGUOUS') THEN 'AMBIGUOUS' ELSE 'MATCHED_EXACT' END AS status
FROM (SELECT DISTINCT order_reference FROM fr) f LEFT JOIN hi ON reference = order_reference GROUP BY 1""")
def join_three_way_match(spark, d):
    base, erp, _, records = _views(spark, d)
    return mt.three_way(records, erp, base)


@R.add("agg_match_rates", f"{MATCH} SELECT status, attempt, count(*) AS orders, CAST(CAST(2 * count(*) * 100000000 + (SELECT count(*) FROM mo) AS HUGEINT) // (2 * (SELECT count(*) FROM mo)) AS DOUBLE) / 1e6 AS percent FROM mo GROUP BY 1, 2")
def agg_match_rates(spark, d):
    return mt.match_rates(_matches(spark, d))


@R.add("join_shipment_flag", f"{VIEW}{FLAGS} SELECT order_id, is_full FROM fl")
def join_shipment_flag(spark, d):
    base, _, ships, _ = _views(spark, d)
    return mt.shipment_flags(base, ships)


@R.add("agg_full_evidence", f"{MATCH}{FLAGS} SELECT CASE WHEN status IN ('CONFLICT', 'AMBIGUOUS') THEN status WHEN status = 'UNMATCHED' OR is_full IS NULL THEN 'NOT_PROVEN' WHEN is_full THEN 'CORROBORATED' ELSE 'CONFLICT' END AS result, count(*) AS orders FROM mo LEFT JOIN fl USING (order_id) GROUP BY 1")
def agg_full_evidence(spark, d):
    base, erp, ships, _ = _views(spark, d)
    return mt.full_evidence(mt.match_orders(erp, base), mt.shipment_flags(base, ships)).groupBy("result").agg(F.count("*").alias("orders"))


@R.add("agg_erp_orders", f"""{VIEW}, t AS (SELECT account_code, year, count(*) AS orders, CAST(sum(total) AS DECIMAL(38,2)) AS total, CAST(sum(freight) AS DECIMAL(38,2)) AS freight, CAST(sum(discount) AS DECIMAL(38,2)) AS discount,
CAST(CASE WHEN count(products) = count(*) THEN sum(products) END AS DECIMAL(38,2)) AS products, CAST(sum(other) AS DECIMAL(38,2)) AS other, count(*) - count(products) AS missing_products FROM erp GROUP BY 1, 2)
SELECT *, CAST(total - products - freight + discount - other AS DECIMAL(38,2)) AS residual FROM t""")
def agg_erp_orders(spark, d):
    return mt.erp_totals(_views(spark, d)[1], ["account_code", "year"])


@R.add("rm_erp_inspection", f"""{MATCH} SELECT account_code, status, count(*) AS orders, CAST(sum(total) AS DECIMAL(38,2)) AS total FROM erp JOIN mo USING (erp_id) GROUP BY 1, 2""")
def rm_erp_inspection(spark, d):
    base, erp, _, _ = _views(spark, d)
    rows = erp.join(mt.match_orders(erp, base), "erp_id")
    return rows.groupBy("account_code", "status").agg(F.count("*").alias("orders"), F.sum("total").cast("decimal(38,2)").alias("total"))


# Lines of both sides of an order: the ERP lacks some, has other prices, quantities or no SKU for others.
LINES = f"""{MATCH}{FLAGS}, ml AS (SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS line, 'S' || CAST(l_partkey % 9 AS VARCHAR) AS sku, CAST(100 + l_suppkey % 3 AS DECIMAL(14,2)) AS unit_price, CAST(l_quantity % 4 + 1 AS BIGINT) AS quantity, l_partkey AS listing_id FROM lineitem),
el AS (SELECT CAST(order_id AS BIGINT) AS erp_id, line, CASE WHEN (CAST(order_id AS BIGINT) + line) % 11 <> 0 THEN sku END AS sku, CAST(unit_price + CASE WHEN (CAST(order_id AS BIGINT) + line) % 5 = 0 THEN 1 ELSE 0 END AS DECIMAL(14,2)) AS unit_price, quantity + CASE WHEN (CAST(order_id AS BIGINT) + line) % 6 = 0 THEN 1 ELSE 0 END AS quantity FROM ml WHERE (CAST(order_id AS BIGINT) + 3 * line) % 7 <> 0),
el0 AS (SELECT mo.erp_id, row_number() OVER (PARTITION BY mo.erp_id ORDER BY line, sku NULLS FIRST, unit_price, quantity) AS line, sku, unit_price, quantity FROM mo JOIN el USING (erp_id) WHERE mo.status = 'MATCHED_EXACT'),
ml0 AS (SELECT mo.erp_id, row_number() OVER (PARTITION BY mo.erp_id ORDER BY line, sku, unit_price, quantity, listing_id) AS line, sku, unit_price, quantity, listing_id FROM mo JOIN ml USING (order_id) WHERE mo.status = 'MATCHED_EXACT')"""
for _i, _key in enumerate(mt.LINE_KEYS, 1):
    _by = ", ".join(_key)
    _some = " AND ".join(f"{k} IS NOT NULL" for k in _key)
    LINES += f""", lp{_i} AS (SELECT a.erp_id, {_i} AS level, a.line AS el, b.line AS ml FROM (SELECT *, row_number() OVER (PARTITION BY erp_id, {_by} ORDER BY line) AS n FROM el{_i - 1} WHERE {_some}) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY erp_id, {_by} ORDER BY line) AS n FROM ml{_i - 1} WHERE {_some}) b USING (erp_id, n, {_by})),
el{_i} AS (SELECT l.* FROM el{_i - 1} l ANTI JOIN lp{_i} p ON p.erp_id = l.erp_id AND p.el = l.line), ml{_i} AS (SELECT l.* FROM ml{_i - 1} l ANTI JOIN lp{_i} p ON p.erp_id = l.erp_id AND p.ml = l.line)"""
LINES += ", lp AS (" + " UNION ALL ".join(f"SELECT * FROM lp{i}" for i in range(1, len(mt.LINE_KEYS) + 1)) + ")"
_METHODS = " ".join(f"WHEN {i} THEN '{a}->{b}'" for i, (a, b) in enumerate(mt.ATTEMPTS, 1))


def _text_of(lines, *fields):
    return F.array_join(F.transform(lines, lambda x: F.concat_ws(":", *(F.coalesce(x[f].cast("string"), F.lit("?")) for f in fields))), ",")


@R.add("rm_erp_inspection_matches", f"""{LINES},
ea AS (SELECT erp_id, string_agg(line || ':' || coalesce(sku, '?') || ':' || unit_price || ':' || quantity, ',' ORDER BY line) AS erp_lines, sum(quantity) AS eu, sum(quantity * unit_price) AS eg FROM el0 GROUP BY 1),
ma AS (SELECT erp_id, string_agg(line || ':' || sku || ':' || unit_price || ':' || quantity || ':' || listing_id, ',' ORDER BY line) AS market_lines, sum(quantity) AS mu, sum(quantity * unit_price) AS mg FROM ml0 GROUP BY 1),
pa AS (SELECT erp_id, string_agg(level || ':' || el || ':' || ml, ',' ORDER BY level, el, ml) AS pairs FROM lp GROUP BY 1),
eo AS (SELECT erp_id, string_agg(line, ',' ORDER BY line) AS erp_only FROM el{len(mt.LINE_KEYS)} GROUP BY 1), mn AS (SELECT erp_id, string_agg(line, ',' ORDER BY line) AS market_only FROM ml{len(mt.LINE_KEYS)} GROUP BY 1)
SELECT erp_id, mo.order_id, m.pack_id, CASE attempt {_METHODS} END AS method, lower(o.status) AS raw_status, o.status AS market_status, erp.status_code, fl.is_full, m.gross_amount AS market_amount, erp.products AS erp_products,
coalesce(erp_lines, '') AS erp_lines, coalesce(market_lines, '') AS market_lines, coalesce(pairs, '') AS pairs, coalesce(erp_only, '') AS erp_only, coalesce(market_only, '') AS market_only,
CAST(coalesce(eu, 0) AS DECIMAL(38,2)) AS erp_units, CAST(coalesce(mu, 0) AS DECIMAL(38,2)) AS market_units, CAST(coalesce(eg, 0) AS DECIMAL(38,2)) AS erp_gross, CAST(coalesce(mg, 0) AS DECIMAL(38,2)) AS market_gross
FROM mo JOIN erp USING (erp_id) JOIN m ON m.order_id = mo.order_id JOIN o ON CAST(o.order_id AS VARCHAR) = mo.order_id LEFT JOIN fl ON fl.order_id = mo.order_id
LEFT JOIN ea USING (erp_id) LEFT JOIN ma USING (erp_id) LEFT JOIN pa USING (erp_id) LEFT JOIN eo USING (erp_id) LEFT JOIN mn USING (erp_id) WHERE mo.status = 'MATCHED_EXACT'""")
def rm_erp_inspection_matches(spark, d):
    base, erp, ships, _ = _views(spark, d)
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    sku, price, quantity = F.concat(F.lit("S"), (F.col("l_partkey") % 9).cast("string")), (100 + F.col("l_suppkey") % 3).cast("decimal(14,2)"), (F.col("l_quantity") % 4 + 1).cast("long")
    lines = read(spark, d, "lineitem")
    ours = lines.select(k.cast("string").alias("order_id"), n.alias("line"), sku.alias("sku"), price.alias("unit_price"), quantity.alias("quantity"), F.col("l_partkey").alias("listing_id"))
    theirs = lines.where((k + 3 * n) % 7 != 0).select(
        k.alias("erp_id"), n.alias("line"), F.when((k + n) % 11 != 0, sku).alias("sku"),
        (price + F.when((k + n) % 5 == 0, 1).otherwise(0)).cast("decimal(14,2)").alias("unit_price"), (quantity + F.when((k + n) % 6 == 0, 1).otherwise(0)).alias("quantity"),
    )
    out = mt.matched_comparisons(erp, base.withColumn("raw_status", F.lower("status")), mt.shipment_flags(base, ships), theirs, ours)
    common = ("line", "sku", "unit_price", "quantity")
    return out.withColumns({
        "erp_lines": _text_of("erp_lines", *common), "market_lines": _text_of("market_lines", *common, "listing_id"), "pairs": _text_of("pairs", "level", "erp_line", "market_line"),
        "erp_only": F.array_join("erp_only", ","), "market_only": F.array_join("market_only", ","),
    })


@R.add("agg_operational_report", f"""{VIEW}{FLAGS}, ln AS (SELECT CAST(order_id AS VARCHAR) AS order_id, count(*) AS lines, sum(quantity) AS units FROM i GROUP BY 1)
SELECT account_code, min(sold_at) AS first_sale, max(sold_at) AS last_sale, count(*) AS orders, CAST(coalesce(sum(lines), 0) AS BIGINT) AS lines, CAST(coalesce(sum(units), 0) AS BIGINT) AS units, count(*) FILTER (is_full) AS full_orders,
count(*) FILTER (NOT is_full) AS other_orders, count(*) FILTER (is_full IS NULL) AS missing_shipments FROM m LEFT JOIN ln USING (order_id) LEFT JOIN fl USING (order_id) GROUP BY 1""")
def agg_operational_report(spark, d):
    base, _, ships, _ = _views(spark, d)
    lines = items(spark, d).withColumn("order_id", F.col("order_id").cast("string"))
    out = mt.operational_report(base, lines, mt.shipment_flags(base, ships), ["account_code"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_sale", "last_sale")})


@R.add("agg_units_investigation", "SELECT account_code, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units, count(*) FILTER (quantity > 1) AS multi_lines, CAST(coalesce(sum(quantity) FILTER (quantity > 1), 0) AS BIGINT) AS multi_units FROM i JOIN o USING (order_id) GROUP BY 1")
def agg_units_investigation(spark, d):
    many = F.col("quantity") > 1
    rows = items(spark, d).join(orders(spark, d), "order_id").groupBy("account_code")
    return rows.agg(F.count("*").alias("lines"), F.sum("quantity").alias("units"), F.count_if(many).alias("multi_lines"), F.coalesce(F.sum(F.when(many, F.col("quantity"))), F.lit(0)).alias("multi_units"))


@R.add("prj_erp_status_label", f"{VIEW} SELECT erp_id, CASE status_code {' '.join(f"WHEN {k} THEN '{v}'" for k, v in ERP_LABELS.items())} ELSE coalesce('DESCONHECIDA_' || CAST(status_code AS VARCHAR), 'DESCONHECIDA') END AS label FROM erp")
def prj_erp_status_label(spark, d):
    table = F.create_map(*(F.lit(x) for kv in ERP_LABELS.items() for x in kv))
    code = F.col("status_code")
    return _views(spark, d)[1].select("erp_id", F.coalesce(table[code], F.concat(F.lit("DESCONHECIDA_"), code.cast("string")), F.lit("DESCONHECIDA")).alias("label"))


@R.add("prj_channel_code", f"{VIEW} SELECT channel, {CODE} AS channel_code, count(*) AS records FROM fr GROUP BY 1, 2")
def prj_channel_code(spark, d):
    return _views(spark, d)[3].groupBy("channel", "channel_code").agg(F.count("*").alias("records"))


@R.add("flt_channel_allow", f"{VIEW} SELECT order_reference, channel = 'Warehouse 2' AS full_evidence FROM fr WHERE channel IN ('Store 1', 'Store 2', 'Warehouse 2')")
def flt_channel_allow(spark, d):
    return _views(spark, d)[3].where(F.lower("channel").isin(*CHANNEL_CODES)).select("order_reference", (F.col("channel") == "Warehouse 2").alias("full_evidence"))


@R.add("agg_financial_totals", f"{VIEW} SELECT sold_on, count(*) AS records, {SUMS}, {RATE} FROM fr GROUP BY 1")
def agg_financial_totals(spark, d):
    return fin.totals(_views(spark, d)[3], ["sold_on"])


@R.add("agg_financial_breakdown", f"{VIEW} SELECT 'channel' AS dimension, channel AS value, count(*) AS records, {SUMS}, {RATE} FROM fr GROUP BY channel UNION ALL SELECT 'status', status, count(*), {SUMS}, {RATE} FROM fr GROUP BY status")
def agg_financial_breakdown(spark, d):
    return fin.breakdown(_views(spark, d)[3])


DIGEST = f"""{VIEW}, ds AS (SELECT sold_on, {CODE} AS code, regexp_replace(CAST(CAST(sum(total_products) AS DECIMAL(38,2)) AS VARCHAR), '\\.?0+$', '') AS p, regexp_replace(CAST(CAST(sum(margin) AS DECIMAL(38,2)) AS VARCHAR), '\\.?0+$', '') AS g FROM fr GROUP BY 1, 2),
dg AS (SELECT sold_on, sha256('["daily-aggregates",[' || string_agg('["' || CAST(sold_on AS VARCHAR) || '","' || code || '","' || p || '","' || g || '"]', ',' ORDER BY code) || ']]') AS sha256 FROM ds GROUP BY 1)"""


@R.add("agg_content_hash", f"{DIGEST} SELECT sold_on, sha256 FROM dg")
def agg_content_hash(spark, d):
    return fin.day_digests(_views(spark, d)[3])


@R.add("agg_report_inspection", f"{VIEW} SELECT sold_on, count(*) AS records, count(DISTINCT channel) AS channels FROM fr GROUP BY 1")
def agg_report_inspection(spark, d):
    return fin.inspect(_views(spark, d)[3])


@R.add("pl_backfill_plan", f"""{DIGEST} SELECT sold_on, CASE WHEN sold_on >= DATE '2001-07-25' THEN 'CURRENT_DAY_IGNORED' WHEN day(sold_on) % 5 = 0 THEN 'FULL_EXTERNAL_PROCESS' WHEN day(sold_on) % 5 = 1 THEN 'BLOCKED_LEGACY'
WHEN day(sold_on) % 5 = 2 THEN 'LOCAL_REFRESH' ELSE 'SKIPPED' END AS action FROM dg""")
def pl_backfill_plan(spark, d):
    days = fin.day_digests(_views(spark, d)[3])
    kind = F.dayofmonth("sold_on") % 5
    old = days.where(kind != 0).select("sold_on", F.when(kind == 2, "stale").when(kind > 2, F.col("sha256")).alias("daily_sha256"))
    return fin.backfill_plan(days, old, F.to_date(F.lit("2001-07-25")))


@R.add("pl_import", f"{VIEW} SELECT DISTINCT 2 AS ordinal FROM fr WHERE channel IN ('Store 2', 'Warehouse 2')")
def pl_import(spark, d):
    return fin.account_of_channels(_views(spark, d)[3].where(F.col("channel").isin("Store 2", "Warehouse 2")))


QUERIES, ORACLES = R.queries, R.sql
