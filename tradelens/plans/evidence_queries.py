"""Queries on evidence, workbooks, ERP orders, product plans and report text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..binding import daily_metrics, items, listings, orders, read
from ..functions import display
from ..operators import evidence as ev
from ..operators import materialize as mat
from ..operators import plan_rules as rules
from ..shared import checkpoint_folder
from ..sources import erp, workbook
from ..streaming.tables import ControlTable, recover_leases
from .base import Queries, local

R = Queries()
N = "day(day)"


def _noted(spark, d):
    """Daily metrics with margin evidence: whole, without base, with a doubled amount, or from another source."""
    rows, n = daily_metrics(spark, d), F.dayofmonth("day")
    entry = lambda c, v, source="FINANCE": F.struct(F.lit(c).alias("component"), F.lit(source).alias("source"), F.lit("AVAILABLE").alias("status"), v.cast("string").alias("value"))
    a, b = entry(ev.AMOUNT, F.col("sales_count")), entry(ev.BASE, F.col("visits"))
    kinds = F.when(n == 3, F.array(a)).when(n == 4, F.array(a, a, b)).when(n == 5, F.array(a, entry(ev.BASE, F.col("visits"), "ERP"))).otherwise(F.array(entry("OTHER", F.lit("x")), a, b))
    return rows.withColumn("evidence", kinds)


@R.add("agg_margin_components", f"SELECT account_code, week, CASE WHEN bool_and({N} NOT IN (3, 4, 5)) THEN CASE WHEN sum(visits) = 0 THEN 'UNAVAILABLE_ZERO_BASE' ELSE 'AVAILABLE' END ELSE 'UNAVAILABLE_COMPONENTS' END AS margin_status, CASE WHEN bool_and({N} NOT IN (3, 4, 5)) AND sum(visits) <> 0 THEN CAST((2 * CAST(sum(sales_count) AS HUGEINT) * 1000000000000 + CAST(sum(visits) AS HUGEINT)) // (2 * CAST(sum(visits) AS HUGEINT)) AS DOUBLE) / 1e10 END AS margin_rate FROM (SELECT *, CAST({N} // 7 AS INTEGER) AS week FROM dm) GROUP BY 1, 2")
def agg_margin_components(spark, d):
    rows = _noted(spark, d).withColumn("week", F.floor(F.dayofmonth("day") / 7).cast("int"))
    return ev.margin(rows, ["account_code", "week"], "FINANCE")


# The same entries in SQL; those that count are picked out of the lists.
_NAMED = "x.component IN ('MARGIN_AMOUNT', 'MARGIN_BASE_AMOUNT')"
_GOOD = "x.source = 'FINANCE' AND x.status = 'AVAILABLE' AND TRY_CAST(x.value AS DECIMAL(38,10)) IS NOT NULL"
NOTED = f""", en AS (SELECT *, {N} AS n, {{'component': 'MARGIN_AMOUNT', 'source': 'FINANCE', 'status': 'AVAILABLE', 'value': CAST(sales_count AS VARCHAR)}} AS a, {{'component': 'MARGIN_BASE_AMOUNT', 'source': 'FINANCE', 'status': 'AVAILABLE', 'value': CAST(visits AS VARCHAR)}} AS b,
  {{'component': 'MARGIN_BASE_AMOUNT', 'source': 'ERP', 'status': 'AVAILABLE', 'value': CAST(visits AS VARCHAR)}} AS c, {{'component': 'OTHER', 'source': 'FINANCE', 'status': 'AVAILABLE', 'value': 'x'}} AS x FROM dm),
ev AS (SELECT account_code, day, n, visits, sales_count, CASE n WHEN 3 THEN [a] WHEN 4 THEN [a, a, b] WHEN 5 THEN [a, c] ELSE [x, a, b] END AS e FROM en),
nw AS (SELECT account_code, day, sales_count + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS amount, visits AS base FROM ev),
sn AS (SELECT account_code, day, e, [CAST(x.value AS DECIMAL(38,10)) FOR x IN e IF x.component = 'MARGIN_AMOUNT' AND {_GOOD}] AS va, [CAST(x.value AS DECIMAL(38,10)) FOR x IN e IF x.component = 'MARGIN_BASE_AMOUNT' AND {_GOOD}] AS vb, len([x FOR x IN e IF {_NAMED}]) AS named, len([x FOR x IN e IF NOT {_NAMED}]) AS others FROM ev WHERE n % 10 <> 1),
bf AS (SELECT account_code, day, CASE WHEN e IS NULL THEN 'MISSING_SNAPSHOT' WHEN va = [CAST(amount AS DECIMAL(38,10))] AND vb = [CAST(base AS DECIMAL(38,10))] AND named = 2 THEN 'UNCHANGED' ELSE 'ENRICHED' END AS outcome, len(e) AS n_entries, others FROM nw LEFT JOIN sn USING (account_code, day))"""


@R.add("pl_margin_backfill", f"{NOTED} SELECT account_code, day, outcome, CAST(CASE outcome WHEN 'UNCHANGED' THEN n_entries WHEN 'ENRICHED' THEN others + 2 END AS INTEGER) AS entries FROM bf")
def pl_margin_backfill(spark, d):
    rows, n = _noted(spark, d), F.dayofmonth("day")
    new = rows.select("account_code", "day", F.when(n % 2 == 0, F.col("sales_count") + 1).otherwise(F.col("sales_count")).alias("amount"), F.col("visits").alias("base"))
    out = ev.margin_backfill(rows.where(n % 10 != 1), new, ["account_code", "day"], "FINANCE")
    return out.select("account_code", "day", "outcome", F.when(F.col("evidence").isNotNull(), F.size("evidence")).alias("entries"))


@R.add("fn_canonical_json", """, rw AS (SELECT account_code, day, '{ "b" : [1, "s", ' || CAST(sales_count AS VARCHAR) || '], "a": {"y":' || CASE WHEN day(day) % 2 = 0 THEN 'null' ELSE '{"z": "' || account_code || '"}' END || ', "x": ' || CAST(visits AS VARCHAR) || '}}' AS raw FROM dm)
SELECT account_code, day, '{"a":{"x":' || CAST(json_extract(raw, '$.a.x') AS VARCHAR) || ',"y":' || CAST(json_extract(raw, '$.a.y') AS VARCHAR) || '},"b":' || CAST(json_extract(raw, '$.b') AS VARCHAR) || '}' AS text FROM rw""")
def fn_canonical_json(spark, d):
    y = F.when(F.dayofmonth("day") % 2 == 0, "null").otherwise(F.concat(F.lit('{"z": "'), "account_code", F.lit('"}')))
    raw = F.concat(F.lit('{ "b" : [1, "s", '), F.col("sales_count").cast("string"), F.lit('], "a": {"y":'), y, F.lit(', "x": '), F.col("visits").cast("string"), F.lit("}}"))
    return daily_metrics(spark, d).select("account_code", "day", ev.canonical_json(raw).alias("text"))


ALLOWED = {"metric": ["visits", "gross"], "source": ["MARKETPLACE", "ERP"], "status": ["AVAILABLE", "UNAVAILABLE"], "comparison": ["EXACT", "DIFFERENT", "PRIMARY"]}


_RAW = f"""'[7, null, ["x"], {{"metric": "visits", "secret": 1, "source": "' || CASE WHEN {N} % 2 = 0 THEN 'ERP' ELSE '<script>' END || '", "value": ' || CAST(visits AS VARCHAR) || ', "absolute_difference": "' || CASE WHEN {N} % 3 = 0 THEN '1.50' ELSE 'many' END || '"}}]'"""


@R.add("fn_evidence_sanitize", f"""{', rw AS (SELECT account_code, day, unnest(json_extract(' + _RAW + ", '$[*]')) AS e FROM dm)"}
SELECT account_code, day, max(CASE WHEN e->>'$.metric' IN ('visits', 'gross') THEN e->>'$.metric' END) AS metric, max(CASE WHEN e->>'$.source' IN ('MARKETPLACE', 'ERP') THEN e->>'$.source' END) AS source,
CAST(max(TRY_CAST(e->>'$.value' AS DECIMAL(38,10))) AS DOUBLE) AS value, CAST(max(TRY_CAST(e->>'$.absolute_difference' AS DECIMAL(38,10))) AS DOUBLE) AS absolute_difference, CAST(count(*) AS INTEGER) AS entries FROM rw WHERE json_type(e) = 'OBJECT' GROUP BY 1, 2""")
def fn_evidence_sanitize(spark, d):
    n = F.dayofmonth("day")
    source, gap = F.when(n % 2 == 0, "ERP").otherwise("<script>"), F.when(n % 3 == 0, "1.50").otherwise("many")
    raw = F.concat(F.lit('[7, null, ["x"], {"metric": "visits", "secret": 1, "source": "'), source, F.lit('", "value": '), F.col("visits").cast("string"), F.lit(', "absolute_difference": "'), gap, F.lit('"}]'))
    rows = daily_metrics(spark, d).select("account_code", "day", ev.sanitized(raw, ALLOWED).alias("e"))
    one = F.get("e", F.lit(0))
    return rows.select("account_code", "day", one["metric"].alias("metric"), one["source"].alias("source"), one["value"].cast("double").alias("value"), one["absolute_difference"].cast("double").alias("absolute_difference"), F.size("e").alias("entries"))


@R.add("src_xlsx", """, b AS (SELECT order_id // 2000 AS book, CAST(row_number() OVER (PARTITION BY order_id // 2000 ORDER BY order_id) + 1 AS BIGINT) AS row_number, CAST(sold_at AS DATE) AS day, order_id, gross_amount FROM o)
SELECT 'book-' || CAST(book AS VARCHAR) AS path, row_number, CASE WHEN order_id % 3 <> 0 THEN strftime(day, '%d/%m/%Y') ELSE CAST(date_diff('day', CASE WHEN book % 2 = 1 THEN DATE '1904-01-01' ELSE DATE '1899-12-30' END, day) AS VARCHAR) END AS sold_on, day AS sold_on_day, CAST(order_id AS VARCHAR) AS order_reference, CAST(gross_amount AS VARCHAR) AS total_sale FROM b""")
def src_xlsx(spark, d):
    """A third of the days are serial numbers, in every second workbook those of the 1904 system."""
    blank, k, day = F.lit(None).cast("string"), F.col("order_id"), F.to_date("sold_at")
    late = F.floor(k / 2000) % 2 == 1
    values = {"sold_on": F.date_format("sold_at", "dd/MM/yyyy"), "order_reference": k, "total_sale": F.col("gross_amount")}
    serial = F.when(k % 3 == 0, F.date_diff(day, F.when(late, F.lit("1904-01-01")).otherwise("1899-12-30").cast("date")))
    rows = orders(spark, d).select(F.concat(F.lit("book-"), F.floor(k / 2000).cast("string")).alias("path"), "order_id", *(values.get(c, blank).alias(c) for c in workbook.HEADERS), serial.alias("sold_on_number"), late.alias("from_1904"))
    read_ = workbook.read_workbooks(workbook.write_workbooks(rows, "path", "order_id", from_1904="from_1904"))
    return read_.select("path", "row_number", "sold_on", "sold_on_day", "order_reference", "total_sale")


ERP_DAY = "DATE '2001-07-10'"


@R.add("src_erp_orders", f"SELECT order_id AS erp_id, CASE WHEN order_id % 3 = 0 THEN 'S' ELSE 'D' END || CAST(order_id AS VARCHAR) AS ecommerce_id, CASE WHEN order_id % 2 = 0 THEN 1 ELSE 0 END AS status_code, gross_amount AS total FROM o WHERE CASE WHEN order_id % 2 = 0 THEN CAST(sold_at AS DATE) ELSE CAST({local('sold_at')} AS DATE) END = {ERP_DAY}")
def src_erp_orders(spark, d):
    k, text = F.col("order_id"), F.col("order_id").cast("string")
    base = orders(spark, d)
    none = F.lit(None).cast("string")
    created = F.when(k % 2 == 0, F.date_format("sold_at", "yyyy-MM-dd")).otherwise(F.date_format("sold_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    ends = [text.alias("number"), none.alias("channel_id"), none.alias("channel")]
    summaries = base.select(k.alias("erp_id"), created.alias("created_at"), F.concat(F.lit("S"), text).alias("ecommerce_id"), F.lit(0).alias("status_code"), *ends)
    details = base.select(k.alias("erp_id"), F.when(k % 3 != 0, F.concat(F.lit("D"), text)).alias("ecommerce_id"), F.when(k % 2 == 0, 1).alias("status_code"), F.col("gross_amount").alias("total"), *ends)
    return erp.erp_orders(summaries, details, F.to_date(F.lit("2001-07-10"))).select("erp_id", "ecommerce_id", "status_code", "total")


@R.add("src_shipments_api", "SELECT order_id, CASE WHEN order_id % 4 = 0 THEN 2 WHEN order_id % 4 = 1 THEN 0 ELSE 1 END AS shipments, CASE order_id % 4 WHEN 0 THEN 'drop_off,fulfillment' WHEN 1 THEN '' ELSE 'fulfillment' END AS kinds FROM o")
def src_shipments_api(spark, d):
    o = orders(spark, d).select("order_id")
    k = F.col("order_id")
    first, second = o.where(k % 4 != 1).withColumn("logistic_type", F.lit("fulfillment")), o.where(k % 4 == 0).withColumn("logistic_type", F.lit("drop_off"))
    return erp.with_shipments(o, first.unionByName(second)).select("order_id", F.col("shipments").cast("int").alias("shipments"), F.array_join("kinds", ",").alias("kinds"))


def _plan(spark, d):
    """A plan over parts: a candidate for each group of ten, with the state it meets."""
    parts = listings(spark, d).select(F.col("listing_id").alias("item_id"))
    g, k = F.floor(F.col("item_id") / 10), F.col("item_id")
    links = parts.select(g.alias("candidate_id"), "item_id", F.concat(F.lit("K"), k.cast("string")).alias("seller_sku"))
    c = F.col("candidate_id")
    candidates = links.select("candidate_id").distinct().select(c, F.format_string("P%d", c).alias("sku"), F.format_string("name %d", c).alias("name"), F.when(c % 5 == 0, c + 1000).alias("reuse_id"))
    state = candidates.where(c % 5 <= 2).select((c + 1000).alias("product_id"), "sku", F.when(c % 5 == 2, "other").otherwise(F.col("name")).alias("name"))
    items_now = links.select("item_id", F.when(k % 7 == 0, "changed").otherwise(F.col("seller_sku")).alias("seller_sku"), F.when(k % 3 == 0, F.col("candidate_id") + 1000).alias("product_id"))
    identities = links.select("candidate_id", F.concat(F.lit("C1|M|"), k.cast("string")).alias("identity_key"))
    stored = identities.where(F.substring("identity_key", -1, 1) == "5").select("identity_key", (F.col("candidate_id") + 1000).alias("product_id"))
    return candidates, links, identities, state, items_now, stored


# The same plan and state in SQL; outcomes follow from joins.
PLAN = """, ln AS (SELECT listing_id // 10 AS c, listing_id AS k, 'K' || CAST(listing_id AS VARCHAR) AS seller_sku FROM li), cd AS (SELECT DISTINCT c, 'P' || CAST(c AS VARCHAR) AS sku, 'name ' || CAST(c AS VARCHAR) AS name, CASE WHEN c % 5 = 0 THEN c + 1000 END AS reuse_id FROM ln),
st AS (SELECT c + 1000 AS product_id, sku, CASE WHEN c % 5 = 2 THEN 'other' ELSE name END AS name FROM cd WHERE c % 5 <= 2),
it AS (SELECT k AS item_id, CASE WHEN k % 7 = 0 THEN 'changed' ELSE seller_sku END AS seller_sku, CASE WHEN k % 3 = 0 THEN c + 1000 END AS product_id FROM ln),
idn AS (SELECT c, 'C1|M|' || CAST(k AS VARCHAR) AS ikey FROM ln), sd AS (SELECT ikey, count(*) AS n, max(c + 1000) AS owner FROM idn WHERE ikey LIKE '%5' GROUP BY 1),
tg AS (SELECT cd.c, bs.product_id AS sku_id, CASE WHEN reuse_id IS NOT NULL THEN CASE WHEN bi.sku = cd.sku AND bs.product_id = reuse_id THEN 'REUSE' ELSE 'CONFLICT' END WHEN bs.product_id IS NULL THEN 'CREATE' WHEN bs.name = cd.name THEN 'REUSE' ELSE 'CONFLICT' END AS outcome
  FROM cd LEFT JOIN st bs ON bs.sku = cd.sku LEFT JOIN st bi ON bi.product_id = cd.reuse_id),
tt AS (SELECT c, CASE WHEN outcome = 'REUSE' THEN sku_id END AS target FROM tg),
lo AS (SELECT ln.c, k, CASE WHEN it.item_id IS NULL OR it.seller_sku <> ln.seller_sku THEN 'CONFLICT' WHEN it.product_id IS NULL THEN 'CREATE' WHEN it.product_id = target THEN 'ALREADY_CORRECT' ELSE 'CONFLICT' END AS outcome FROM ln JOIN tt USING (c) LEFT JOIN it ON item_id = k),
io AS (SELECT c, CASE WHEN n IS NULL THEN 'CREATE' WHEN n = 1 AND owner = target THEN 'ALREADY_CORRECT' ELSE 'CONFLICT' END AS outcome FROM idn JOIN tt USING (c) LEFT JOIN sd USING (ikey)),
pn AS (SELECT sku, product_id FROM st UNION ALL SELECT sku, c + 1000 FROM cd JOIN tg USING (c) WHERE outcome = 'CREATE')"""


@R.add("pl_materialize_validate", f"{PLAN} SELECT 'DECLARED_COUNT' AS rule, 'links' AS subject UNION ALL SELECT 'REPEATED_ITEM', CAST(k AS VARCHAR) FROM ln WHERE k % 100 = 0 UNION ALL SELECT 'NO_LINKS', '-1' UNION ALL SELECT 'DECLARED_COUNT', 'candidates'")
def pl_materialize_validate(spark, d):
    candidates, links, identities, *_ = _plan(spark, d)
    more = spark.createDataFrame([(-1, "PX", "x", None)], "candidate_id long, sku string, name string, reuse_id long")
    return mat.plan_faults(candidates.unionByName(more), links.unionByName(links.where(F.col("item_id") % 100 == 0)), identities, {"candidates": -1, "links": -1})


# A plan with evidence over parts and the orders that hold them, with faults of every kind, for both engines.
FACTS = {
    "lk": """SELECT p_partkey AS k, CAST(floor(p_partkey / 10) AS BIGINT) AS c, CAST(floor(p_partkey / 10) AS BIGINT) % 3 AS t FROM {part}""",
    "links": """SELECT CASE WHEN c % 41 = 0 THEN 'pc-high-' ELSE 'PC-HIGH-' END || CAST(c AS VARCHAR(20)) AS candidate_id, 'I' || CAST(k AS VARCHAR(20)) AS item_id, CASE WHEN (c + CASE WHEN k % 37 = 0 THEN 1 ELSE 0 END) % 2 = 0 THEN 'C1' ELSE 'C2' END AS account,
      CASE WHEN c % 2 = 0 THEN 'B1' ELSE 'B2' END AS business_id, 'M' || CAST(k AS VARCHAR(20)) AS listing_id, CASE WHEN k % 4 = 0 THEN 'V' || CAST(k AS VARCHAR(20)) END AS variation_id, CASE WHEN k % 29 = 0 THEN 'X' WHEN k % 4 = 0 THEN 'V' || CAST(k AS VARCHAR(20)) ELSE 'M' || CAST(k AS VARCHAR(20)) END AS sellable_id,
      CASE WHEN k % 6 <> 0 THEN 'S' || CAST(k AS VARCHAR(20)) END AS seller_sku, 'E' || CAST(c + CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) AS erp_product_id, CASE WHEN k % 59 = 0 THEN 'other' ELSE 'K' || CAST(c AS VARCHAR(20)) END AS erp_sku,
      CASE WHEN k % 43 = 0 THEN 'TITLE' WHEN t = 1 THEN 'OLIST_SKU_EXACT_UNIQUE_PLUS_MULTIPLE_PAID_ORDERS' WHEN t = 0 AND c % 2 = 0 THEN 'GTIN_UNIQUE' ELSE 'ORDER_PRODUCT_ID' END AS evidence, k, c, t
      FROM {lk} WHERE (t = 0 AND c % 2 = 0) OR (t = 2 AND k % 10 < 4) OR k % 10 = 0 OR (c % 13 = 0 AND k % 10 = 1)""",
    "support": """SELECT candidate_id, item_id, 'O' || CAST(l_orderkey AS VARCHAR(20)) AS market_order_id, 'R' || CAST(CAST(floor(l_orderkey / 4) AS BIGINT) AS VARCHAR(20)) AS erp_order_id, CASE WHEN l_orderkey % 50 <> 7 THEN 'E' || CAST(c AS VARCHAR(20)) END AS erp_product_id, CAST(l_quantity AS BIGINT) AS units
      FROM {links} JOIN {lineitem} ON l_partkey = k WHERE l_orderkey % 8 = l_partkey % 8""",
    "backed": """SELECT item_id, count(*) AS orders, sum(units) AS units FROM {support} GROUP BY item_id""",
    "full_links": """SELECT l.*, coalesce(orders, 0) + CASE WHEN k % 47 = 0 THEN 1 ELSE 0 END AS correlated_orders, CASE WHEN k % 53 = 0 THEN 1 ELSE 0 END AS conflicting_orders FROM {links} l LEFT JOIN {backed} b ON b.item_id = l.item_id""",
    "per": """SELECT c, t, min(candidate_id) AS candidate_id, count(*) AS n FROM {links} GROUP BY c, t""",
    "candidates": """SELECT candidate_id, c, t, CASE t WHEN 0 THEN 'HIGH' WHEN 1 THEN 'PROMOTABLE_TO_HIGH' ELSE CASE WHEN c % 61 = 0 THEN 'LOW' ELSE 'DETERMINISTIC_HIGH' END END AS classification, CASE WHEN c % 23 = 0 THEN 'BLOCKED' ELSE 'READY' END AS status, CASE WHEN c % 23 = 0 THEN 1 ELSE 0 END AS blockers,
      CASE WHEN t = 0 AND c % 2 = 0 THEN CAST(10000000 + c AS VARCHAR(20)) || CASE WHEN c % 15 = 0 THEN 'x' ELSE '' END END AS gtin, n + CASE WHEN c % 17 = 0 THEN 1 ELSE 0 END AS listing_item_count, CASE WHEN c % 2 = 0 THEN 'C1' ELSE 'C2' END AS account, 'E' || CAST(c AS VARCHAR(20)) AS erp_product_id,
      CASE WHEN c % 27 = 1 THEN 'PRD-X' WHEN t = 0 AND c % 2 = 0 THEN 'PRD-GTIN-' || CAST(10000000 + c AS VARCHAR(20)) ELSE 'PRD-OLIST-' || CASE WHEN c % 2 = 0 THEN 'C1' ELSE 'C2' END || '-E' || CAST(c AS VARCHAR(20)) END AS sku,
      CASE WHEN c % 33 = 2 THEN 'DUP' WHEN t = 0 AND c % 2 = 0 THEN 'GTIN:' || CAST(10000000 + c AS VARCHAR(20)) ELSE CASE WHEN c % 2 = 0 THEN 'C1' ELSE 'C2' END || ':OLIST:E' || CAST(c AS VARCHAR(20)) END AS group_key,
      CASE WHEN t > 0 AND c % 5 = 0 THEN 'REUSE_HIGH_PRODUCT_AND_LINK' ELSE 'CREATE_PRODUCT_AND_LINK' END AS action, CASE WHEN t > 0 AND c % 5 = 0 AND c % 25 <> 0 THEN 'P' || CAST(c AS VARCHAR(20)) END AS reuse_id FROM {per}""",
    "paid": """SELECT candidate_id AS paid_of, count(*) AS paid_orders, sum(units) AS paid_units FROM {support} GROUP BY candidate_id""",
    "market_ids": """SELECT candidate_id, k, c, business_id, 'MERCADO_LIVRE' AS provider, CASE WHEN k % 45 = 0 THEN 'Z' ELSE seller_sku END AS seller_sku, listing_id, variation_id, item_id, 'CREATE' AS action, CASE WHEN k % 51 = 0 THEN 'I0' END AS existing_id FROM {links} WHERE k % 39 <> 0 AND t > 0""",
    "erp_ids": """SELECT candidate_id, min(k) AS k, c, business_id, 'OLIST' AS provider, min(erp_sku) AS seller_sku, erp_product_id AS listing_id, CAST(NULL AS VARCHAR(20)) AS variation_id, CAST(NULL AS VARCHAR(20)) AS item_id, CASE WHEN c % 5 = 0 THEN 'ALREADY_CORRECT' ELSE 'CREATE' END AS action, CASE WHEN c % 5 = 0 AND c % 20 <> 0 THEN 'I' || CAST(c AS VARCHAR(20)) END AS existing_id FROM {links} WHERE t > 0 GROUP BY candidate_id, c, business_id, erp_product_id""",
    "identities": """SELECT i.*, d.sku FROM (SELECT * FROM {market_ids} UNION ALL SELECT * FROM {erp_ids}) i JOIN {candidates} d ON d.candidate_id = i.candidate_id""",
}


def _facts(spark, d):
    """The plan's tables, with their lists."""
    out = {"part": read(spark, d, "part"), "lineitem": read(spark, d, "lineitem")}
    for name, text in FACTS.items():
        out[name] = spark.sql(text, **out)
    c, t = F.col("c"), F.col("t")
    kinds = F.when(t == 0, F.array(F.lit("GTIN_UNIQUE"))).when(t == 1, F.array(*map(F.lit, rules.EVIDENCE[rules.PROMOTED]))).otherwise(F.array(F.lit("ORDER_PRODUCT_ID")))
    lists = {
        "accounts": F.when(c % 21 == 0, F.array("account", "account")).when(c % 22 == 0, F.array(F.lit("C1"), F.lit("C2"))).otherwise(F.array("account")), "evidence": F.when(c % 19 == 0, F.array_append(kinds, F.lit("TITLE"))).otherwise(kinds), "erp_products": F.array(F.struct("account", "erp_product_id")),
    }
    paid = F.coalesce("paid_orders", F.lit(0))
    audit = F.struct(F.lit(1).alias("matches"), F.when(c % 14 == 1, 2).otherwise(1).alias("unlinked"), paid.alias("paid_orders"), F.coalesce("paid_units", F.lit(0)).alias("paid_units"), F.array_repeat(F.lit("O"), paid.cast("int")).alias("order_ids"), (c % 35 != 1).alias("consistent"), F.lit(0).alias("divergent"))
    candidates = out["candidates"].join(out["paid"], F.col("candidate_id") == F.col("paid_of"), "left").withColumns(lists).withColumn("audit", audit)
    return candidates.drop("account", "erp_product_id", "c", "t", "paid_of"), out["full_links"].drop("k", "c", "t"), out["identities"].drop("k", "c"), out["support"].drop("units")


DECLARED = {"productCandidates": 7, "productsToCreate": 7, "productsToReuse": 7, "bothAccounts": 0, "ready": 7, "marketIdentities": 7, "erpIdentities": 7, "externalIdentities": 7, "listingItems": 7}
FACTS_SQL = ", " + ", ".join(f"{n} AS ({t.format(part='part', lineitem='lineitem', **{k: k for k in FACTS})})" for n, t in FACTS.items())
EVIDENCE_SQL = f"""{FACTS_SQL},
cd2 AS (SELECT *, CASE WHEN c % 21 = 0 THEN [account, account] WHEN c % 22 = 0 THEN ['C1', 'C2'] ELSE [account] END AS accounts, coalesce(paid_orders, 0) AS po, coalesce(paid_units, 0) AS pu FROM candidates LEFT JOIN paid ON paid_of = candidate_id),
ls AS (SELECT l.*, d.classification, d.accounts, d.account AS own_account, d.erp_product_id AS own_product, coalesce(s.orders, 0) AS orders, coalesce(s.mo, 0) AS mo, coalesce(s.eo, 0) AS eo, coalesce(s.odd, 0) AS odd
  FROM full_links l JOIN cd2 d USING (candidate_id) LEFT JOIN (SELECT s.item_id, count(*) AS orders, count(DISTINCT market_order_id) AS mo, count(DISTINCT erp_order_id) AS eo, count(*) FILTER (s.erp_product_id IS DISTINCT FROM l.erp_product_id) AS odd FROM support s JOIN links l USING (item_id) GROUP BY 1) s USING (item_id)),
ag AS (SELECT candidate_id, count(*) AS n, count(*) FILTER (NOT list_contains(accounts, account)) AS sa, count(DISTINCT account) AS na, count(DISTINCT erp_product_id) AS ne, min(account) AS la, min(erp_product_id) AS le,
  count(*) FILTER (CASE classification WHEN 'HIGH' THEN evidence NOT IN ('GTIN_UNIQUE', 'ORDER_PRODUCT_ID') WHEN 'PROMOTABLE_TO_HIGH' THEN evidence <> 'OLIST_SKU_EXACT_UNIQUE_PLUS_MULTIPLE_PAID_ORDERS' WHEN 'DETERMINISTIC_HIGH' THEN evidence <> 'ORDER_PRODUCT_ID' ELSE false END) AS se FROM ls GROUP BY 1),
ac AS (SELECT candidate_id, count(*) FILTER (action = 'ALREADY_CORRECT') AS ok FROM identities GROUP BY 1),
w AS (SELECT cd2.*, ag.* EXCLUDE (candidate_id), coalesce(ok, 0) AS ok, sku = 'PRD-OLIST-' || la || '-' || le AND group_key = la || ':OLIST:' || le AS ek, classification IN ('PROMOTABLE_TO_HIGH', 'DETERMINISTIC_HIGH') AS later FROM cd2 JOIN ag USING (candidate_id) LEFT JOIN ac USING (candidate_id)),
wi AS (SELECT candidate_id, business_id, 'MERCADO_LIVRE' AS provider, listing_id, coalesce(variation_id, '') AS variation_id, seller_sku, item_id, true AS agree FROM links WHERE t > 0
  UNION ALL SELECT candidate_id, business_id, 'OLIST', erp_product_id, '', arg_min(erp_sku, item_id), NULL, count(DISTINCT erp_sku) = 1 FROM links WHERE t > 0 GROUP BY candidate_id, business_id, erp_product_id),
bi AS (SELECT coalesce(i.candidate_id, wi.candidate_id) AS cid, coalesce(i.candidate_id, wi.candidate_id) || '|' || coalesce(i.business_id, wi.business_id) || '|' || coalesce(i.provider, wi.provider) || '|' || coalesce(i.listing_id, wi.listing_id) || '|' || coalesce(i.variation_id, wi.variation_id, '') AS key,
  i.candidate_id IS NOT NULL AS planned, wi.candidate_id IS NOT NULL AS derived, i.seller_sku IS NOT DISTINCT FROM wi.seller_sku AND i.item_id IS NOT DISTINCT FROM wi.item_id AS same, i.action, i.existing_id, i.provider, wi.agree
  FROM identities i FULL JOIN wi ON i.candidate_id = wi.candidate_id AND i.business_id = wi.business_id AND i.provider = wi.provider AND i.listing_id = wi.listing_id AND coalesce(i.variation_id, '') = wi.variation_id),
bl AS (SELECT bi.* FROM bi JOIN w ON w.candidate_id = cid WHERE later)
SELECT 'CANDIDATE_ID' AS rule, candidate_id AS subject FROM w WHERE c % 41 = 0
UNION ALL SELECT 'CLASSIFICATION', candidate_id FROM w WHERE classification = 'LOW'
UNION ALL SELECT 'READY', candidate_id FROM w WHERE status <> 'READY' OR listing_item_count <> n
UNION ALL SELECT 'ACCOUNTS', candidate_id FROM w WHERE len(list_distinct(accounts)) <> len(accounts) OR sa > 0
UNION ALL SELECT 'EVIDENCE', candidate_id FROM w WHERE se > 0 OR (c % 19 = 0 AND classification <> 'LOW')
UNION ALL SELECT 'CANONICAL_KEY', candidate_id FROM w WHERE NOT CASE classification WHEN 'LOW' THEN true WHEN 'DETERMINISTIC_HIGH' THEN ek AND na = 1 AND ne = 1 AND len(accounts) = 1 AND la = account AND le = erp_product_id
  WHEN 'HIGH' THEN CASE WHEN gtin IS NULL THEN n = 1 AND ek ELSE regexp_full_match(gtin, '[0-9]{{8,14}}') AND sku = 'PRD-GTIN-' || gtin AND group_key = 'GTIN:' || gtin END ELSE n = 1 AND ek END
UNION ALL SELECT 'PRODUCT_ACTION', candidate_id FROM w WHERE later AND (action = 'CREATE_PRODUCT_AND_LINK') <> (reuse_id IS NULL)
UNION ALL SELECT 'AUDIT', candidate_id FROM w WHERE classification = 'PROMOTABLE_TO_HIGH' AND (c % 14 = 1 OR po < 2 OR pu < 1 OR c % 35 = 1)
UNION ALL SELECT 'REUSE_IDENTITIES', candidate_id FROM w WHERE later AND (action = 'CREATE_PRODUCT_AND_LINK') <> (ok = 0)
UNION ALL SELECT 'SELLABLE', item_id FROM ls WHERE sellable_id <> coalesce(variation_id, listing_id)
UNION ALL SELECT 'ERP_PRODUCT', item_id FROM ls WHERE account <> own_account OR erp_product_id <> own_product
UNION ALL SELECT 'ORDER_SUPPORT', item_id FROM ls WHERE classification = 'DETERMINISTIC_HIGH' AND (orders < 2 OR correlated_orders <> orders OR conflicting_orders <> 0)
UNION ALL SELECT 'INDEPENDENT_ORDERS', item_id FROM ls WHERE classification = 'DETERMINISTIC_HIGH' AND (mo <> orders OR eo <> orders)
UNION ALL SELECT 'SUPPORTED_PRODUCT', item_id FROM ls WHERE classification = 'DETERMINISTIC_HIGH' AND odd > 0
UNION ALL SELECT 'PLANNED_IDENTITY', key FROM bl WHERE NOT (planned AND derived AND same)
UNION ALL SELECT 'AGREED_IDENTITY', key FROM bl WHERE NOT agree
UNION ALL SELECT 'IDENTITY_ACTION', key FROM bl WHERE planned AND NOT CASE WHEN action = 'CREATE' THEN existing_id IS NULL ELSE existing_id IS NOT NULL AND provider = 'OLIST' END
UNION ALL SELECT 'REPEATED_GROUP', group_key FROM w GROUP BY group_key HAVING count(*) > 1"""


@R.add("pl_materialize_evidence", EVIDENCE_SQL)
def pl_materialize_evidence(spark, d):
    return rules.evidence_faults(*_facts(spark, d))


@R.add("pl_materialize_totals", f"""{FACTS_SQL}, tt AS (SELECT unnest([
  {{'n': 'productCandidates', 'v': (SELECT count(*) FROM candidates)}}, {{'n': 'productsToCreate', 'v': (SELECT count(*) FROM candidates WHERE action LIKE 'CREATE%')}}, {{'n': 'productsToReuse', 'v': (SELECT count(*) FROM candidates WHERE action LIKE 'REUSE%')}},
  {{'n': 'bothAccounts', 'v': (SELECT count(*) FROM candidates WHERE c % 22 = 0 AND c % 21 <> 0)}}, {{'n': 'ready', 'v': (SELECT count(*) FROM candidates WHERE status = 'READY')}}, {{'n': 'listingItems', 'v': (SELECT count(*) FROM links)}},
  {{'n': 'marketIdentities', 'v': (SELECT count(*) FROM identities WHERE action = 'CREATE' AND provider = 'MERCADO_LIVRE')}}, {{'n': 'erpIdentities', 'v': (SELECT count(*) FROM identities WHERE action = 'CREATE' AND provider = 'OLIST')}}, {{'n': 'externalIdentities', 'v': (SELECT count(*) FROM identities WHERE action = 'CREATE')}}]) AS x)
SELECT 'DECLARED_COUNT' AS rule, x.n AS subject FROM tt WHERE x.v <> CASE WHEN x.n = 'bothAccounts' THEN 0 ELSE 7 END""")
def pl_materialize_totals(spark, d):
    candidates, links, identities, _ = _facts(spark, d)
    return rules.declared_faults(candidates, links, identities, DECLARED)


@R.add("pl_materialize_analyze", f"{PLAN} SELECT 'product' AS kind, outcome, count(*) AS n FROM tg GROUP BY ALL UNION ALL SELECT 'link', outcome, count(*) FROM lo GROUP BY ALL UNION ALL SELECT 'identity', outcome, count(*) FROM io GROUP BY ALL")
def pl_materialize_analyze(spark, d):
    candidates, links, identities, state, items_now, stored = _plan(spark, d)
    found = mat.targets(candidates, state)
    return mat.outcomes(found, mat.link_outcomes(found, links, items_now), mat.identity_outcomes(found, identities, stored))


@R.add("pl_materialize_apply", f"""{PLAN}, bl AS (SELECT DISTINCT c FROM lo WHERE outcome = 'CONFLICT'), nl AS (SELECT k, pn.product_id AS new_id FROM lo JOIN cd USING (c) JOIN pn USING (sku) WHERE lo.outcome = 'CREATE' AND lo.c NOT IN (SELECT c FROM bl))
SELECT item_id, coalesce(product_id, new_id) AS product_id FROM it LEFT JOIN nl ON k = item_id""")
def pl_materialize_apply(spark, d):
    candidates, links, _, state, items_now, _ = _plan(spark, d)
    found = mat.targets(candidates, state)
    made = found.where("outcome = 'CREATE'").select((F.col("candidate_id") + 1000).alias("product_id"), "sku", "name")
    return mat.applied_items(items_now, mat.link_outcomes(found, links, items_now), state.unionByName(made), candidates).select("item_id", "product_id")


MONEY_TEXT = "translate(format('{:,.2f}', CAST(gross_amount AS DOUBLE)), ',.', '.,')"


@R.add("fn_format_ptbr", f"SELECT order_id, 'R$ ' || {MONEY_TEXT} AS price, '+' || {MONEY_TEXT} || '%' AS change FROM o")
def fn_format_ptbr(spark, d):
    return orders(spark, d).select("order_id", display.currency_ptbr("gross_amount").alias("price"), display.signed_percent_ptbr("gross_amount").alias("change"))


@R.add("snk_markdown", f"SELECT order_id AS line_number, '| ' || CAST(order_id AS VARCHAR) || ' | ' || account_code || '\\|x | R$ ' || {MONEY_TEXT} || ' |' AS line FROM o UNION ALL SELECT -1, '| Order | Account | Gross |' UNION ALL SELECT 0, '| --- | --- | --- |'")
def snk_markdown(spark, d):
    rows = orders(spark, d).withColumn("account", F.concat("account_code", F.lit("|x")))
    return display.markdown_lines(rows, "order_id", {"Order": display.cell("order_id"), "Account": display.cell("account"), "Gross": display.currency_ptbr("gross_amount")})


@R.add("fn_stale_banner", "SELECT account_code, day, CASE WHEN date_diff('day', day, DATE '2024-01-30') > 1 THEN 'data end ' || CAST(date_diff('day', day, DATE '2024-01-30') AS VARCHAR) || ' days ago' END AS banner FROM dm")
def fn_stale_banner(spark, d):
    return daily_metrics(spark, d).select("account_code", "day", display.stale_banner("day", F.to_date(F.lit("2024-01-30"))).alias("banner"))


@R.add("prj_account_cast", "SELECT order_id, account_code AS account, status, quantity FROM i JOIN o USING (order_id)")
def prj_account_cast(spark, d):
    nested = items(spark, d).join(orders(spark, d), "order_id").select("order_id", "quantity", F.struct(F.struct(F.col("account_code").alias("code")).alias("account"), "status").alias("o"))
    return nested.select("order_id", F.col("o.account.code").alias("account"), "o.status", "quantity")


@R.add("rm_pi_coverage_const", "SELECT account_code, count(*) AS items, count(product_id) AS covered FROM i JOIN o USING (order_id) GROUP BY 1")
def rm_pi_coverage_const(spark, d):
    return items(spark, d).join(orders(spark, d), "order_id").groupBy("account_code").agg(F.count("*").alias("items"), F.count("product_id").alias("covered"))


@R.add("st_lease_recovery", "SELECT order_id AS run_id, CASE WHEN status = 'PROCESSING' AND sold_at < TIMESTAMP '2001-07-01' - INTERVAL 30 MINUTE THEN 'FAILED' WHEN status = 'PROCESSING' THEN 'RUNNING' ELSE 'COMPLETED' END AS status FROM o")
def st_lease_recovery(spark, d):
    runs = orders(spark, d).select(F.col("order_id").alias("run_id"), F.when(F.col("status") == "PROCESSING", "RUNNING").otherwise("COMPLETED").alias("status"), F.col("sold_at").alias("heartbeat_at"))
    table = ControlTable(spark, f"{checkpoint_folder(spark)}/runs-{uuid.uuid4()}")
    table.replace(runs)
    recover_leases(table, F.lit("2001-07-01").cast("timestamp"))
    return table.read()[1].select("run_id", "status")


QUERIES, ORACLES = R.queries, R.sql
