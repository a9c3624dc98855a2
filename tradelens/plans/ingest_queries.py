"""Queries on ingestion: payloads, upserts, chunks and text rules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..binding import items, orders
from ..functions import scalars as s
from ..operators import ingest as ing
from ..operators.finance import canonical_decimal
from ..sources import landing
from .base import Queries, local

R = Queries()
CUT = "TIMESTAMP '2001-01-01'"


def _payloads(spark, d):
    """Order payloads as JSON, as a web service gives them; every third order has no payments."""
    lines = items(spark, d).groupBy("order_id").agg(F.collect_list(F.struct(
        F.struct(F.col("listing_id").cast("string").alias("id"), F.when(F.col("sellable_id") % 2 == 0, F.col("sellable_id").cast("string")).alias("variation_id")).alias("item"),
        "quantity", F.lit("1.50").alias("unit_price"))).alias("order_items"))
    k = F.col("order_id")
    raw = F.when(k % 5 == 0, "confirmed").when(k % 5 == 1, "payment_required").when(k % 5 == 2, "paid").when(k % 5 == 3, "pending_cancel").otherwise("something_else")
    pay = F.when(k % 3 != 0, F.array(F.struct(F.lit("1.25").alias("transaction_amount_refunded")), F.struct(F.lit(None).cast("string").alias("transaction_amount_refunded"))))
    order = F.struct(k.cast("string").alias("id"), raw.alias("status"), F.date_format("sold_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_created"), F.col("gross_amount").cast("string").alias("total_amount"), pay.alias("payments"), "order_items")
    return orders(spark, d).join(lines, "order_id").select(k, F.to_json(order).alias("payload"))


RAW = "CASE order_id % 5 WHEN 0 THEN 'PROCESSING' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'PAID' WHEN 3 THEN 'CANCELLED' ELSE 'UNKNOWN' END"
FLAT = f"SELECT CAST(order_id AS VARCHAR) AS order_id, {RAW} AS status, CAST(gross_amount AS DECIMAL(14,2)) AS gross_amount, CASE WHEN order_id % 3 <> 0 THEN CAST(1.25 AS DECIMAL(38,2)) END AS refunded_amount, (SELECT count(*) FROM i WHERE i.order_id = o.order_id) AS lines FROM o WHERE order_id IN (SELECT order_id FROM i)"


@R.add("prj_order_flatten", "SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(listing_id AS VARCHAR) AS listing_id, CAST(CASE WHEN sellable_id % 2 = 0 THEN sellable_id ELSE listing_id END AS VARCHAR) AS sellable_id, quantity, CAST(quantity * 1.5 AS DECIMAL(38,2)) AS item_gross FROM i JOIN o USING (order_id)")
def prj_order_flatten(spark, d):
    return landing.order_lines(landing.parse_orders(_payloads(spark, d))).select("order_id", "listing_id", "sellable_id", "quantity", "item_gross")


@R.add("src_orders_api", f"{FLAT} AND sold_at >= {CUT} AND sold_at < TIMESTAMP '2001-02-01'")
def src_orders_api(spark, d):
    rows = landing.within(landing.parse_orders(_payloads(spark, d)), "sold_at", F.lit("2001-01-01").cast("timestamp"), F.lit("2001-02-01").cast("timestamp"))
    return rows.select("order_id", "status", "gross_amount", "refunded_amount", F.size("lines").cast("long").alias("lines"))


@R.add("prj_status_map", f"SELECT {RAW} AS status, count(*) AS orders FROM o WHERE order_id IN (SELECT order_id FROM i) GROUP BY 1")
def prj_status_map(spark, d):
    return landing.parse_orders(_payloads(spark, d)).groupBy("status").agg(F.count("*").alias("orders"))


def _catalog(spark, d, skus: int | None = None):
    """Catalog payloads: items with two variations, with one, and with none; ``skus`` numbers shared by all."""
    k = F.col("p_partkey")
    number = (k if skus is None else F.floor(k / 4) % skus).cast("string")
    sku = lambda x: F.array(F.struct(F.lit("SELLER_SKU").alias("id"), x.alias("value_name")))
    blank = F.lit(None).cast("string")
    one = lambda n: F.struct(F.concat(k.cast("string"), F.lit(f"-{n}")).alias("id"), sku(F.when(k % 4 == n, F.concat(F.lit("V"), number)).otherwise(" ")).alias("attributes"),
        F.array(F.struct(F.lit("Color").alias("name"), F.lit("red").alias("value_name")), F.struct(F.lit("Size").alias("name"), F.lit(str(n)).alias("value_name"))).alias("attribute_combinations"))
    variations = F.when(k % 3 == 0, F.array(one(1), one(2))).when(k % 3 == 1, F.array(one(1)))
    item = F.struct(k.cast("string").alias("id"), F.col("p_name").alias("title"), F.lit("active").alias("status"), F.when(k % 2 == 0, F.concat(F.lit("I"), number)).otherwise(blank).alias("seller_custom_field"), variations.alias("variations"))
    return spark.read.parquet(f"{d}/part.parquet").select(k, F.to_json(item).alias("payload"))


CATALOG = """, cv AS (SELECT p_partkey AS k, unnest(CASE p_partkey % 3 WHEN 0 THEN [1, 2] WHEN 1 THEN [1] ELSE [NULL] END) AS n FROM part),
ct AS (SELECT CAST(k AS VARCHAR) AS listing_id, CAST(k AS VARCHAR) || '-' || CAST(n AS VARCHAR) AS variation_id, 'Color: red / Size: ' || CAST(n AS VARCHAR) AS label,
  CASE WHEN k % 4 = n THEN 'V' || CAST(k AS VARCHAR) WHEN k % 2 = 0 THEN 'I' || CAST(k AS VARCHAR) END AS sku, CASE WHEN k % 4 = n THEN 'variation' WHEN k % 2 = 0 THEN 'item' ELSE 'none' END AS sku_source FROM cv)"""


@R.add("prj_catalog_normalize", f"{CATALOG} SELECT * FROM ct")
def prj_catalog_normalize(spark, d):
    return landing.catalog_rows(_catalog(spark, d)).drop("title", "listing_status")


@R.add("src_catalog_scroll", f"{CATALOG} SELECT listing_id, count(*) AS rows FROM ct GROUP BY 1")
def src_catalog_scroll(spark, d):
    k = F.col("p_partkey")
    pages = _catalog(spark, d).select(F.lit("all").alias("scan"), F.floor(k / 50).alias("page"), k.cast("string").alias("item_id"), "payload")
    again = pages.where("page = 0").withColumn("page", F.lit(1).cast("long"))  # a scroll may give an item twice
    return landing.catalog_rows(landing.scrolled(pages.unionByName(again))).groupBy("listing_id").agg(F.count("*").alias("rows"))


@R.add("src_catalog_bulk", "SELECT count(*) AS requested, count(*) FILTER (p_partkey % 10 = 0) AS failed FROM part")
def src_catalog_bulk(spark, d):
    return landing.bulk(_catalog(spark, d).select(F.when(F.col("p_partkey") % 10 == 0, 404).otherwise(200).alias("code"), F.col("payload").alias("body")))[1]


def _halves(spark, d):
    """Stored orders (before 2001, all PENDING) and a payload batch that overlaps them."""
    o = orders(spark, d).select("account_code", "order_id", "status", "gross_amount", "sold_at")
    cut = F.lit("2001-01-01").cast("timestamp")
    old = o.where(F.col("sold_at") < cut).withColumn("status", F.lit("PENDING")).withColumn("product_id", F.col("order_id") % 50)
    new = o.where(F.col("sold_at") >= cut - F.expr("INTERVAL 90 DAYS")).withColumn("product_id", F.lit(None).cast("long"))
    return old.drop("sold_at"), new.drop("sold_at")


EARLY = "TIMESTAMP '2000-10-03'"


@R.add("snk_order_upsert", f"SELECT account_code, order_id, CASE WHEN sold_at >= {EARLY} THEN status ELSE 'PENDING' END AS status, gross_amount, CASE WHEN sold_at < {CUT} THEN order_id % 50 END AS product_id FROM o")
def snk_order_upsert(spark, d):
    old, new = _halves(spark, d)
    return ing.upsert(old, new, ["account_code", "order_id"], keep=("product_id",))


@R.add("pl_catalog_sync", f"SELECT count(*) FILTER (sold_at >= {CUT}) AS created, count(*) FILTER (sold_at < {CUT}) AS updated FROM o WHERE sold_at >= {EARLY}")
def pl_catalog_sync(spark, d):
    return ing.upsert_counts(*_halves(spark, d), ["account_code", "order_id"])


@R.add("st_dedup_late", "SELECT order_id, status, 2 AS batch FROM o WHERE order_id % 2 = 0 UNION ALL SELECT order_id, 'PENDING', 1 FROM o WHERE order_id % 2 <> 0")
def st_dedup_late(spark, d):
    o = orders(spark, d).select("order_id", "status")
    first = o.withColumn("status", F.lit("PENDING")).withColumn("batch", F.lit(1))
    second = o.where(F.col("order_id") % 2 == 0).withColumn("batch", F.lit(2))
    return ing.latest(first.unionByName(second), ["order_id"], ["batch"])


@R.add("set_dedupe_orders", "SELECT order_id, account_code FROM o")
def set_dedupe_orders(spark, d):
    o = orders(spark, d).select("order_id", "account_code")
    return o.unionByName(o).dropDuplicates(["order_id"])


@R.add("fn_chunk_windows", """, g AS (SELECT account_code, CAST(min(sold_at) AS DATE) AS from_day, CAST(max(sold_at) AS DATE) AS to_day FROM o GROUP BY 1), c AS (SELECT *, CAST(unnest(generate_series(from_day, to_day - 1, INTERVAL 30 DAY)) AS DATE) AS chunk_from FROM g)
SELECT *, least(chunk_from + 30, to_day) AS chunk_to FROM c""")
def fn_chunk_windows(spark, d):
    spans = orders(spark, d).groupBy("account_code").agg(F.to_date(F.min("sold_at")).alias("from_day"), F.to_date(F.max("sold_at")).alias("to_day"))
    return ing.chunk_windows(spans, 30)


CHUNKS = ", ch AS (SELECT account_code AS run_id, CAST(date_trunc('month', sold_at) AS DATE) AS chunk_from, CASE month(min(sold_at)) WHEN 3 THEN 'FAILED' WHEN 6 THEN 'RUNNING' ELSE 'COMPLETED' END AS status, count(*) AS processed FROM o GROUP BY 1, 2)"


def _chunks(spark, d):
    by = orders(spark, d).groupBy(F.col("account_code").alias("run_id"), F.to_date(F.date_trunc("month", "sold_at")).alias("chunk_from")).agg(F.count("*").alias("processed"))
    month = F.month("chunk_from")
    return by.withColumn("status", F.when(month == 3, "FAILED").when(month == 6, "RUNNING").otherwise("COMPLETED")).withColumn("next_offset", F.when(month == 6, F.col("processed")))


@R.add("agg_run_rollup", f"{CHUNKS} SELECT run_id, count(*) AS chunks, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, CAST(sum(processed) AS BIGINT) AS processed, bool_and(status = 'COMPLETED') AS complete FROM ch GROUP BY 1")
def agg_run_rollup(spark, d):
    return ing.run_rollup(_chunks(spark, d))


@R.add("st_checkpoint_resume", f"{CHUNKS} SELECT run_id, chunk_from, CASE WHEN status = 'RUNNING' THEN processed ELSE 0 END AS next_offset FROM ch WHERE status <> 'COMPLETED'")
def st_checkpoint_resume(spark, d):
    return ing.pending_chunks(_chunks(spark, d))


@R.add("fn_sync_start", "SELECT account_code, max(sold_at) - INTERVAL 2 HOUR AS start FROM o GROUP BY 1")
def fn_sync_start(spark, d):
    none = F.lit(None).cast("timestamp")
    last = orders(spark, d).groupBy("account_code").agg(F.max("sold_at").alias("last"))
    return last.select("account_code", ing.sync_start(F.col("last"), none, F.lit("2002-01-01").cast("timestamp")).cast("timestamp_ntz").alias("start"))


def _keys(spark, d):
    return orders(spark, d).select("order_id", F.col("order_id").cast("string").alias("k"), F.lpad((F.col("order_id") % 100).cast("string"), 2, "0").alias("c"), "sold_at", "gross_amount")


NUMBER = "CAST(order_id + CAST(order_id % 100 AS DECIMAL(20,4)) / 100 AS DECIMAL(20,4))"


@R.add("fn_parse_brl", f"SELECT order_id, CAST(CASE WHEN order_id % 3 = 0 THEN -{NUMBER} ELSE {NUMBER} END AS DECIMAL(20,4)) AS value FROM o")
def fn_parse_brl(spark, d):
    text = F.when(F.col("order_id") % 3 == 0, F.concat(F.lit("(R$ "), "k", F.lit(","), "c", F.lit(")"))).otherwise(F.concat(F.lit("R$ "), "k", F.lit(","), "c"))
    return _keys(spark, d).select("order_id", s.parse_brl(text).alias("value"))


@R.add("fn_rate_parse", "SELECT order_id, CAST(CAST(order_id % 100 AS DECIMAL(20,10)) / 1000 AS DECIMAL(20,10)) AS rate FROM o")
def fn_rate_parse(spark, d):
    tenth = F.concat(F.floor(F.col("order_id") % 100 / 10).cast("string"), F.lit(","), (F.col("order_id") % 10).cast("string"), F.lit("%"))
    return _keys(spark, d).select("order_id", s.parse_rate(tenth).alias("rate"))


@R.add("fn_parse_date", "SELECT order_id, CAST(sold_at AS DATE) AS day FROM o")
def fn_parse_date(spark, d):
    return _keys(spark, d).select("order_id", s.parse_day(F.date_format("sold_at", "yyyy-MM-dd")).alias("day"))


@R.add("fn_parse_sale_date", "SELECT order_id, CASE WHEN order_id % 2 = 0 THEN CAST(sold_at AS DATE) END AS day FROM o")
def fn_parse_sale_date(spark, d):
    text = F.when(F.col("order_id") % 2 == 0, F.date_format("sold_at", "dd/MM/yyyy")).otherwise(F.date_format("sold_at", "dd/MM/yy"))
    return _keys(spark, d).select("order_id", s.parse_sale_day(text).alias("day"))


# Notes with contacts made of the order's number: forms by turns, and numbers that are none.
CONTACTS = ["mail k{a}.x+y@shop-{a}.example.com", "cpf {a}.456.789-09", "cpf {a} 456 789 09", "cpf {a}-456-789-09", "cnpj 12.{a}.678/0001-95", "cnpj 12 {a} 678000195", "fone +55 11 9{b}-5678", "fone (11) {b}-5678", "fone 9{b} 5678", "nota {a}-{b}-1", "valor {a},{b} {a}"]
_NOTE = "CASE " + " ".join(f"WHEN order_id % {len(CONTACTS)} = {i} THEN '" + t.replace("{a}", "' || CAST(100 + order_id % 900 AS VARCHAR) || '").replace("{b}", "' || CAST(1000 + order_id % 9000 AS VARCHAR) || '") + "'" for i, t in enumerate(CONTACTS)) + " END"
_REDACTED = _NOTE
for _p in s.SENSITIVE:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p}', '[REDACTED]', 'g')"


@R.add("fn_redact", f"SELECT order_id, {_REDACTED} AS note FROM o")
def fn_redact(spark, d):
    k = F.col("order_id")
    number = {"a": (100 + k % 900).cast("string"), "b": (1000 + k % 9000).cast("string")}
    note = F.lit(None).cast("string")
    for i, text in enumerate(CONTACTS):
        note = F.when(k % len(CONTACTS) == i, F.concat(*(number[x] if x in number else F.lit(x) for x in re.split(r"[{}]", text)))).otherwise(note)
    return _keys(spark, d).select("order_id", s.redact(note).alias("note"))


@R.add("fn_identity_key", "SELECT order_id, account_code || '|' || CASE WHEN order_id % 2 = 0 THEN CAST(order_id AS VARCHAR) ELSE '' END AS identity FROM o")
def fn_identity_key(spark, d):
    return orders(spark, d).select("order_id", s.identity_key("account_code", F.when(F.col("order_id") % 2 == 0, F.col("order_id"))).alias("identity"))


@R.add("prj_account_ordinal", "SELECT order_id, CASE account_code WHEN 'C1' THEN 1 ELSE 2 END AS ordinal FROM o")
def prj_account_ordinal(spark, d):
    name = F.concat(F.col("account_code"), F.lit(" "))
    return orders(spark, d).select("order_id", F.regexp_extract(name, r"(\d+)\s*$", 1).try_cast("int").alias("ordinal"))


@R.add("fn_resolve_period", f"SELECT account_code, days, CAST(day + 1 - days AS DATE) AS first_day, CAST(day + 1 AS DATE) AS end_day FROM (SELECT account_code, max(CAST({local('sold_at')} AS DATE)) AS day FROM o GROUP BY 1), (SELECT unnest([30, 60, 90]) AS days)")
def fn_resolve_period(spark, d):
    """The periods that end with each account's last day with an order."""
    last = orders(spark, d).groupBy("account_code").agg(F.max(s.local_day("sold_at")).alias("day"))
    rows = last.select("account_code", "day", F.explode(F.array(*(F.lit(n) for n in (30, 60, 90)))).alias("days"))
    return rows.select("account_code", "days", F.date_sub(F.date_add("day", 1), F.col("days")).alias("first_day"), F.date_add("day", 1).alias("end_day"))


@R.add("fn_money", "SELECT order_id, CAST(CAST((CAST(gross_amount * 100 AS HUGEINT) + 4) // 8 AS DECIMAL(30,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(38,2)) AS amount FROM o")
def fn_money(spark, d):
    return _keys(spark, d).select("order_id", s.money(F.col("gross_amount") / 8).alias("amount"))


def _identities(spark, d):
    """Codes of products with their validity: the older code of each even product has ended."""
    k = F.col("p_partkey")
    part = spark.read.parquet(f"{d}/part.parquet")
    both = F.explode(F.when(k % 2 == 0, F.array(F.lit("old"), F.lit("new"))).otherwise(F.array(F.lit("new")))).alias("kind")
    rows = part.select(k.alias("product_id"), "p_size", both)
    ended = F.when(F.col("kind") == "old", F.lit("2000-01-01").cast("date"))
    return rows.select("product_id", F.concat_ws("-", "kind", "product_id").alias("code"), ended.alias("valid_to"), "p_size")


@R.add("flt_current_scd2", "SELECT p_partkey AS product_id, 'new-' || CAST(p_partkey AS VARCHAR) AS code FROM part")
def flt_current_scd2(spark, d):
    return s.current(_identities(spark, d)).select("product_id", "code")


@R.add("snk_migration_coalesce", "SELECT order_id, sellable_id, CASE WHEN listing_id % 3 <> 0 THEN listing_id ELSE sellable_id END AS listing_id FROM i")
def snk_migration_coalesce(spark, d):
    lines = items(spark, d).select("order_id", "sellable_id", F.col("listing_id").alias("linked_id"))
    catalog = spark.read.parquet(f"{d}/part.parquet").where(F.col("p_partkey") % 3 != 0).select(F.col("p_partkey").alias("listing_id"))
    rows = lines.join(catalog, F.col("linked_id") == F.col("listing_id"), "left")
    return rows.select("order_id", "sellable_id", F.coalesce("listing_id", "sellable_id").alias("listing_id"))


@R.add("snk_migration_backfill", "SELECT DISTINCT product_id, listing_id, CASE WHEN sellable_id <> listing_id THEN sellable_id END AS variation_id, account_code FROM i JOIN o USING (order_id) WHERE product_id IS NOT NULL")
def snk_migration_backfill(spark, d):
    rows = items(spark, d).where(F.col("product_id").isNotNull()).join(orders(spark, d), "order_id")
    variation = F.when(F.col("sellable_id") != F.col("listing_id"), F.col("sellable_id")).alias("variation_id")
    return rows.select("product_id", "listing_id", variation, "account_code").distinct()


@R.add("src_visits_api", "SELECT CASE WHEN user_id % 2 = 0 THEN 'C1' ELSE 'C2' END AS account_code, count(*) AS visits FROM events WHERE event_type = 'view' AND CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1")
def src_visits_api(spark, d):
    start = F.lit("2024-01-10").cast("timestamp_ntz")
    day = landing.within(spark.read.parquet(f"{d}/events.parquet"), "ts", start, start + F.expr("INTERVAL 1 DAY")).where(F.col("event_type") == "view")
    return day.groupBy(F.when(F.col("user_id") % 2 == 0, "C1").otherwise("C2").alias("account_code")).agg(F.count("*").alias("visits"))


@R.add("fn_money4", "SELECT order_id, CAST(CAST((CAST(gross_amount * 10000 AS HUGEINT) + 4) // 8 AS DECIMAL(30,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(38,4)) AS amount FROM o")
def fn_money4(spark, d):
    return _keys(spark, d).select("order_id", F.round(F.col("gross_amount") / 8, 4).cast("decimal(38,4)").alias("amount"))


@R.add("fn_decimal10", "SELECT order_id, CASE WHEN order_id % 1000 = 0 THEN '0' ELSE regexp_replace(CAST(CAST(order_id % 1000 AS DECIMAL(20,10)) / 8 AS DECIMAL(20,10))::VARCHAR, '\\.?0+$', '') END AS text FROM o")
def fn_decimal10(spark, d):
    value = ((F.col("order_id") % 1000).cast("decimal(20,10)") / 8).cast("decimal(30,10)")
    return _keys(spark, d).withColumn("v", value).select("order_id", canonical_decimal("v").alias("text"))


@R.add("fn_title_primary", """, nm AS (SELECT p_partkey AS k, unnest(CASE p_partkey % 3 WHEN 0 THEN [' ' || p_brand, p_type || ' ', p_brand, ' '] WHEN 1 THEN [p_brand, p_brand || ' '] ELSE ['', NULL] END) AS name, unnest([1, 2, 3, 4]) AS place FROM part), tn AS (SELECT k, trim(name) AS name, place FROM nm WHERE trim(name) <> '')
SELECT p_partkey AS listing_id, arg_min(name, place) || CASE WHEN count(DISTINCT name) > 1 THEN ' (+' || CAST(count(DISTINCT name) - 1 AS VARCHAR) || ' componentes)' ELSE '' END AS title FROM part LEFT JOIN tn ON k = p_partkey GROUP BY 1""")
def fn_title_primary(spark, d):
    k, blank = F.col("p_partkey"), F.lit(" ")
    names = (
        F.when(k % 3 == 0, F.array(F.concat(blank, "p_brand"), F.concat("p_type", blank), F.col("p_brand"), blank))
        .when(k % 3 == 1, F.array(F.col("p_brand"), F.concat("p_brand", blank))).otherwise(F.array(F.lit(""), F.lit(None).cast("string")))
    )
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("listing_id"), s.primary_title(names).alias("title"))


@R.add("fn_staleness", "SELECT order_id, order_id % 4 = 0 OR order_id % 30 > 10 AS stale FROM o")
def fn_staleness(spark, d):
    now = F.lit("2001-08-01 00:30:00").cast("timestamp")
    made = F.when(F.col("order_id") % 4 == 0, "broken").otherwise((now - F.make_interval(mins=(F.col("order_id") % 30).cast("int"))).cast("string"))
    return _keys(spark, d).select("order_id", s.is_stale(made, now).alias("stale"))


QUERIES, ORACLES = R.queries, R.sql
