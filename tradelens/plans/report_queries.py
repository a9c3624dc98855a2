"""Queries on whole reports: operations beside noted values, facts of a comparison, replays, snapshots, backfills, catalog audits."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..binding import daily_metrics, items, orders
from ..functions.scalars import local_midnight
from ..operators import finance as fin
from ..operators import ingest as ing
from ..operators import matching as mt
from ..operators import metrics as m
from ..shared import checkpoint_folder, settle
from ..sources import landing
from ..sources.sinks import write_snapshots, write_upsert
from ..streaming.orders import STATE_STORE, changed_states, current_orders, landed_orders, sync_orders
from ..streaming.pages import LandedPages, land_pages
from ..streaming.tables import KeyedTable
from .base import Queries, local
from .ingest_queries import _catalog, _payloads
from .matching_queries import DIGEST, ERP_LABELS, FLAGS, VIEW, _views
from .metric_queries import LONG, SUMMARY, VOID

R = Queries()
OPS_DAY = "2001-07-10"

OPS = f"""{VIEW}{FLAGS}, od AS (SELECT m.*, fl.is_full, u.units FROM m LEFT JOIN fl USING (order_id) LEFT JOIN (SELECT CAST(order_id AS VARCHAR) AS order_id, sum(quantity) AS units FROM i GROUP BY 1) u USING (order_id) WHERE CAST({local('sold_at')} AS DATE) = DATE '{OPS_DAY}'),
oa AS (SELECT account_code, sum(gross_amount) AS gross, count(*) AS n, coalesce(sum(units), 0) AS units, count(*) FILTER (is_full IS NULL) AS unknown, coalesce(sum(gross_amount) FILTER (is_full), 0) AS full_gross, count(*) FILTER (is_full) AS full_n, coalesce(sum(units) FILTER (is_full), 0) AS full_units FROM od GROUP BY 1),
vi AS (SELECT account_code, max(visits) AS visits FROM dm WHERE day = DATE '2024-01-10' AND account_code = 'C1' GROUP BY 1),
mt AS (SELECT account_code, unnest(['orders.gross_amount', 'orders.count', 'orders.units', 'fulfillment.gross_amount', 'fulfillment.orders', 'fulfillment.units', 'visits']) AS metric,
  unnest([CAST(gross AS DECIMAL(38,2)), CAST(n AS DECIMAL(38,2)), CAST(units AS DECIMAL(38,2)), CAST(CASE WHEN unknown = 0 THEN full_gross END AS DECIMAL(38,2)), CAST(CASE WHEN unknown = 0 THEN full_n END AS DECIMAL(38,2)), CAST(CASE WHEN unknown = 0 THEN full_units END AS DECIMAL(38,2)), CAST(visits AS DECIMAL(38,2))]) AS calculated FROM oa LEFT JOIN vi USING (account_code)),
rf AS (SELECT account_code, metric, value FROM (VALUES ('C1', 'gross', CAST(1250.5 AS DECIMAL(14,2))), ('C1', 'sales_count', CAST(12 AS DECIMAL(14,2))), ('C2', 'ticket', CAST(88.25 AS DECIMAL(14,2)))) v(account_code, metric, value))"""
NOTED_SQL = ", ".join(f"('{x}')" for x in m.NOTED)


@R.add("rm_ops_reconciliation", f"{OPS} SELECT account_code, metric, calculated, CAST(NULL AS DECIMAL(38,2)) AS reference, 'OPERATIONAL_DIAGNOSTIC' AS status FROM mt UNION ALL SELECT account_code, 'noted.' || n.metric, NULL, CAST(value AS DECIMAL(38,2)), CASE WHEN value IS NULL THEN 'NO_REFERENCE' ELSE 'SELLER_BI_REFERENCE' END FROM oa CROSS JOIN (VALUES {NOTED_SQL}) n(metric) LEFT JOIN rf USING (account_code, metric)")
def rm_ops_reconciliation(spark, d):
    """One civil day; the visits of C2 could not be looked up, and few values were noted."""
    base, _, ships, _ = _views(spark, d)
    day = F.to_date(F.lit(OPS_DAY))
    own = base.where((F.col("sold_at") >= local_midnight(day)) & (F.col("sold_at") < local_midnight(F.date_add(day, 1))))
    lines = items(spark, d, own.select(F.col("k").alias("order_id"))).withColumn("order_id", F.col("order_id").cast("string"))
    visits = daily_metrics(spark, d).where("day = DATE '2024-01-10' AND account_code = 'C1'").select("account_code", "visits")
    noted = spark.createDataFrame([("C1", "gross", "1250.5"), ("C1", "sales_count", "12"), ("C2", "ticket", "88.25")], "account_code string, metric string, value string").withColumn("value", F.col("value").cast("decimal(14,2)"))
    return m.operations_report(own, lines, mt.shipment_flags(base, ships), visits, noted)


# Values of a day as it is stored: events are moved to the last days of the orders; margins need every order's cost.
DAY_METRICS = f"""{VIEW}{FLAGS}{SUMMARY}, fo AS (SELECT m.k, m.account_code, CAST({local('m.sold_at')} AS DATE) AS day, fl.is_full, m.gross_amount, o.status FROM m JOIN fl USING (order_id) JOIN o ON o.order_id = m.k),
fd AS (SELECT fo.account_code, fo.day, count(*) FILTER (is_full IS NULL) = 0 AS known, count(*) FILTER (is_full AND NOT {VOID}) AS n, coalesce(sum(gross_amount) FILTER (is_full AND NOT {VOID}), 0) AS gross, coalesce(sum(units) FILTER (is_full AND NOT {VOID}), 0) AS units,
  CASE WHEN count(*) FILTER (k % 97 = 0) = 0 THEN sum(k % 100) END AS margin, sum(gross_amount) AS base FROM fo LEFT JOIN (SELECT order_id, sum(quantity) AS units FROM i GROUP BY 1) u ON u.order_id = fo.k GROUP BY 1, 2),
vd AS (SELECT account_code, day - 8217 AS day, visits FROM dm),
dd AS (SELECT oa.account_code, oa.day, kept_orders, coalesce(ia.units, 0) AS units, kept_gross, fd.*  EXCLUDE (account_code, day, units), fd.units AS full_units, visits FROM oa LEFT JOIN ia USING (account_code, day) JOIN fd USING (account_code, day) LEFT JOIN vd USING (account_code, day)),
dv AS (SELECT account_code, day, unnest(['salesCount', 'unitsSold', 'grossSales', 'marginRate', 'fullSalesCount', 'fullUnitsSold', 'fullGrossSales', 'visits', 'averageTicket', 'conversionRate']) AS name,
  unnest([CAST(kept_orders AS DECIMAL(30,10)), CAST(units AS DECIMAL(30,10)), CAST(kept_gross AS DECIMAL(30,10)),
    CASE WHEN base > 0 THEN CAST(CAST((2 * CAST(margin AS HUGEINT) * 100000000000000 + CAST(base * 100 AS HUGEINT)) // (2 * CAST(base * 100 AS HUGEINT)) AS DECIMAL(28,0)) * CAST(0.0000000001 AS DECIMAL(10,10)) AS DECIMAL(30,10)) END,
    CAST(CASE WHEN known THEN n END AS DECIMAL(30,10)), CAST(CASE WHEN known THEN full_units END AS DECIMAL(30,10)), CAST(CASE WHEN known THEN gross END AS DECIMAL(30,10)), CAST(visits AS DECIMAL(30,10)),
    CASE WHEN kept_orders > 0 THEN CAST(CAST((2 * CAST(kept_gross * 100 AS HUGEINT) + kept_orders) // (2 * kept_orders) AS DECIMAL(28,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(30,10)) END,
    CASE WHEN visits > 0 THEN CAST(CAST((2 * CAST(kept_orders AS HUGEINT) * 1000000000000 + visits) // (2 * visits) AS DECIMAL(28,0)) * CAST(0.0000000001 AS DECIMAL(10,10)) AS DECIMAL(30,10)) END]) AS value FROM dd)"""


@R.add("pl_persist", f"{DAY_METRICS} SELECT *, CASE WHEN value IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS status FROM dv")
def pl_persist(spark, d):
    """Visits are known for the last days only; a failed shipment lookup leaves fulfilment unknown, an order without cost the margin."""
    base, _, ships, _ = _views(spark, d)
    lines = items(spark, d).withColumn("order_id", F.col("order_id").cast("string"))
    visits = daily_metrics(spark, d).select("account_code", F.date_sub("day", 8217).alias("day"), "visits")
    costs = base.select("order_id", F.when(F.col("k") % 97 != 0, F.col("k") % 100).cast("decimal(14,2)").alias("margin"))
    return m.day_snapshot(base, lines, mt.shipment_flags(base, ships), costs, visits)


FACTS = f"""{LONG}, pm AS (SELECT account_code, name AS metric, sum(value) FILTER (day >= DATE '2024-01-15') AS now, sum(value) FILTER (day < DATE '2024-01-15') AS before FROM lg WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-24' GROUP BY 1, 2),
ch AS (SELECT *, CASE WHEN before <> 0 THEN sign(now - before) * round(abs((now - before) * 100 / before), 6) END AS change FROM (SELECT account_code, metric, CAST(now AS DOUBLE) AS now, CAST(before AS DOUBLE) AS before FROM pm)),
hi AS (SELECT metric, max(now) AS high, min(now) AS low, arg_max(account_code, now) AS account_code FROM ch WHERE metric IN ('gross', 'ticket', 'visits') GROUP BY 1 HAVING count(now) = count(*) AND count(*) > 1)"""


@R.add("fn_comparison_facts", f"{FACTS} SELECT 'HIGHEST' AS fact, CASE WHEN high = low THEN 'TIE' ELSE account_code END AS account_code, metric, high AS value FROM hi UNION ALL (SELECT 'GROWTH', account_code, metric, change FROM (SELECT * FROM ch WHERE metric = 'gross' AND change IS NOT NULL ORDER BY change DESC, account_code, metric LIMIT 1) WHERE change > 0) UNION ALL (SELECT 'DROP', account_code, metric, change FROM ch WHERE change < 0 ORDER BY change, account_code, metric LIMIT 1)")
def fn_comparison_facts(spark, d):
    day, value = F.col("day"), F.col("value")
    rows = m.snapshot(daily_metrics(spark, d)).where(day.between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-24").cast("date")))
    cut = F.lit("2024-01-15").cast("date")
    periods = rows.groupBy("account_code", F.col("name").alias("metric")).agg(F.sum(F.when(day >= cut, value)).cast("decimal(20,4)").alias("now"), F.sum(F.when(day < cut, value)).cast("decimal(16,4)").alias("before"))
    return m.comparison_facts(periods, ("gross", "ticket", "visits"), "gross")


def _replaced(spark, d):
    """Snapshots stored for odd days with one metric more, and new ones for every third day."""
    long, n = m.snapshot(daily_metrics(spark, d)), F.dayofmonth("day")
    extra = long.where("name = 'visits'").withColumn("name", F.lit("dropped"))
    return ing.replace_whole(long.unionByName(extra).where(n % 2 == 1), long.where(n % 3 == 0).withColumn("value", (F.col("value") + 1).cast("decimal(30,10)")), ["account_code", "day"])


OLD_NEW = f"{LONG}, old AS (SELECT * FROM (SELECT * FROM lg UNION ALL SELECT account_code, day, 'dropped', value FROM lg WHERE name = 'visits') WHERE day(day) % 2 = 1), new AS (SELECT account_code, day, name, CAST(value + 1 AS DECIMAL(30,10)) AS value FROM lg WHERE day(day) % 3 = 0)"


@R.add("snk_snapshot_upsert", f"{OLD_NEW} SELECT * FROM old ANTI JOIN (SELECT DISTINCT account_code, day FROM new) USING (account_code, day) UNION ALL SELECT * FROM new")
def snk_snapshot_upsert(spark, d):
    """Written by partition, the second run twice, and read back."""
    long, n = m.snapshot(daily_metrics(spark, d)), F.dayofmonth("day")
    extra = long.where("name = 'visits'").withColumn("name", F.lit("dropped"))
    path = f"{checkpoint_folder(spark)}/snapshots-{uuid.uuid4()}"
    write_snapshots(long.unionByName(extra).where(n % 2 == 1), path, "run-1")
    new = long.where(n % 3 == 0).withColumn("value", (F.col("value") + 1).cast("decimal(30,10)"))
    for _ in range(2):
        write_snapshots(new, path, "run-2")
    return spark.read.schema(long.schema).parquet(path).select("account_code", "day", "name", "value")


@R.add("snk_snapshot_actions", f"{OLD_NEW} SELECT n.account_code, n.day, CASE WHEN o.day IS NULL THEN 'CREATED' ELSE 'UPDATED' END AS action FROM (SELECT DISTINCT account_code, day FROM new) n LEFT JOIN (SELECT DISTINCT account_code, day FROM old) o USING (account_code, day)")
def snk_snapshot_actions(spark, d):
    return _replaced(spark, d)[1]


SHARED = """, cv AS (SELECT p_partkey AS k, unnest(CASE p_partkey % 3 WHEN 0 THEN [1, 2] WHEN 1 THEN [1] ELSE [NULL] END) AS n FROM part),
ct AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'C1' ELSE 'C2' END AS account_code, CAST(k AS VARCHAR) AS listing_id, CAST(k AS VARCHAR) || '-' || CAST(n AS VARCHAR) AS variation_id,
  CASE WHEN k % 4 = n THEN 'V' || CAST((k // 4) % 40 AS VARCHAR) WHEN k % 2 = 0 THEN 'I' || CAST((k // 4) % 40 AS VARCHAR) END AS sku, CASE WHEN k % 4 = n THEN 'variation' WHEN k % 2 = 0 THEN 'item' ELSE 'none' END AS sku_source FROM cv)"""


def _shared(spark, d):
    """Catalog rows of both accounts whose SKUs stand in many listings."""
    rows = landing.catalog_rows(_catalog(spark, d, skus=40))
    return rows.withColumn("account_code", F.when(F.col("listing_id").cast("long") % 2 == 0, "C1").otherwise("C2"))


@R.add("agg_catalog_audit", f"{SHARED} SELECT account_code, count(DISTINCT listing_id) AS listings, count(*) AS listing_items, count(*) FILTER (sku_source = 'item') AS sku_via_item, count(*) FILTER (sku_source = 'variation') AS sku_via_variation, count(*) FILTER (sku IS NULL) AS without_sku, count(DISTINCT sku) AS distinct_skus, count(DISTINCT CASE WHEN variation_id IS NOT NULL THEN listing_id END) AS with_variations FROM ct GROUP BY 1")
def agg_catalog_audit(spark, d):
    source = F.col("sku_source")
    return _shared(spark, d).groupBy("account_code").agg(
        F.countDistinct("listing_id").alias("listings"), F.count("*").alias("listing_items"), F.count_if(source == "item").alias("sku_via_item"), F.count_if(source == "variation").alias("sku_via_variation"),
        F.count_if(F.col("sku").isNull()).alias("without_sku"), F.countDistinct("sku").alias("distinct_skus"), F.countDistinct(F.when(F.col("variation_id").isNotNull(), F.col("listing_id"))).alias("with_variations"),
    )


@R.add("agg_catalog_duplicates", f"{SHARED} SELECT account_code, sku, listing_id, coalesce(variation_id, listing_id) AS sellable_id, n AS occurrences FROM ct JOIN (SELECT account_code, sku, count(*) AS n FROM ct WHERE sku IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) USING (account_code, sku)")
def agg_catalog_duplicates(spark, d):
    """Every association of a SKU that an account uses more than once: rows, not lists, however many there are."""
    rows = _shared(spark, d).where("sku is not null")
    often = rows.groupBy("account_code", "sku").agg(F.count("*").alias("occurrences")).where("occurrences > 1")
    return rows.join(often, ["account_code", "sku"]).select("account_code", "sku", "listing_id", F.coalesce("variation_id", "listing_id").alias("sellable_id"), "occurrences")


@R.add("set_sku_distribution", f"{SHARED}, a AS (SELECT DISTINCT sku FROM ct WHERE account_code = 'C1' AND sku IS NOT NULL), b AS (SELECT DISTINCT sku FROM ct WHERE account_code = 'C2' AND sku IS NOT NULL) SELECT CASE WHEN b.sku IS NULL THEN 'ONLY_C1' WHEN a.sku IS NULL THEN 'ONLY_C2' ELSE 'BOTH' END AS kind, count(*) AS skus FROM a FULL JOIN b USING (sku) GROUP BY 1")
def set_sku_distribution(spark, d):
    by = _shared(spark, d).where("sku is not null").groupBy("sku").agg(F.bool_or(F.col("account_code") == "C1").alias("one"), F.bool_or(F.col("account_code") == "C2").alias("two"))
    kind = F.when(~F.col("two"), "ONLY_C1").when(~F.col("one"), "ONLY_C2").otherwise("BOTH")
    return by.groupBy(kind.alias("kind")).agg(F.count("*").alias("skus"))


@R.add("snk_catalog_upsert", f"{SHARED} SELECT listing_id, coalesce(variation_id, '-') AS variation_id, CASE WHEN k % 5 < 3 THEN sku ELSE 'OLD' END AS sku, CASE WHEN k % 5 > 0 THEN k % 7 END AS product_id FROM ct")
def snk_catalog_upsert(spark, d):
    """Stored rows (but every fifth listing) and a batch of three fifths; links to products stay."""
    k = F.col("listing_id").cast("long")
    rows = _shared(spark, d).select("listing_id", F.coalesce("variation_id", F.lit("-")).alias("variation_id"), "sku")
    old = rows.where(k % 5 != 0).withColumn("sku", F.lit("OLD")).withColumn("product_id", k % 7)
    new = rows.where(k % 5 < 3).withColumn("product_id", F.lit(None).cast("long"))
    path = f"{checkpoint_folder(spark)}/catalog-{uuid.uuid4()}"
    write_upsert(old, path, "run-1", ["listing_id", "variation_id"], buckets=8)
    for _ in range(2):
        write_upsert(new, path, "run-2", ["listing_id", "variation_id"], keep=("product_id",), buckets=8)
    return spark.read.schema(old.schema).parquet(path).select(*old.columns)


def _late(spark, d):
    """Stored orders, all but every tenth, still PENDING; all orders landed twice, the second time with their state."""
    o = orders(spark, d).select("order_id", "status", "gross_amount", "sold_at")
    pending = o.withColumn("status", F.lit("PENDING"))
    landed = pending.withColumn("arrived_at", F.lit(1)).unionByName(o.withColumn("arrived_at", F.lit(2)))
    return pending.where("order_id % 10 <> 0"), landed


def _replay_sql(days: int) -> str:
    inside = f"sold_at >= TIMESTAMP '2001-07-20' - INTERVAL {days} DAYS AND sold_at < TIMESTAMP '2001-07-20'"
    return f"SELECT order_id, CASE WHEN {inside} THEN status ELSE 'PENDING' END AS status FROM o WHERE order_id % 10 <> 0 OR ({inside})"


@R.add("st_daily", _replay_sql(7))
def st_daily(spark, d):
    return ing.replay(*_late(spark, d), "daily", F.lit("2001-07-20").cast("timestamp")).select("order_id", "status")


@R.add("st_weekly", _replay_sql(90))
def st_weekly(spark, d):
    return ing.replay(*_late(spark, d), "weekly", F.lit("2001-07-20").cast("timestamp")).select("order_id", "status")


@R.add("st_incremental_sync", "SELECT CAST(order_id AS VARCHAR) AS order_id, CASE WHEN order_id % 2 = 0 THEN 'CANCELLED' ELSE CASE order_id % 5 WHEN 0 THEN 'PROCESSING' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'PAID' WHEN 3 THEN 'CANCELLED' ELSE 'UNKNOWN' END END AS status, CAST(gross_amount AS DECIMAL(14,2)) AS gross_amount FROM o WHERE order_id IN (SELECT order_id FROM i)")
def st_incremental_sync(spark, d):
    """Payloads land as files, the even orders a second time and cancelled; the stream puts each over the stored orders."""
    folder = f"{checkpoint_folder(spark)}/orders-{uuid.uuid4()}"
    at = lambda x: F.lit(x).cast("timestamp").alias("arrived_at")

    def land(rows):
        rows.write.mode("append").option("compression", "gzip").json(f"{folder}/landed")
        sync_orders(landed_orders(spark, f"{folder}/landed"), f"{folder}/table", f"{folder}/marks").awaitTermination()

    land(_payloads(spark, d).select("payload", at("2001-08-01 00:00:00")))
    landed = spark.read.schema("payload string").json(f"{folder}/landed").where(F.get_json_object("payload", "$.id").cast("long") % 2 == 0)
    land(landed.select(F.regexp_replace("payload", '"status":"[a-z_]*"', '"status":"cancelled"').alias("payload"), at("2001-08-01 00:10:00")))
    return current_orders(spark, f"{folder}/table", ["order_id", "status", "gross_amount"])


@R.add("src_landed_pages", "SELECT strftime(sold_at, '%Y-%m') AS chunk, CAST(row_number() OVER (PARTITION BY strftime(sold_at, '%Y-%m') ORDER BY order_id) - 1 AS BIGINT) AS position, CAST(order_id AS VARCHAR) AS payload FROM o")
def src_landed_pages(spark, d):
    """Months of orders land as pages of 50; a page of the middle month lands last, and the stream waits for it."""
    spark.dataSource.register(LandedPages)
    folder = f"{checkpoint_folder(spark)}/pages-{uuid.uuid4()}"
    rows = orders(spark, d).select(F.date_format("sold_at", "yyyy-MM").alias("chunk"), "order_id")
    place = F.row_number().over(Window.partitionBy("chunk").orderBy("order_id")) - 1
    rows = rows.withColumns({"place": place, "total": F.count("*").over(Window.partitionBy("chunk"))})
    pages = rows.groupBy("chunk", "total", (F.floor(F.col("place") / 50) * 50).alias("page_offset")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "order_id"))), lambda r: r["order_id"].cast("string")).alias("results"))
    pages = settle(pages.withColumn("page_limit", F.lit(50)))
    late = (F.col("chunk") == "1998-06") & (F.col("page_offset") == 50)
    for part in (pages.where(~late), pages.where(late)):
        land_pages(part, f"{folder}/landed")
        stream = spark.readStream.format("landed_pages").load(f"{folder}/landed")
        stream.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("chunk string, position long, payload string").parquet(f"{folder}/table")


@R.add("st_dedup_stream", "SELECT CAST(order_id AS VARCHAR) AS order_id, CASE WHEN order_id % 2 = 0 THEN status ELSE 'PENDING' END AS status FROM o")
def st_dedup_stream(spark, d):
    """All orders arrive PENDING, half of them again with their state; keyed state tells what changed, and the changes are kept."""
    folder = f"{checkpoint_folder(spark)}/states-{uuid.uuid4()}"
    o = orders(spark, d).select(F.col("order_id").cast("string").alias("order_id"), "status")
    at = lambda x: F.lit(x).cast("timestamp").alias("arrived_at")
    first, second = o.select("order_id", F.lit("PENDING").alias("status"), at("2026-01-01")), o.where("CAST(order_id AS BIGINT) % 2 = 0").select("*", at("2026-01-02"))

    def keep(batch, number):
        KeyedTable(batch.sparkSession, f"{folder}/table", ["order_id"], ["order_id"]).append(batch, number)

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        for rows in (first, second):
            rows.write.mode("append").parquet(f"{folder}/landed")
            stream = changed_states(spark.readStream.schema(first.schema).parquet(f"{folder}/landed"))
            stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return KeyedTable(spark, f"{folder}/table", ["order_id"], ["order_id"]).read()


RUN = f"""{DIGEST}, st AS (SELECT sold_on, CASE WHEN day(sold_on) % 5 = 2 THEN 'stale' WHEN day(sold_on) % 5 > 2 THEN sha256 END AS daily_sha256 FROM dg WHERE day(sold_on) % 5 <> 0),
dt AS (SELECT sold_on, CAST(sum(margin) AS DECIMAL(38,2)) AS margin, CAST(sum(total_products) AS DECIMAL(38,2)) AS products FROM fr GROUP BY 1),
ac AS (SELECT dg.sold_on, dg.sha256, st.sold_on IS NOT NULL AS stored, st.daily_sha256, day(dg.sold_on) % 3 <> 0 AS answered, CASE WHEN dg.sold_on >= DATE '2001-07-25' THEN 'CURRENT_DAY_IGNORED' WHEN st.sold_on IS NULL THEN 'FULL_EXTERNAL_PROCESS' WHEN st.daily_sha256 IS NULL THEN 'BLOCKED_LEGACY' WHEN st.daily_sha256 = sha256 THEN 'SKIPPED' ELSE 'LOCAL_REFRESH' END AS action FROM dg LEFT JOIN st USING (sold_on))"""


def _run(spark, d):
    """The plan over report days carried out; sources answer but on each third day of a month."""
    records = _views(spark, d)[3]
    days, n = fin.day_digests(records), F.dayofmonth("sold_on")
    old = days.where(n % 5 != 0).select("sold_on", F.when(n % 5 == 2, "stale").when(n % 5 > 2, F.col("sha256")).alias("daily_sha256"))
    plan = fin.backfill_plan(days, old, F.to_date(F.lit("2001-07-25")))
    sums = records.groupBy("sold_on").agg(*(F.sum(c).cast("decimal(38,2)").alias(k) for c, k in (("margin", "margin"), ("total_products", "products"))))
    report = days.select("sold_on", F.col("sha256").alias("daily_sha256")).join(sums, "sold_on")
    stored = old.withColumns({"margin": F.lit(0).cast("decimal(38,2)"), "products": F.lit(0).cast("decimal(38,2)"), "visits": F.lit(1).cast("long")})
    return fin.backfill(plan, stored, report, days.where(n % 3 != 0).select("sold_on", F.lit(7).cast("long").alias("visits")))


@R.add("pl_backfill_exec", f"{RUN} SELECT sold_on, CASE WHEN action = 'LOCAL_REFRESH' OR (action = 'FULL_EXTERNAL_PROCESS' AND answered) THEN sha256 ELSE daily_sha256 END AS daily_sha256, CASE WHEN action = 'LOCAL_REFRESH' OR (action = 'FULL_EXTERNAL_PROCESS' AND answered) THEN margin ELSE CAST(0 AS DECIMAL(38,2)) END AS margin, CASE WHEN action = 'LOCAL_REFRESH' OR (action = 'FULL_EXTERNAL_PROCESS' AND answered) THEN products ELSE CAST(0 AS DECIMAL(38,2)) END AS products, CAST(CASE WHEN action = 'FULL_EXTERNAL_PROCESS' THEN 7 ELSE 1 END AS BIGINT) AS visits FROM ac JOIN dt USING (sold_on) WHERE stored OR (action = 'FULL_EXTERNAL_PROCESS' AND answered)")
def pl_backfill_exec(spark, d):
    return _run(spark, d)[0]


@R.add("pl_backfill_summary", f"{RUN} SELECT action, CASE action WHEN 'LOCAL_REFRESH' THEN 'UPDATED' WHEN 'FULL_EXTERNAL_PROCESS' THEN CASE WHEN answered THEN 'CREATED' ELSE 'FAILED' END WHEN 'BLOCKED_LEGACY' THEN 'BLOCKED' ELSE 'SKIPPED' END AS outcome, count(*) AS days FROM ac GROUP BY 1, 2")
def pl_backfill_summary(spark, d):
    return _run(spark, d)[1].groupBy("action", "outcome").agg(F.count("*").alias("days"))


LABEL = f"CASE status_code {' '.join(f"WHEN {k} THEN '{v}'" for k, v in ERP_LABELS.items())} ELSE coalesce('DESCONHECIDA_' || CAST(status_code AS VARCHAR), 'DESCONHECIDA') END"


@R.add("agg_erp_status", f"{VIEW} SELECT status_code, {LABEL} AS label, count(*) AS orders, CAST(sum(total) AS DECIMAL(38,2)) AS total FROM erp GROUP BY 1, 2")
def agg_erp_status(spark, d):
    table, code = F.create_map(*(F.lit(x) for kv in ERP_LABELS.items() for x in kv)), F.col("status_code")
    label = F.coalesce(table[code], F.concat(F.lit("DESCONHECIDA_"), code.cast("string")), F.lit("DESCONHECIDA"))
    return mt.erp_totals(_views(spark, d)[1].withColumn("label", label), ["status_code", "label"]).select("status_code", "label", "orders", "total")


@R.add("agg_erp_channel", f"{VIEW} SELECT coalesce(channel_id, '(none)') AS channel, count(*) AS orders FROM (SELECT CASE erp_id % 4 WHEN 0 THEN 'Store 1' WHEN 1 THEN 'Store 2' END AS channel_id FROM erp) GROUP BY 1")
def agg_erp_channel(spark, d):
    k = F.col("erp_id") % 4
    rows = _views(spark, d)[1].select(F.when(k == 0, "Store 1").when(k == 1, "Store 2").alias("channel"))
    return rows.groupBy(F.coalesce("channel", F.lit("(none)")).alias("channel")).agg(F.count("*").alias("orders"))


@R.add("agg_erp_sku", ", sl AS (SELECT CASE WHEN listing_id % 9 <> 0 THEN 'K' || CAST(listing_id % 30 AS VARCHAR) END AS sku, 'name ' || CAST(listing_id AS VARCHAR) AS product, quantity, order_id * 1000000 + listing_id * 100 + sellable_id % 100 AS place FROM i) SELECT coalesce(sku, '-') AS sku, arg_min(product, place) AS product, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units FROM sl GROUP BY 1")
def agg_erp_sku(spark, d):
    k = F.col("listing_id")
    lines = items(spark, d).select(F.when(k % 9 != 0, F.concat(F.lit("K"), (k % 30).cast("string"))).alias("sku"), F.concat(F.lit("name "), k.cast("string")).alias("product"), "quantity", (F.col("order_id") * 1000000 + k * 100 + F.col("sellable_id") % 100).alias("place"))
    return mt.sku_breakdown(lines)


QUERIES, ORACLES = R.queries, R.sql
