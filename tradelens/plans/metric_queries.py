"""Queries on daily sales and seller metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..binding import daily_metrics, items, orders, signed_pct
from ..functions.scalars import local_midnight, money, ratio_percent
from ..operators import metrics as m
from .base import Queries, local
from .listing_queries import ntz

R = Queries()
DAYS = f", od AS (SELECT *, CAST({local('sold_at')} AS DATE) AS day FROM o)"
VOID = "status IN ('CANCELLED', 'REFUNDED')"
SUMMARY = f"""{DAYS}, oa AS (SELECT account_code, day, count(*) AS orders, count(*) FILTER (NOT {VOID}) AS kept_orders, CAST(coalesce(sum(gross_amount) FILTER ({VOID}), 0) AS DECIMAL(38,2)) AS cancelled_gross,
  CAST(coalesce(sum(gross_amount) FILTER (NOT {VOID}), 0) AS DECIMAL(38,2)) AS kept_gross FROM od GROUP BY 1, 2), ia AS (SELECT account_code, day, CAST(sum(quantity) AS BIGINT) AS units FROM i JOIN od USING (order_id) GROUP BY 1, 2)"""


def _half_up(n: str, d: str, digits: int) -> str:
    """SQL for n / d of whole numbers n >= 0, d > 0 with decimals, half up."""
    return f"CAST((2 * CAST({n} AS HUGEINT) * {10**digits} + CAST({d} AS HUGEINT)) // (2 * CAST({d} AS HUGEINT)) AS DECIMAL(38,0)) / {10**digits}"


TICKET = "CASE WHEN sales_count > 0 THEN CAST(CAST((2 * CAST(gross * 100 AS HUGEINT) + sales_count) // (2 * sales_count) AS DECIMAL(30,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(38,2)) END"


@R.add("agg_daily_summary", f"{SUMMARY} SELECT account_code, day, orders, coalesce(units, 0) AS units, kept_orders, cancelled_gross, kept_gross, CAST(CASE WHEN kept_orders = 0 THEN 0 ELSE CAST((2 * CAST(kept_gross * 100 AS HUGEINT) + kept_orders) // (2 * kept_orders) AS DECIMAL(30,0)) * CAST(0.01 AS DECIMAL(3,2)) END AS DECIMAL(38,2)) AS average_ticket FROM oa LEFT JOIN ia USING (account_code, day)")
def agg_daily_summary(spark, d):
    return m.daily_summary(orders(spark, d), items(spark, d))


@R.add("rm_daily_sales", f"{SUMMARY} SELECT account_code, day, orders, coalesce(units, 0) AS units, kept_gross FROM oa LEFT JOIN ia USING (account_code, day) WHERE account_code = 'C1' AND day >= DATE '2001-07-01'")
def rm_daily_sales(spark, d):
    start = local_midnight(F.to_date(F.lit("2001-07-01")))
    own = orders(spark, d).where((F.col("account_code") == "C1") & (F.col("sold_at") >= start))
    return m.daily_summary(own, items(spark, d)).select("account_code", "day", "orders", "units", "kept_gross")


@R.add("agg_single_currency_guard", "SELECT max(currency) AS currency FROM o")
def agg_single_currency_guard(spark, d):
    return m.single_currency(orders(spark, d))


@R.add("agg_status_breakdown", "SELECT status, count(*) AS orders, CAST(sum(gross_amount) AS DECIMAL(38,2)) AS gross, CAST(list_position(['PENDING', 'PAID', 'PROCESSING', 'SHIPPED', 'DELIVERED', 'CANCELLED', 'PARTIALLY_REFUNDED', 'REFUNDED', 'UNKNOWN'], status) AS BIGINT) AS place FROM o GROUP BY 1")
def agg_status_breakdown(spark, d):
    return m.status_breakdown(orders(spark, d))


@R.add("agg_by_currency", "SELECT currency, CAST(sum(gross_amount) AS DECIMAL(38,2)) AS amount FROM o GROUP BY 1")
def agg_by_currency(spark, d):
    return orders(spark, d).groupBy("currency").agg(money(F.sum("gross_amount")).alias("amount"))


@R.add("agg_breakdown_by_key", "SELECT status, currency, count(*) AS orders, CAST(sum(units) AS BIGINT) AS units, CAST(sum(gross_amount) AS DECIMAL(38,2)) AS amount FROM o JOIN (SELECT order_id, sum(quantity) AS units FROM i GROUP BY 1) USING (order_id) GROUP BY 1, 2")
def agg_breakdown_by_key(spark, d):
    units = items(spark, d).groupBy("order_id").agg(F.sum("quantity").alias("units"))
    return orders(spark, d).join(units, "order_id").groupBy("status", "currency").agg(F.count("*").alias("orders"), F.sum("units").alias("units"), money(F.sum("gross_amount")).alias("amount"))


@R.add("fn_local_midnight", "SELECT day, timezone('UTC', timezone('America/Sao_Paulo', CAST(day AS TIMESTAMP))) AS starts FROM (SELECT DISTINCT CAST(sold_at AS DATE) AS day FROM o)")
def fn_local_midnight(spark, d):
    return ntz(orders(spark, d).select(F.to_date("sold_at").alias("day")).distinct().select("day", local_midnight("day").alias("starts")))


@R.add("rm_accounts", "SELECT DISTINCT account_code FROM o ORDER BY 1")
def rm_accounts(spark, d):
    return orders(spark, d).select("account_code").distinct().orderBy("account_code")


@R.add("fn_derived_ticket", f"SELECT account_code, day, {TICKET} AS ticket FROM dm")
def fn_derived_ticket(spark, d):
    return daily_metrics(spark, d).select("account_code", "day", m.ticket("gross", "sales_count").alias("ticket"))


@R.add("fn_derived_conversion", "SELECT account_code, day, CASE WHEN visits > 0 THEN CAST((2 * CAST(sales_count AS HUGEINT) * 1000000000000 + visits) // (2 * visits) AS DOUBLE) / 1e10 END AS conversion FROM dm")
def fn_derived_conversion(spark, d):
    return daily_metrics(spark, d).select("account_code", "day", m.conversion("sales_count", "visits").alias("conversion"))


LONG = f""", dt AS (SELECT *, {TICKET} AS ticket FROM dm), lg AS (SELECT account_code, day, 'visits' AS name, CAST(visits AS DECIMAL(30,10)) AS value FROM dt UNION ALL SELECT account_code, day, 'sales_count', CAST(sales_count AS DECIMAL(30,10)) FROM dt
  UNION ALL SELECT account_code, day, 'gross', CAST(gross AS DECIMAL(30,10)) FROM dt UNION ALL SELECT account_code, day, 'ticket', CAST(ticket AS DECIMAL(30,10)) FROM dt)"""


@R.add("pl_persist_basic", f"{LONG} SELECT * FROM lg")
def pl_persist_basic(spark, d):
    return m.snapshot(daily_metrics(spark, d))


@R.add("snk_partial_update", f"{LONG} SELECT account_code, day, name, CASE WHEN name = 'visits' AND account_code = 'C1' THEN CAST(value + 1 AS DECIMAL(30,10)) ELSE value END AS value FROM lg")
def snk_partial_update(spark, d):
    long = m.snapshot(daily_metrics(spark, d))
    new = long.where("name = 'visits' AND account_code = 'C1'").withColumn("value", (F.col("value") + 1).cast("decimal(30,10)"))
    return m.overlay(long, new, ["account_code", "day", "name"])


_FILL = "SELECT account_code, day, CASE WHEN day(day) % 3 = 0 THEN visits WHEN day(day) % 3 = 1 THEN sales_count END AS known, CASE WHEN day(day) % 3 = 0 THEN 'KEPT' WHEN day(day) % 3 = 1 THEN 'FILLED' ELSE 'MISSING' END AS outcome FROM dm"


def _filled(spark, d):
    rows = daily_metrics(spark, d)
    kind = F.dayofmonth("day") % 3
    old = rows.select("account_code", "day", F.when(kind == 0, F.col("visits")).alias("known"))
    new = rows.where(kind == 1).select("account_code", "day", F.col("sales_count").alias("known"))
    return m.fill_missing(old, new, ["account_code", "day"], "known")


@R.add("snk_update_from_values", f"SELECT account_code, day, known FROM ({_FILL})")
def snk_update_from_values(spark, d):
    return _filled(spark, d).drop("outcome")


@R.add("pl_hash_backfill", f"SELECT outcome, count(*) AS days FROM ({_FILL}) GROUP BY 1")
def pl_hash_backfill(spark, d):
    return _filled(spark, d).groupBy("outcome").agg(F.count("*").alias("days"))


@R.add("pl_visits_refresh", "SELECT account_code, day, visits AS before, CASE WHEN day(day) % 5 = 0 THEN visits + 3 WHEN day(day) % 5 = 1 THEN NULL ELSE visits END AS visits_now, CASE day(day) % 5 WHEN 0 THEN 'UPDATED' WHEN 1 THEN 'FAILED' ELSE 'UNCHANGED' END AS outcome FROM dm")
def pl_visits_refresh(spark, d):
    old = daily_metrics(spark, d).select("account_code", "day", F.col("visits").alias("before"))
    kind = F.dayofmonth("day") % 5
    new = old.where(kind != 1).select("account_code", "day", F.when(kind == 0, F.col("before") + 3).otherwise(F.col("before")).alias("visits_now"))
    outcome = F.when(F.col("visits_now").isNull(), "FAILED").when(F.col("visits_now").eqNullSafe(F.col("before")), "UNCHANGED").otherwise("UPDATED")
    return old.join(new, ["account_code", "day"], "left").select("account_code", "day", "before", "visits_now", outcome.alias("outcome"))


WIDE = f"{LONG}, wd AS (SELECT account_code, day, max(value) FILTER (name = 'visits') AS visits, max(value) FILTER (name = 'sales_count') AS sales_count, max(value) FILTER (name = 'gross') AS gross, max(value) FILTER (name = 'ticket') AS ticket FROM lg GROUP BY 1, 2)"


@R.add("rm_metrics_daily", f"{WIDE} SELECT * FROM wd WHERE account_code = 'C1' AND day = DATE '2024-01-10'")
def rm_metrics_daily(spark, d):
    return m.pivoted(pl_persist_basic(spark, d).where("account_code = 'C1' AND day = DATE '2024-01-10'"))


@R.add("rm_metrics_range", f"{WIDE} SELECT * FROM wd WHERE account_code = 'C2' AND day BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' ORDER BY day")
def rm_metrics_range(spark, d):
    return m.pivoted(pl_persist_basic(spark, d).where("account_code = 'C2' AND day BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'")).orderBy("day")


DENSE = ", dn AS (SELECT a.account_code, CAST(g.day AS DATE) AS day, CASE WHEN dm.visits IS NULL THEN 'MISSING_SNAPSHOT' ELSE 'AVAILABLE' END AS state, visits, sales_count, gross FROM (SELECT DISTINCT account_code FROM dm) a CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-25', INTERVAL 1 DAY)) AS day) g LEFT JOIN dm ON dm.account_code = a.account_code AND dm.day = CAST(g.day AS DATE))"


def _dense(spark, d):
    return m.densified(daily_metrics(spark, d), "2024-01-05", "2024-01-25")


@R.add("join_calendar_densify", f"{DENSE} SELECT * FROM dn")
def join_calendar_densify(spark, d):
    return _dense(spark, d)


SUMS = f"{DENSE}, sm AS (SELECT account_code, CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(sales_count) AS BIGINT) AS sales_count, CAST(sum(gross) AS DECIMAL(38,2)) AS gross, count(*) FILTER (state <> 'AVAILABLE') AS missing_days FROM dn GROUP BY 1)"


@R.add("rm_metrics_comparison", f"{SUMS} SELECT *, {TICKET} AS ticket, missing_days > 0 AS partial FROM sm")
def rm_metrics_comparison(spark, d):
    return m.period(_dense(spark, d))


@R.add("agg_snapshot_sums", f"{SUMS} SELECT account_code, visits, sales_count, gross FROM sm")
def agg_snapshot_sums(spark, d):
    return m.period(_dense(spark, d)).select("account_code", "visits", "sales_count", "gross")


@R.add("fn_period_partial", f"{SUMS} SELECT account_code, missing_days > 0 AS partial FROM sm")
def fn_period_partial(spark, d):
    return m.period(_dense(spark, d)).select("account_code", "partial")


@R.add("join_common_latest", "SELECT coalesce((SELECT max(day) FROM dm a SEMI JOIN (SELECT day FROM dm WHERE account_code = 'C2') b USING (day) WHERE a.account_code = 'C1'), (SELECT max(day) FROM dm)) AS latest")
def join_common_latest(spark, d):
    rows = daily_metrics(spark, d).groupBy("day").agg(F.countDistinct("account_code").alias("n"))
    return rows.agg(F.coalesce(F.max(F.when(F.col("n") == 2, F.col("day"))), F.max("day")).alias("latest"))


@R.add("agg_period_performance", "SELECT account_code, arg_max(day, (CAST(visits AS BIGINT) * 100000 - date_diff('day', DATE '1970-01-01', day))) AS peak_day, max(visits) AS peak_value, round(avg(visits), 6) AS day_average FROM dm GROUP BY 1")
def agg_period_performance(spark, d):
    return m.peaks(daily_metrics(spark, d), "visits")


@R.add("win_top_peak", "SELECT account_code, day, gross FROM (SELECT *, row_number() OVER (PARTITION BY account_code ORDER BY gross DESC, day) AS n FROM dm) WHERE n = 1")
def win_top_peak(spark, d):
    best = daily_metrics(spark, d).groupBy("account_code").agg(F.max(F.struct("gross", (-F.unix_date("day")).alias("early"))).alias("best"))
    return best.select("account_code", F.date_from_unix_date(-F.col("best.early")).alias("day"), F.col("best.gross").alias("gross"))


@R.add("top_recent_days", "SELECT account_code, day, visits FROM (SELECT * FROM dm WHERE account_code = 'C1' AND day < DATE '2024-01-30' ORDER BY day DESC LIMIT 7) ORDER BY day")
def top_recent_days(spark, d):
    return daily_metrics(spark, d).where("account_code = 'C1' AND day < DATE '2024-01-30'").select("account_code", "day", "visits").orderBy(F.desc("day")).limit(7).orderBy("day")


PREV = f""", pv AS (SELECT account_code, CAST(sum(visits) FILTER (day >= DATE '2024-01-15') AS BIGINT) AS now, CAST(sum(visits) FILTER (day < DATE '2024-01-15') AS BIGINT) AS before FROM dm WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-24' GROUP BY 1)"""


def _periods(spark, d):
    """A range and the equally long one that ends the day before it starts."""
    first, last = F.to_date(F.lit("2024-01-15")), F.to_date(F.lit("2024-01-24"))
    start = F.date_sub(first, F.datediff(last, first) + 1)
    day = F.col("day")
    rows = daily_metrics(spark, d).where(day.between(start, last))
    return rows.groupBy("account_code").agg(F.sum(F.when(day >= first, F.col("visits"))).alias("now"), F.sum(F.when(day < first, F.col("visits"))).alias("before"))


@R.add("win_previous_period", f"{PREV} SELECT * FROM pv")
def win_previous_period(spark, d):
    return _periods(spark, d)


@R.add("fn_temporal_metric", f"{PREV} SELECT account_code, abs(now - before) AS difference, {signed_pct('(now - before)', 'before')} AS variation, CASE WHEN now > before THEN 'UP' WHEN now < before THEN 'DOWN' ELSE 'EQUAL' END AS direction FROM pv")
def fn_temporal_metric(spark, d):
    return _periods(spark, d).select("account_code", *m.temporal("now", "before"))


@R.add("top_signals", f"{PREV} SELECT account_code, abs(now - before) AS difference FROM pv WHERE now IS NOT NULL AND before IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 3")
def top_signals(spark, d):
    return fn_temporal_metric(spark, d).where("difference is not null").select("account_code", "difference").orderBy(F.desc("difference"), "account_code").limit(3)


@R.add("fn_participation", "SELECT day, CASE WHEN sum(visits) > 0 THEN CAST(sum(visits) FILTER (account_code = 'C1') AS DOUBLE) / CAST(sum(visits) AS DOUBLE) * 100 END AS share FROM dm GROUP BY 1")
def fn_participation(spark, d):
    rows = daily_metrics(spark, d).groupBy("day").agg(F.sum(F.when(F.col("account_code") == "C1", F.col("visits"))).alias("own"), F.sum("visits").alias("all"))
    return rows.select("day", (F.try_divide(F.col("own").cast("double"), F.col("all").cast("double")) * 100).alias("share"))


@R.add("fn_account_diff", "SELECT day, abs(a - b) AS difference, CASE WHEN a + b = 0 THEN 0.0 ELSE CAST(abs(a - b) AS DOUBLE) / (CAST(a + b AS DOUBLE) / 2) * 100 END AS difference_percent FROM (SELECT day, CAST(coalesce(sum(visits) FILTER (account_code = 'C1'), 0) AS BIGINT) AS a, CAST(coalesce(sum(visits) FILTER (account_code = 'C2'), 0) AS BIGINT) AS b FROM dm GROUP BY 1)")
def fn_account_diff(spark, d):
    rows = daily_metrics(spark, d).groupBy("day").pivot("account_code", ["C1", "C2"]).agg(F.sum("visits")).fillna(0)
    a, b = F.col("C1"), F.col("C2")
    return rows.select("day", F.abs(a - b).alias("difference"), ratio_percent(F.abs(a - b), (a + b).cast("double") / 2).alias("difference_percent"))


EVID = """, ev AS (SELECT account_code, day, 'visits' AS metric, 'MARKETPLACE' AS source, 1 AS ordinal, true AS preferred, CASE WHEN day(day) % 4 <> 0 THEN visits END AS value FROM dm
  UNION ALL SELECT account_code, day, 'visits', 'ERP', 2, false, CASE WHEN day(day) % 3 = 0 THEN visits + 2 ELSE visits END FROM dm)"""


def _evidence(spark, d):
    rows = daily_metrics(spark, d)
    n = F.dayofmonth("day")
    both = [("MARKETPLACE", 1, True, F.when(n % 4 != 0, F.col("visits"))), ("ERP", 2, False, F.when(n % 3 == 0, F.col("visits") + 2).otherwise(F.col("visits")))]
    one, two = (rows.select("account_code", "day", F.lit("visits").alias("metric"), F.lit(s).alias("source"), F.lit(o).alias("ordinal"), F.lit(p).alias("preferred"), v.alias("value")) for s, o, p, v in both)
    return one.unionByName(two)


@R.add("pl_reconcile", f"""{EVID}, rf AS (SELECT *, first_value(value IGNORE NULLS) OVER (PARTITION BY account_code, day, metric ORDER BY preferred DESC, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS reference FROM ev)
  SELECT account_code, day, metric, source, value, reference, CASE WHEN value IS NULL THEN 'UNAVAILABLE' WHEN value = reference THEN 'EXACT' ELSE 'DIFFERENT' END AS state, abs(value - reference) AS difference,
  CASE WHEN reference <> 0 AND value IS NOT NULL THEN CAST((2 * CAST(abs(value - reference) AS HUGEINT) * 1000000 + reference) // (2 * reference) AS DOUBLE) / 1e4 END AS difference_percent FROM rf""")
def pl_reconcile(spark, d):
    return m.reconcile(_evidence(spark, d))


@R.add("pl_resolve", f"{EVID} SELECT account_code, day, metric, source AS primary_source, value, CASE WHEN value IS NULL THEN 'UNAVAILABLE' ELSE 'RESOLVED' END AS state FROM ev WHERE source = 'MARKETPLACE'")
def pl_resolve(spark, d):
    policy = spark.createDataFrame([("visits", "MARKETPLACE"), ("gross", "ERP")], "metric string, primary_source string")
    return m.resolve(_evidence(spark, d), policy)


QUERIES, ORACLES = R.queries, R.sql
