"""Queries on stale listings and on equivalent listings of two accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..binding import ANCHOR, listings, orders, read, sales, signed_pct
from ..functions.scalars import EFFECTIVE, local_midnight, money, operational_status
from ..operators import equivalence as x1
from ..operators import stale
from ..operators.abc import in_window
from ..operators.ranking import by_locale, ranked
from .base import Queries, local, local_days
from .sales_queries import _CMP, _compared

R = Queries()
DONE = ", ".join(repr(x) for x in EFFECTIVE)
CREATED = "TIMESTAMP '2001-01-01 00:00:00' + to_days(CAST(listing_id % 150 AS INTEGER))"


def ntz(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def _created():
    return F.to_timestamp(F.lit("2001-01-01 00:00:00")) + F.make_dt_interval((F.col("listing_id") % 150).cast("int"))


def _evaluated(spark, d):
    return stale.evaluate(sales(spark, d), stale.history_coverage(orders(spark, d)), _created())


COV = ", cov AS (SELECT account_code, min(sold_at) AS history_from, max(sold_at) AS history_through FROM o GROUP BY 1)"
EV = f"""{COV}, ev0 AS (SELECT s.account_code, listing_id, min(sold_at) AS first_order, max(sold_at) FILTER (status IN ({DONE})) AS last_sale,
  count(DISTINCT order_id) FILTER (status IN ({DONE}) AND sold_at > history_through - INTERVAL 30 DAYS) AS orders_30,
  CAST(coalesce(sum(quantity) FILTER (status IN ({DONE}) AND sold_at > history_through - INTERVAL 30 DAYS), 0) AS BIGINT) AS units_30,
  CAST(coalesce(sum(revenue) FILTER (status IN ({DONE}) AND sold_at > history_through - INTERVAL 30 DAYS), 0) AS DECIMAL(38,2)) AS gross_30, min(history_from) AS history_from, max(history_through) AS history_through
  FROM s JOIN cov ON s.account_code = cov.account_code AND sold_at BETWEEN history_from AND history_through GROUP BY 1, 2),
ev1 AS (SELECT *, least(first_order, {CREATED}) AS first_seen FROM ev0),
ev AS (SELECT account_code, listing_id, first_seen, last_sale, orders_30, units_30, gross_30, CAST(CASE WHEN last_sale IS NOT NULL THEN {local_days('last_sale', 'history_through')} END AS BIGINT) AS days_since,
  CAST({local_days('first_seen', 'history_through')} AS BIGINT) AS observed_days, CAST({local_days('history_from', 'history_through')} AS BIGINT) AS history_days FROM ev1)"""


def _ok(days):
    return f"(observed_days >= {days} AND history_days >= {days} AND (days_since IS NULL OR days_since >= {days}))"


STATUS = "CASE WHEN days_since IS NULL THEN 'IN_AVAILABLE_HISTORY' WHEN days_since >= 90 THEN '90D' WHEN days_since >= 60 THEN '60D' ELSE '30D' END"
NOSALE = f"{EV}, ns AS (SELECT account_code, listing_id, title, listing_status, last_sale, days_since, observed_days, {STATUS} AS operational_status, coalesce(days_since, observed_days) AS sort_days FROM ev JOIN li USING (listing_id) WHERE {_ok(30)})"


@R.add("agg_history_coverage", f"{COV} SELECT * FROM cov")
def agg_history_coverage(spark, d):
    return ntz(stale.history_coverage(orders(spark, d)))


@R.add("agg_global_watermark", f"{COV} SELECT CASE WHEN count(*) = 2 THEN min(history_through) END AS data_through FROM cov")
def agg_global_watermark(spark, d):
    return ntz(stale.watermark(stale.history_coverage(orders(spark, d)), 2))


@R.add("agg_filtered_max", f"SELECT account_code, listing_id, max(sold_at) FILTER (status IN ({DONE})) AS last_sale FROM s GROUP BY 1, 2")
def agg_filtered_max(spark, d):
    return ntz(sales(spark, d).groupBy("account_code", "listing_id").agg(F.max(F.when(F.col("status").isin(EFFECTIVE), F.col("sold_at"))).alias("last_sale")))


@R.add("join_range_history", f"{COV}, c2 AS (SELECT account_code, history_from + INTERVAL 100 DAYS AS history_from, history_through - INTERVAL 100 DAYS AS history_through FROM cov) SELECT c2.account_code, count(order_id) AS orders FROM c2 LEFT JOIN o ON o.account_code = c2.account_code AND sold_at BETWEEN history_from AND history_through GROUP BY 1")
def join_range_history(spark, d):
    cov = stale.history_coverage(orders(spark, d)).select("account_code", (F.col("history_from") + F.expr("INTERVAL 100 DAYS")).alias("history_from"), (F.col("history_through") - F.expr("INTERVAL 100 DAYS")).alias("history_through"))
    return stale.within_history(orders(spark, d), cov).groupBy("account_code").agg(F.count("order_id").alias("orders"))


@R.add("join_lateral_candidates", f"{COV}, c AS (SELECT s.account_code, listing_id, min(sold_at) AS first_order, count(*) AS items FROM cov JOIN s ON s.account_code = cov.account_code AND sold_at BETWEEN history_from AND history_through GROUP BY 1, 2) SELECT cov.account_code, listing_id, first_order, items FROM cov LEFT JOIN c USING (account_code)")
def join_lateral_candidates(spark, d):
    cov = stale.history_coverage(orders(spark, d))
    rows = stale.within_history(sales(spark, d), cov).groupBy("account_code", "listing_id").agg(F.min("sold_at").alias("first_order"), F.count("*").alias("items"))
    return ntz(rows.join(F.broadcast(cov.select("account_code")), "account_code", "right"))


@R.add("src_raw_sql", f"SELECT listing_id, count(DISTINCT order_id) AS orders FROM s WHERE status IN ({DONE}) GROUP BY 1")
def src_raw_sql(spark, d):
    states = ", ".join(f"'{x}'" for x in EFFECTIVE)
    return spark.sql(f"SELECT listing_id, count(DISTINCT order_id) AS orders FROM {{facts}} WHERE status IN ({states}) GROUP BY listing_id", facts=sales(spark, d))


@R.add("agg_no_sale_eval", f"{EV} SELECT * FROM ev")
def agg_no_sale_eval(spark, d):
    return ntz(_evaluated(spark, d))


@R.add("rm_no_sale", f"{NOSALE} SELECT * FROM ns")
def rm_no_sale(spark, d):
    return ntz(stale.no_sale(_evaluated(spark, d), listings(spark, d)))


@R.add("fn_qualifies", f"{EV} SELECT account_code, count(*) AS listings, count(*) FILTER ({_ok(30)}) AS no_sale_30, count(*) FILTER ({_ok(60)}) AS no_sale_60, count(*) FILTER ({_ok(90)}) AS no_sale_90 FROM ev GROUP BY 1")
def fn_qualifies(spark, d):
    return stale.threshold_counts(_evaluated(spark, d))


@R.add("fn_operational_status", f"{EV} SELECT {STATUS} AS operational_status, count(*) AS listings FROM ev GROUP BY 1")
def fn_operational_status(spark, d):
    return _evaluated(spark, d).groupBy(operational_status("days_since").alias("operational_status")).agg(F.count("*").alias("listings"))


@R.add("fn_business_days", f"{EV} SELECT account_code, listing_id, days_since, observed_days FROM ev")
def fn_business_days(spark, d):
    return _evaluated(spark, d).select("account_code", "listing_id", "days_since", "observed_days")


def _longest_first(rows):
    return ranked(rows, F.desc("sort_days"), F.asc("account_code"), F.asc("listing_id"), name="position")


@R.add("sort_no_sale", f"{NOSALE} SELECT account_code, listing_id, sort_days, row_number() OVER (ORDER BY sort_days DESC, account_code, listing_id) AS position FROM ns")
def sort_no_sale(spark, d):
    return _longest_first(rm_no_sale(spark, d).select("account_code", "listing_id", "sort_days"))


@R.add("sort_alerts", f"{NOSALE} SELECT account_code, listing_id, title, sort_days, row_number() OVER (ORDER BY sort_days DESC, account_code, listing_id) AS position FROM ns WHERE listing_status = 'active'")
def sort_alerts(spark, d):
    rows = stale.no_sale(_evaluated(spark, d), listings(spark, d), status="ACTIVE")
    return _longest_first(rows.select("account_code", "listing_id", "title", "sort_days"))


@R.add("top_attention_5", f"{NOSALE} SELECT account_code, listing_id, sort_days FROM ns ORDER BY sort_days DESC, account_code, listing_id LIMIT 5")
def top_attention_5(spark, d):
    return rm_no_sale(spark, d).select("account_code", "listing_id", "sort_days").orderBy(F.desc("sort_days"), "account_code", "listing_id").limit(5)


_LISTS = f"""{_CMP}, {NOSALE.lstrip(', ')}, att AS (
  SELECT 'CURVE_DROP' AS section, CASE transition WHEN 'A_TO_C' THEN 1 WHEN 'A_TO_B' THEN 2 WHEN 'B_TO_C' THEN 3 ELSE 4 END AS f, coalesce(revenue_delta, 0) AS g, NULL AS account_code, listing_id, transition, revenue_delta, NULL AS days FROM cmp WHERE movement = 'DECLINED'
  UNION ALL SELECT 'REVENUE_DROP', 0, revenue_delta, NULL, listing_id, transition, revenue_delta, NULL FROM cmp WHERE revenue_delta < 0
  UNION ALL SELECT CASE WHEN sort_days >= 90 THEN 'NO_SALE_90' WHEN sort_days >= 60 THEN 'NO_SALE_60' ELSE 'NO_SALE_30' END, -sort_days, 0, account_code, listing_id, NULL, NULL, sort_days FROM ns)"""


@R.add("pl_attention_center", f"{_LISTS} SELECT section, account_code, listing_id, transition, revenue_delta, days, row_number() OVER (PARTITION BY section ORDER BY f, g, account_code, listing_id) AS position FROM att")
def pl_attention_center(spark, d):
    return stale.attention_center(_compared(spark, d), stale.no_sale(_evaluated(spark, d), listings(spark, d)))


@R.add("agg_attention_buckets", f"{NOSALE} SELECT account_code, CASE WHEN sort_days >= 90 THEN '90+' WHEN sort_days >= 60 THEN '60-89' ELSE '30-59' END AS bucket, count(*) AS listings FROM ns GROUP BY 1, 2")
def agg_attention_buckets(spark, d):
    return stale.attention(stale.no_sale(_evaluated(spark, d), listings(spark, d)))


# equivalent listings: an even listing of C1 and the next one of C2; every tenth is not confirmed, every fourth edge is turned
def _edges(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("p")).where("p % 2 = 0")
    turned = F.col("p") % 4 == 0
    return p.select(F.when(turned, F.col("p") + 1).otherwise(F.col("p")).alias("a"), F.when(turned, F.col("p")).otherwise(F.col("p") + 1).alias("b"), F.when(F.col("p") % 10 == 0, "CANDIDATE").otherwise("CONFIRMED").alias("state"))


def _owners(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("listing_id"), F.when(F.col("p_partkey") % 2 == 0, "C1").otherwise("C2").alias("account_code"))


def _components(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("listing_id"), F.col("p_size").cast("long").alias("z"))
    first = p.select("listing_id", (F.col("z") % 2).alias("component"), (1 + F.col("z") % 4).alias("quantity"))
    return first.unionByName(p.where("z % 3 = 0").select("listing_id", F.lit(9).cast("long").alias("component"), F.lit(1).cast("long").alias("quantity")))


def _pairs(spark, d):
    return x1.orient(_edges(spark, d), _owners(spark, d))


DAY = ANCHOR[:10]


def _recent(spark, d, days=90):
    """The last closed days: today is not among them."""
    day = F.to_date(F.lit(DAY))
    return sales(spark, d, in_window(orders(spark, d), local_midnight(F.date_sub(day, days)), local_midnight(day)))


CLOSED = "timezone('UTC', timezone('America/Sao_Paulo', TIMESTAMP '{}'))"
PAIRS = """, own AS (SELECT p_partkey AS listing_id, CASE WHEN p_partkey % 2 = 0 THEN 'C1' ELSE 'C2' END AS account_code FROM part),
ed AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 1 ELSE p_partkey END AS a, CASE WHEN p_partkey % 4 = 0 THEN p_partkey ELSE p_partkey + 1 END AS b, CASE WHEN p_partkey % 10 = 0 THEN 'CANDIDATE' ELSE 'CONFIRMED' END AS state FROM part WHERE p_partkey % 2 = 0),
pa AS (SELECT CASE WHEN x.account_code = 'C1' THEN a ELSE b END AS "left", CASE WHEN x.account_code = 'C1' THEN b ELSE a END AS "right", state FROM ed JOIN own x ON x.listing_id = a JOIN own y ON y.listing_id = b WHERE x.account_code <> y.account_code),
co AS (SELECT p_partkey AS listing_id, CAST(p_size % 2 AS BIGINT) AS component, CAST(1 + p_size % 4 AS BIGINT) AS quantity FROM part UNION ALL SELECT p_partkey, 9, 1 FROM part WHERE p_size % 3 = 0),
ids AS (SELECT listing_id, list_sort(list(DISTINCT component)) AS ids FROM co GROUP BY 1),
cp AS (SELECT "left", "right" FROM pa JOIN ids x ON x.listing_id = "left" JOIN ids y ON y.listing_id = "right" WHERE state = 'CONFIRMED' AND x.ids = y.ids)"""
SIDE = f"""{PAIRS}, pk AS (SELECT listing_id, sum(quantity) AS pieces FROM co GROUP BY 1),
sm AS (SELECT account_code, listing_id, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(revenue) AS DECIMAL(38,2)) AS revenue, CAST(sum(quantity * coalesce(pk.pieces, 1)) AS BIGINT) AS pieces
  FROM s LEFT JOIN pk USING (listing_id) WHERE status IN ({DONE}) AND sold_at >= {CLOSED.format('2001-05-03')} AND sold_at < {CLOSED.format(DAY)} GROUP BY 1, 2)"""
X1 = f"""{SIDE}, x1 AS (SELECT "left", "right", coalesce(l.orders, 0) AS left_orders, coalesce(l.units, 0) AS left_units, coalesce(l.pieces, 0) AS left_pieces, coalesce(r.orders, 0) AS right_orders, coalesce(r.units, 0) AS right_units, coalesce(r.pieces, 0) AS right_pieces,
  CAST(coalesce(l.revenue, 0) AS DECIMAL(38,2)) AS left_revenue, CAST(coalesce(r.revenue, 0) AS DECIMAL(38,2)) AS right_revenue FROM cp LEFT JOIN sm l ON l.listing_id = "left" AND l.account_code = 'C1' LEFT JOIN sm r ON r.listing_id = "right" AND r.account_code = 'C2')"""


@R.add("join_edge_orient", f"{PAIRS} SELECT * FROM pa")
def join_edge_orient(spark, d):
    return _pairs(spark, d)


@R.add("join_full_outer_components", f'{PAIRS}, l AS (SELECT "left", "right", component, quantity AS left_quantity FROM pa JOIN co ON listing_id = "left"), r AS (SELECT "left", "right", component, quantity AS right_quantity FROM pa JOIN co ON listing_id = "right") SELECT * FROM l FULL JOIN r USING ("left", "right", component)')
def join_full_outer_components(spark, d):
    return x1.component_rows(_pairs(spark, d), _components(spark, d)).select("left", "right", "component", "left_quantity", "right_quantity")


@R.add("set_symmetric_ids", f'{PAIRS} SELECT "left", "right", component FROM pa JOIN co ON listing_id = "left" UNION SELECT "left", "right", component FROM pa JOIN co ON listing_id = "right"')
def set_symmetric_ids(spark, d):
    pairs, parts = _pairs(spark, d), _components(spark, d)
    return pairs.join(parts, pairs.left == parts.listing_id).select("left", "right", "component").union(pairs.join(parts, pairs.right == parts.listing_id).select("left", "right", "component")).distinct()


@R.add("join_set_equality", f"{PAIRS} SELECT * FROM cp")
def join_set_equality(spark, d):
    return x1.comparable(_pairs(spark, d), _components(spark, d))


@R.add("agg_x1_account", f"{SIDE} SELECT * FROM sm")
def agg_x1_account(spark, d):
    return x1.side_metrics(_recent(spark, d), _components(spark, d))


def _x1(spark, d):
    parts = _components(spark, d)
    return x1.compare(x1.comparable(_pairs(spark, d), parts), x1.side_metrics(_recent(spark, d), parts))


@R.add("rm_x1", f"{X1} SELECT *, left_pieces - right_pieces AS pieces_delta, CAST(left_revenue - right_revenue AS DECIMAL(38,2)) AS revenue_delta, {signed_pct('CAST((left_revenue - right_revenue) * 100 AS HUGEINT)', 'CAST(right_revenue * 100 AS HUGEINT)')} AS revenue_delta_percent FROM x1")
def rm_x1(spark, d):
    return _x1(spark, d)


@R.add("agg_x1_summary", f"{X1} SELECT count(*) AS pairs, CAST(sum(left_revenue) AS DECIMAL(38,2)) AS left_revenue, CAST(sum(right_revenue) AS DECIMAL(38,2)) AS right_revenue, CAST(sum(left_pieces) AS BIGINT) AS left_pieces, CAST(sum(right_pieces) AS BIGINT) AS right_pieces, CAST(sum(left_revenue) - sum(right_revenue) AS DECIMAL(38,2)) AS revenue_delta FROM x1")
def agg_x1_summary(spark, d):
    sums = [money(F.sum(c)).alias(c) for c in ("left_revenue", "right_revenue")] + [F.sum(c).alias(c) for c in ("left_pieces", "right_pieces")]
    return _x1(spark, d).agg(F.count("*").alias("pairs"), *sums).withColumn("revenue_delta", money(F.col("left_revenue") - F.col("right_revenue")))


@R.add("agg_x1_coverage", f"{PAIRS} SELECT (SELECT count(*) FROM pa WHERE state = 'CONFIRMED') AS confirmed, (SELECT count(*) FROM cp) AS comparable, (SELECT count(*) FROM pa WHERE state = 'CONFIRMED') - (SELECT count(*) FROM cp) AS review_required")
def agg_x1_coverage(spark, d):
    pairs = _pairs(spark, d)
    good = x1.comparable(pairs, _components(spark, d)).withColumn("good", F.lit(1))
    rows = pairs.where("state = 'CONFIRMED'").join(good, ["left", "right"], "left").agg(F.count("*").alias("confirmed"), F.count("good").alias("comparable"))
    return rows.withColumn("review_required", F.greatest(F.lit(0).cast("long"), F.col("confirmed") - F.col("comparable")))


@R.add("fn_numeric_delta", f'{X1} SELECT "left", "right", left_units - right_units AS units_delta, {signed_pct("(left_units - right_units)", "right_units")} AS units_delta_percent FROM x1')
def fn_numeric_delta(spark, d):
    from ..functions.scalars import delta_percent

    return _x1(spark, d).select("left", "right", (F.col("left_units") - F.col("right_units")).alias("units_delta"), delta_percent("left_units", "right_units").alias("units_delta_percent"))


@R.add("fn_resolve_x1_period", f"SELECT count(*) AS items, min(sold_at) AS first_sale, max(sold_at) AS last_sale FROM s WHERE sold_at >= {CLOSED.format('2001-05-03')} AND sold_at < {CLOSED.format(DAY)}")
def fn_resolve_x1_period(spark, d):
    return ntz(_recent(spark, d).agg(F.count("*").alias("items"), F.min("sold_at").alias("first_sale"), F.max("sold_at").alias("last_sale")))


_LOCAL = local("sold_at")


@R.add("fn_local_day_interval", f"SELECT account_code, CAST({_LOCAL} AS DATE) AS day, count(*) AS orders FROM o GROUP BY 1, 2")
def fn_local_day_interval(spark, d):
    from ..functions.scalars import local_day

    return orders(spark, d).groupBy("account_code", local_day("sold_at").alias("day")).agg(F.count("*").alias("orders"))


@R.add("sort_locale", "SELECT listing_id, title, row_number() OVER (ORDER BY title COLLATE pt, title, listing_id) AS position FROM li WHERE title IS NOT NULL")
def sort_locale(spark, d):
    """Titles in the order of the language, equal ones by their letters and ids."""
    rows = listings(spark, d).where("title is not null").select("listing_id", "title")
    return ranked(rows, by_locale("title"), F.asc("title"), F.asc("listing_id"), name="position")


QUERIES, ORACLES = R.queries, R.sql
