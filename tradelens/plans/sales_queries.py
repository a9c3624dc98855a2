"""Queries on listings and products."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..binding import ANCHOR, SQL, listings, orders, pct, products, sales, signed_pct
from ..functions.scalars import EFFECTIVE, money, percentage, ratio_percent
from ..operators import abc, products as prod
from ..operators.ranking import ranked
from ..shared import settle

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return add


DAY = ANCHOR[:10]
MID = "timezone('UTC', timezone('America/Sao_Paulo', TIMESTAMP '{}'))"
NOW_A, NOW_B = MID.format("2001-07-03"), MID.format("2001-08-02")
OLD_A, OLD_B = MID.format("2001-07-02"), MID.format("2001-08-01")
CENTS = "CAST({} * 100 AS HUGEINT)"


def _window(spark, d, shift=0, days=30):
    return sales(spark, d, abc.in_window(orders(spark, d), *abc.window_bounds(DAY, days, shift)))


def _per_listing(src: str, a: str, b: str, name: str) -> str:
    return f"""{name} AS (SELECT listing_id, count(DISTINCT order_id) AS sales_count, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(revenue) AS DECIMAL(38,2)) AS revenue,
      array_to_string(list_sort(list(DISTINCT account_code)), ',') AS accounts, min_by(title, CASE WHEN title IS NOT NULL THEN account_code END) AS title
      FROM {src} WHERE sold_at >= {a} AND sold_at < {b} GROUP BY listing_id)"""


def _curve(src: str, metric: str, name: str) -> str:
    whole = metric if metric == "units" else CENTS.format(metric)
    return f"""{name} AS (SELECT *, CASE WHEN total = 0 OR before * 100 < total * 80 THEN 'A' WHEN before * 100 < total * 95 THEN 'B' ELSE 'C' END AS abc_class,
      {pct("m", "total")} AS share, {pct("before + m", "total")} AS cumulative_share FROM (
        SELECT *, {whole} AS m, row_number() OVER (ORDER BY {metric} DESC, listing_id) AS rank, sum({whole}) OVER () AS total,
        coalesce(sum({whole}) OVER (ORDER BY {metric} DESC, listing_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {src}))"""


PL = _per_listing("s", NOW_A, NOW_B, "pl")
PL_OLD = _per_listing("s", OLD_A, OLD_B, "po")
CURVE = f", {PL}, {_curve('pl', 'units', 'cv')}"
LISTING = ["listing_id", "sales_count", "units", "revenue", "accounts", "title"]


@query("agg_listing_sales", f", {PL} SELECT * FROM pl")
def agg_listing_sales(spark, d):
    return abc.listing_sales(_window(spark, d))


@query("win_abc_listing", f"{CURVE} SELECT listing_id, units, rank, abc_class, share, cumulative_share FROM cv")
def win_abc_listing(spark, d):
    return abc.listing_curve(abc.listing_sales(_window(spark, d))).select("listing_id", "units", "rank", "abc_class", "share", "cumulative_share")


@query("win_rank", f"{CURVE} SELECT listing_id, rank FROM cv")
def win_rank(spark, d):
    return abc.listing_curve(abc.listing_sales(_window(spark, d))).select("listing_id", "rank")


def _account_curves() -> str:
    parts = []
    for account in ("C1", "C2"):
        parts += [f"s{account} AS (SELECT * FROM s WHERE account_code = '{account}')", _per_listing(f"s{account}", NOW_A, NOW_B, f"p{account}")]
        parts += [_curve(f"p{account}", metric, f"{metric}{account}") for metric in ("units", "revenue")]
    columns = ", ".join(f"{m}{a}.abc_class AS {a.lower()}_{m}_class, {m}{a}.rank AS {a.lower()}_{m}_rank" for a in ("C1", "C2") for m in ("units", "revenue"))
    joins = " ".join(f"LEFT JOIN {m}{a} ON {m}{a}.listing_id = li.listing_id" for a in ("C1", "C2") for m in ("units", "revenue"))
    return f", {', '.join(parts)} SELECT li.listing_id, {columns} FROM li {joins}"


@query("join_abc_lookup", _account_curves())
def join_abc_lookup(spark, d):
    """Class and rank of each listing by account and metric; null where it did not sell."""
    sold, out = settle(abc.listing_sales(_window(spark, d), within=("account_code",))), listings(spark, d).select("listing_id")
    for metric in ("units", "revenue"):
        curve = abc.listing_curve(sold, metric, within=("account_code",))
        of = {a: F.col("account_code") == a for a in ("C1", "C2")}
        columns = [F.max(F.when(own, F.col(c))).alias(f"{a.lower()}_{metric}_{name}") for a, own in of.items() for c, name in (("abc_class", "class"), ("rank", "rank"))]
        out = out.join(curve.groupBy("listing_id").agg(*columns), "listing_id", "left")
    return out


@query("win_cumulative_share", f", {PL}, {_curve('pl', 'revenue', 'cv')} SELECT listing_id, revenue, rank, abc_class, share, cumulative_share FROM cv")
def win_cumulative_share(spark, d):
    return abc.listing_curve(abc.listing_sales(_window(spark, d)), "revenue").select("listing_id", "revenue", "rank", "abc_class", "share", "cumulative_share")


_CMP = f"""{CURVE}, {PL_OLD}, {_curve('po', 'units', 'cp')}, cmp AS (SELECT cv.listing_id, cv.units, cv.revenue, cv.rank, cv.abc_class, cp.abc_class AS previous_class, cp.rank AS previous_rank,
  CASE WHEN cp.abc_class IS NULL THEN 'NEW' WHEN cv.abc_class < cp.abc_class THEN 'IMPROVED' WHEN cv.abc_class > cp.abc_class THEN 'DECLINED' ELSE 'STABLE' END AS movement,
  cp.abc_class || '_TO_' || cv.abc_class AS transition, cp.rank - cv.rank AS rank_delta, CAST(cv.revenue - cp.revenue AS DECIMAL(38,2)) AS revenue_delta,
  {signed_pct(CENTS.format('(cv.revenue - cp.revenue)'), CENTS.format('cp.revenue'))} AS revenue_delta_percent,
  CASE WHEN cp.revenue IS NULL THEN 'NEW' WHEN cv.revenue > cp.revenue THEN 'IMPROVED' WHEN cv.revenue < cp.revenue THEN 'DECLINED' ELSE 'STABLE' END AS revenue_movement
  FROM cv LEFT JOIN cp USING (listing_id))"""
_CMP_COLS = ["listing_id", "units", "revenue", "rank", "abc_class", "previous_class", "previous_rank", "movement", "transition", "rank_delta", "revenue_delta", "revenue_delta_percent", "revenue_movement"]


def _compared(spark, d, scope=None):
    """Curves of both windows from one scan of the orders of either."""
    periods = {"now": abc.window_bounds(DAY, 30), "previous": abc.window_bounds(DAY, 30, 1)}
    own = abc.in_window(orders(spark, d), periods["previous"][0], periods["now"][1])
    rows = abc.in_periods(sales(spark, d, own if scope is None else own.where(F.col("account_code") == scope)), periods)
    curves = abc.listing_curve(abc.listing_sales(rows, within=("period",)), within=("period",))
    return abc.compare_curves(*(curves.where(F.col("period") == p).drop("period") for p in periods))


@query("rm_listing_abc", f"{_CMP} SELECT * FROM cmp")
def rm_listing_abc(spark, d):
    return _compared(spark, d).select(*_CMP_COLS)


@query("join_prev_period", f"{_CMP} SELECT listing_id, abc_class, previous_class, transition FROM cmp")
def join_prev_period(spark, d):
    return _compared(spark, d).select("listing_id", "abc_class", "previous_class", "transition")


@query("win_rank_delta", f"{_CMP} SELECT listing_id, rank, previous_rank, rank_delta FROM cmp")
def win_rank_delta(spark, d):
    return _compared(spark, d).select("listing_id", "rank", "previous_rank", "rank_delta")


@query("fn_movement_summary", f"""{_CMP} SELECT count(*) FILTER (movement = 'IMPROVED') AS improved, count(*) FILTER (movement = 'DECLINED') AS declined, count(*) FILTER (movement = 'STABLE') AS stable,
  count(*) FILTER (movement = 'NEW') AS "new", count(*) FILTER (transition = 'A_TO_B') AS a_to_b, count(*) FILTER (transition = 'A_TO_C') AS a_to_c, count(*) FILTER (transition = 'B_TO_C') AS b_to_c,
  CAST(coalesce(-sum(revenue_delta) FILTER (revenue_delta < 0), 0) AS DECIMAL(38,2)) AS revenue_lost, CAST(coalesce(sum(revenue_delta) FILTER (revenue_delta > 0), 0) AS DECIMAL(38,2)) AS revenue_gained FROM cmp""")
def fn_movement_summary(spark, d):
    return abc.movement_summary(_compared(spark, d))


@query("rm_listing_abc_classes", f"{CURVE} SELECT c.abc_class, count(cv.listing_id) AS members, round(coalesce(sum(share), 0), 4) AS share FROM (VALUES ('A'), ('B'), ('C')) c(abc_class) LEFT JOIN cv USING (abc_class) GROUP BY 1")
def rm_listing_abc_classes(spark, d):
    return abc.class_totals(abc.listing_curve(abc.listing_sales(_window(spark, d))))


@query("agg_report_totals", f", w AS (SELECT * FROM s WHERE sold_at >= {NOW_A} AND sold_at < {NOW_B}) SELECT count(DISTINCT order_id) AS sales_count, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(revenue) AS DECIMAL(38,2)) AS revenue, count(DISTINCT listing_id) AS listings FROM w")
def agg_report_totals(spark, d):
    return _window(spark, d).agg(F.countDistinct("order_id").alias("sales_count"), F.sum("quantity").alias("units"), money(F.sum("revenue")).alias("revenue"), F.countDistinct("listing_id").alias("listings"))


_EDGES = ", ".join(
    f"CAST(coalesce(sum(quantity) FILTER (sold_at >= {a} AND sold_at < {b}), 0) AS BIGINT) AS units_{n}, CAST(coalesce(sum(revenue) FILTER (sold_at >= {a} AND sold_at < {b}), 0) AS DECIMAL(38,2)) AS revenue_{n}"
    for n, a, b in (("now", NOW_A, NOW_B), ("previous", OLD_A, OLD_B), ("entering", OLD_B, NOW_B), ("leaving", OLD_A, NOW_A))
)


@query("win_period_shift", f"SELECT listing_id, {_EDGES} FROM s WHERE sold_at >= {OLD_A} AND sold_at < {NOW_B} GROUP BY 1")
def win_period_shift(spark, d):
    (old, _), (_, end) = abc.window_bounds(DAY, 30, 1), abc.window_bounds(DAY, 30)
    return abc.window_edges(sales(spark, d, abc.in_window(orders(spark, d), old, end)), 30, DAY)


@query("flt_half_open", f"SELECT order_id, account_code, sold_at, status FROM o WHERE sold_at >= {NOW_A} AND sold_at < {NOW_B}")
def flt_half_open(spark, d):
    return abc.in_window(orders(spark, d), *abc.window_bounds(DAY, 30)).select("order_id", "account_code", F.col("sold_at").cast("timestamp_ntz").alias("sold_at"), "status")


_CLOSED = f"sold_at BETWEEN TIMESTAMP '{ANCHOR}' - INTERVAL 30 DAYS AND TIMESTAMP '{ANCHOR}'"


def _closed(spark, d):
    return prod.resolved(sales(spark, d, prod.closed_window(orders(spark, d), ANCHOR)))


@query("flt_closed", f"SELECT order_id, listing_id, sellable_id, quantity FROM s WHERE {_CLOSED}")
def flt_closed(spark, d):
    return _closed(spark, d).select("order_id", "listing_id", "sellable_id", "quantity")


@query("flt_in_list", f"SELECT account_code, count(*) AS orders FROM o WHERE status IN ({', '.join(repr(x) for x in EFFECTIVE)}) GROUP BY 1")
def flt_in_list(spark, d):
    return orders(spark, d).where(F.col("status").isin(EFFECTIVE)).groupBy("account_code").agg(F.count("*").alias("orders"))


@query("flt_null_guard", "SELECT listing_id, product_id, CAST(sum(quantity) AS BIGINT) AS units FROM s WHERE product_id IS NOT NULL GROUP BY 1, 2")
def flt_null_guard(spark, d):
    return sales(spark, d).where(F.col("product_id").isNotNull()).groupBy("listing_id", "product_id").agg(F.sum("quantity").alias("units"))


@query("flt_listing_status", "SELECT listing_id, listing_status, 'INACTIVE' AS kind FROM li WHERE listing_status IS NULL OR listing_status NOT IN ('active', 'paused') UNION ALL SELECT listing_id, listing_status, upper(listing_status) FROM li WHERE listing_status IN ('active', 'paused')")
def flt_listing_status(spark, d):
    rows, s = listings(spark, d), F.col("listing_status")
    inactive = rows.where(s.isNull() | ~s.isin("active", "paused")).withColumn("kind", F.lit("INACTIVE"))
    return inactive.unionByName(rows.where(s.isin("active", "paused")).withColumn("kind", F.upper(s))).select("listing_id", "listing_status", "kind")


@query("flt_ilike_search", "SELECT listing_id, title FROM li WHERE title ILIKE '%' || trim('  1 ') || '%' OR CAST(listing_id AS VARCHAR) ILIKE '%77%'")
def flt_ilike_search(spark, d):
    return listings(spark, d).where(F.col("title").ilike("%1%") | F.col("listing_id").cast("string").ilike("%77%")).select("listing_id", "title")


@query("flt_text_contains", f"{_CMP} SELECT cmp.listing_id, movement FROM cmp JOIN li USING (listing_id) WHERE contains(lower(coalesce(title, '')), 'g') AND movement IN ('IMPROVED', 'DECLINED', 'NEW')")
def flt_text_contains(spark, d):
    return _compared(spark, d).where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("g")) & F.col("movement").isin("IMPROVED", "DECLINED", "NEW")).select("listing_id", "movement")


@query("join_item_order_account", "SELECT account_code, status, count(*) AS items, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(revenue) AS DECIMAL(38,2)) AS revenue FROM s GROUP BY 1, 2")
def join_item_order_account(spark, d):
    return sales(spark, d).groupBy("account_code", "status").agg(F.count("*").alias("items"), F.sum("quantity").alias("units"), money(F.sum("revenue")).alias("revenue"))


@query("join_title_lookup", "SELECT DISTINCT account_code, s.listing_id, li.title FROM s LEFT JOIN li USING (listing_id)")
def join_title_lookup(spark, d):
    keys = sales(spark, d).select("account_code", "listing_id").distinct()
    return keys.join(listings(spark, d).select("listing_id", "title"), "listing_id", "left").select("account_code", "listing_id", "title")


@query("set_distinct_ids", "SELECT DISTINCT listing_id FROM s")
def set_distinct_ids(spark, d):
    return sales(spark, d).select("listing_id").distinct()


@query("src_table_scan", f"SELECT order_id, gross_amount FROM o WHERE account_code = 'C1' AND sold_at >= {NOW_A} ORDER BY gross_amount DESC, order_id LIMIT 50")
def src_table_scan(spark, d):
    start, _ = abc.window_bounds(DAY, 30)
    return orders(spark, d).where((F.col("account_code") == "C1") & (F.col("sold_at") >= start)).select("order_id", "gross_amount").orderBy(F.desc("gross_amount"), "order_id").limit(50)


@query("src_point_lookup", "SELECT order_id, account_code, status, gross_amount FROM o WHERE order_id = 7")
def src_point_lookup(spark, d):
    return orders(spark, d).where("order_id = 7").select("order_id", "account_code", "status", "gross_amount").limit(1)


@query("src_scalar_agg", "SELECT min(sold_at) AS first_sale, max(sold_at) AS last_sale, CAST(sum(gross_amount) AS DECIMAL(38,2)) AS gross FROM o")
def src_scalar_agg(spark, d):
    return orders(spark, d).agg(F.min("sold_at").cast("timestamp_ntz").alias("first_sale"), F.max("sold_at").cast("timestamp_ntz").alias("last_sale"), money(F.sum("gross_amount")).alias("gross"))


# products
_PS = f""", w AS (SELECT *, product_id AS product FROM s WHERE {_CLOSED}),
f AS (SELECT product, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(CASE WHEN account_code = 'C1' THEN quantity ELSE 0 END) AS BIGINT) AS units_c1, CAST(sum(CASE WHEN account_code = 'C2' THEN quantity ELSE 0 END) AS BIGINT) AS units_c2,
  count(DISTINCT order_id) AS orders, max(sold_at) AS last_sale_at FROM w WHERE status = 'PAID' AND product IS NOT NULL GROUP BY 1),
ps AS (SELECT product_id, sku, coalesce(units, 0) AS units, coalesce(units_c1, 0) AS units_c1, coalesce(units_c2, 0) AS units_c2, coalesce(orders, 0) AS orders, last_sale_at FROM pr LEFT JOIN f ON product = product_id),
pc0 AS (SELECT *, row_number() OVER x AS rank, sum(units) OVER () AS total, coalesce(sum(units) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ps WINDOW x AS (ORDER BY units DESC, sku COLLATE pt, product_id)),
pc AS (SELECT *, CASE WHEN total = 0 THEN 0.0 ELSE CAST(before AS DOUBLE) / CAST(total AS DOUBLE) * 100 END AS ahead, CASE WHEN total = 0 THEN 0.0 ELSE CAST(units AS DOUBLE) / CAST(total AS DOUBLE) * 100 END AS share,
  CASE WHEN total = 0 THEN 0.0 ELSE CAST(before + units AS DOUBLE) / CAST(total AS DOUBLE) * 100 END AS cumulative_share FROM pc0),
pk AS (SELECT *, CASE WHEN ahead < 80 THEN 'A' WHEN ahead < 95 THEN 'B' ELSE 'C' END AS abc_class FROM pc)"""


def _ps(spark, d):
    return prod.product_sales(products(spark, d), _closed(spark, d))


def _ntz(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query("agg_product_sales", f"{_PS} SELECT * FROM ps")
def agg_product_sales(spark, d):
    return _ntz(_ps(spark, d))


@query("win_abc_product", f"{_PS} SELECT product_id, sku, units, rank, abc_class, share, cumulative_share FROM pk")
def win_abc_product(spark, d):
    return prod.product_curve(_ps(spark, d)).select("product_id", "sku", "units", "rank", "abc_class", "share", "cumulative_share")


@query("rm_product_abc", f"{_PS} SELECT product_id, sku, units, units_c1, units_c2, orders, last_sale_at, rank, abc_class, share, cumulative_share FROM pk")
def rm_product_abc(spark, d):
    return _ntz(prod.product_curve(_ps(spark, d)))


@query("top_products_20", f"{_PS} SELECT product_id, sku, units, rank FROM pk ORDER BY rank LIMIT 20")
def top_products_20(spark, d):
    return prod.product_curve(_ps(spark, d)).select("product_id", "sku", "units", "rank").orderBy("rank").limit(20)


@query("agg_abc_summary", f"{_PS} SELECT c.abc_class, count(pk.product_id) AS members, CAST(coalesce(sum(units), 0) AS BIGINT) AS units, round(coalesce(sum(share), 0), 4) AS share FROM (VALUES ('A'), ('B'), ('C')) c(abc_class) LEFT JOIN pk USING (abc_class) GROUP BY 1")
def agg_abc_summary(spark, d):
    return abc.class_totals(prod.product_curve(_ps(spark, d)), units=F.col("units"))


@query("agg_conditional_pivot", f"{_PS} SELECT product_id, units_c1, units_c2 FROM f JOIN pr ON product = product_id")
def agg_conditional_pivot(spark, d):
    paid = _closed(spark, d).where((F.col("status") == "PAID") & F.col("product").isNotNull())
    return paid.groupBy(F.col("product").alias("product_id")).pivot("account_code", ["C1", "C2"]).agg(F.sum("quantity")).select("product_id", F.coalesce("C1", F.lit(0)).cast("long").alias("units_c1"), F.coalesce("C2", F.lit(0)).cast("long").alias("units_c2"))


def _dpct(n, d):
    return f"CASE WHEN {d} = 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) * 100 END"


@query("agg_coverage", f"{_PS} SELECT items, items_with_product, items - items_with_product AS items_without_product, units, units_with_product, {_dpct('items_with_product', 'items')} AS items_percent, {_dpct('units_with_product', 'units')} AS units_percent FROM (SELECT count(*) AS items, count(product) AS items_with_product, CAST(sum(quantity) AS BIGINT) AS units, CAST(coalesce(sum(quantity) FILTER (product IS NOT NULL), 0) AS BIGINT) AS units_with_product FROM w)")
def agg_coverage(spark, d):
    return prod.coverage(_closed(spark, d))


@query("agg_status_impact", "SELECT status, count(*) AS orders, CAST(sum(items) AS BIGINT) AS items, CAST(sum(units) AS BIGINT) AS units, CAST(sum(linked) AS BIGINT) AS linked_items, CAST(sum(amount) AS DECIMAL(38,2)) AS amount FROM (SELECT status, order_id, max(gross_amount) AS amount, count(*) AS items, sum(quantity) AS units, count(product_id) AS linked FROM s GROUP BY 1, 2) GROUP BY 1")
def agg_status_impact(spark, d):
    return prod.status_impact(prod.resolved(sales(spark, d)))


@query("agg_link_audit", f"""{_PS}, lp AS (SELECT listing_id, max(product_id) AS listed FROM s GROUP BY 1) SELECT count(*) AS items, count(*) FILTER (product IS NOT NULL AND (listed IS NULL OR listed = product)) AS direct_links,
  count(*) FILTER (product IS NULL AND listed IS NOT NULL) AS listing_links, count(*) FILTER (product IS NULL AND listed IS NULL) AS unlinked, count(*) FILTER (product <> listed) AS conflicts FROM w JOIN lp USING (listing_id)""")
def agg_link_audit(spark, d):
    listed = sales(spark, d).groupBy("listing_id").agg(F.max("product_id").alias("listed"))
    return prod.link_audit(_closed(spark, d).join(listed, "listing_id"), "product", "listed")


@query("join_product_resolve", f"{_PS}, lp AS (SELECT listing_id, max(product_id) AS listed FROM s GROUP BY 1) SELECT order_id, listing_id, sellable_id, coalesce(product, listed) AS product FROM w JOIN lp USING (listing_id)")
def join_product_resolve(spark, d):
    listed = sales(spark, d).groupBy("listing_id").agg(F.max("product_id").alias("listed"))
    return prod.resolved(_closed(spark, d).drop("product").join(listed, "listing_id"), "product_id", "listed").select("order_id", "listing_id", "sellable_id", "product")


@query("join_semi_shared", "SELECT product_id FROM s WHERE product_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT account_code) = 2")
def join_semi_shared(spark, d):
    return prod.shared_products(prod.resolved(sales(spark, d)))


_SH = "sh AS (SELECT product_id FROM s WHERE product_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT account_code) = 2)"


@query("rm_product_abc_comparison", f"{_PS}, {_SH} SELECT product_id, sku, units_c1, units_c2, abs(units_c1 - units_c2) AS difference, {_dpct('abs(units_c1 - units_c2)', '((units_c1 + units_c2) / 2)')} AS difference_percent, {_dpct('units_c1', '(units_c1 + units_c2)')} AS share_c1, {_dpct('units_c2', '(units_c1 + units_c2)')} AS share_c2, row_number() OVER (ORDER BY units DESC, sku COLLATE pt, product_id) AS position FROM pk SEMI JOIN sh USING (product_id)")
def rm_product_abc_comparison(spark, d):
    return prod.account_comparison(prod.product_curve(_ps(spark, d)), prod.shared_products(prod.resolved(sales(spark, d))))


_RANK = f"{_PS}, mem AS (SELECT DISTINCT product_id, account_code AS scope FROM s WHERE product_id IS NOT NULL), r AS (SELECT product_id, sku, 'ALL' AS scope, units AS value FROM pk UNION ALL SELECT product_id, sku, scope, CASE scope WHEN 'C1' THEN units_c1 ELSE units_c2 END FROM pk JOIN mem USING (product_id))"


@query("rm_pi_rankings", f"{_RANK} SELECT *, row_number() OVER (PARTITION BY scope ORDER BY value DESC, sku COLLATE pt, product_id) AS position FROM r")
def rm_pi_rankings(spark, d):
    return prod.rankings(_ps(spark, d), prod.resolved(sales(spark, d)))


@query("win_rank_per_account", f"{_RANK} SELECT product_id, scope, row_number() OVER (PARTITION BY scope ORDER BY value DESC, sku COLLATE pt, product_id) AS position FROM r WHERE scope <> 'ALL'")
def win_rank_per_account(spark, d):
    return rm_pi_rankings(spark, d).where("scope <> 'ALL'").select("product_id", "scope", "position")


_HIST = "h AS (SELECT product_id, max(sold_at) AS last_sale_at FROM s WHERE status = 'PAID' AND product_id IS NOT NULL GROUP BY 1)"


@query("agg_last_sale", f", {_HIST} SELECT * FROM h")
def agg_last_sale(spark, d):
    return _ntz(prod.last_sales(prod.resolved(sales(spark, d))))


@query("rm_pi_products", f"{_PS}, {_HIST} SELECT product_id, sku, units, rank, abc_class, h.last_sale_at FROM pk LEFT JOIN h USING (product_id)")
def rm_pi_products(spark, d):
    curve = prod.product_curve(_ps(spark, d)).select("product_id", "sku", "units", "rank", "abc_class")
    return _ntz(curve.join(prod.last_sales(prod.resolved(sales(spark, d))), "product_id", "left"))


@query("rm_pi_alerts", f"{_PS}, {_HIST}, al AS (SELECT product_id, sku, h.last_sale_at, greatest(0, date_diff('day', CAST(h.last_sale_at - INTERVAL 3 HOURS AS DATE), DATE '2001-07-31')) AS n FROM pk LEFT JOIN h USING (product_id) WHERE units = 0) SELECT product_id, sku, last_sale_at, CAST(CASE WHEN last_sale_at IS NOT NULL THEN n END AS BIGINT) AS days_since_sale FROM al WHERE last_sale_at IS NULL OR n >= 30")
def rm_pi_alerts(spark, d):
    return _ntz(prod.stale_products(prod.product_curve(_ps(spark, d)), prod.last_sales(prod.resolved(sales(spark, d))), ANCHOR))


@query("rm_pi_comparison", f"{_PS}, ref AS (SELECT product_id, account_code, list_sort(list(DISTINCT listing_id)) AS ids FROM s WHERE product_id IS NOT NULL GROUP BY 1, 2) SELECT product_id, account_code, CAST(len(ids) AS BIGINT) AS listings, array_to_string(ids, ',') AS listing_ids FROM ref")
def rm_pi_comparison(spark, d):
    ref = prod.resolved(sales(spark, d)).where("product is not null").groupBy(F.col("product").alias("product_id"), "account_code").agg(F.array_sort(F.collect_set("listing_id")).alias("ids"))
    return ref.select("product_id", "account_code", F.size("ids").cast("long").alias("listings"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("listing_ids"))


@query("fn_percentage_dec", f", t AS (SELECT account_code, CAST(sum(quantity) AS BIGINT) AS units FROM s GROUP BY 1) SELECT account_code, {pct('units', '(SELECT sum(units) FROM t)')} AS share FROM t")
def fn_percentage_dec(spark, d):
    t = sales(spark, d).groupBy("account_code").agg(F.sum("quantity").alias("units"))
    return t.join(F.broadcast(t.agg(F.sum("units").alias("total")))).select("account_code", percentage("units", "total").alias("share"))


@query("fn_percentage_dbl", f", t AS (SELECT account_code, CAST(sum(quantity) AS BIGINT) AS units FROM s GROUP BY 1) SELECT account_code, {_dpct('units', '(SELECT sum(units) FROM t)')} AS share FROM t")
def fn_percentage_dbl(spark, d):
    t = sales(spark, d).groupBy("account_code").agg(F.sum("quantity").alias("units"))
    return t.join(F.broadcast(t.agg(F.sum("units").alias("total")))).select("account_code", ratio_percent("units", "total").alias("share"))


@query("fn_revenue", "SELECT order_id, CAST(sum(revenue) AS DECIMAL(38,2)) AS revenue FROM s GROUP BY 1")
def fn_revenue(spark, d):
    return sales(spark, d).groupBy("order_id").agg(money(F.sum("revenue")).alias("revenue"))


@query("prj_item_gross", "SELECT order_id, listing_id, sellable_id, coalesce(CASE WHEN sellable_id % 3 <> 0 THEN item_gross END, CAST(revenue AS DECIMAL(38,2))) AS gross FROM s")
def prj_item_gross(spark, d):
    return sales(spark, d).select("order_id", "listing_id", "sellable_id", F.coalesce(F.when(F.col("sellable_id") % 3 != 0, F.col("item_gross")), F.col("revenue").cast("decimal(38,2)")).alias("gross"))


_COMMON = "SELECT {} AS name FROM cmp"


@query("fn_transition", f"{_CMP} SELECT transition, count(*) AS listings FROM cmp WHERE transition IS NOT NULL GROUP BY 1")
def fn_transition(spark, d):
    return _compared(spark, d).where("transition is not null").groupBy("transition").agg(F.count("*").alias("listings"))


@query("fn_class_movement", f"{_CMP} SELECT movement, count(*) AS listings FROM cmp GROUP BY 1")
def fn_class_movement(spark, d):
    return _compared(spark, d).groupBy("movement").agg(F.count("*").alias("listings"))


@query("fn_revenue_movement", f"{_CMP} SELECT revenue_movement, count(*) AS listings FROM cmp GROUP BY 1")
def fn_revenue_movement(spark, d):
    return _compared(spark, d).groupBy("revenue_movement").agg(F.count("*").alias("listings"))


@query("fn_delta_percent", f"{_CMP} SELECT listing_id, revenue_delta_percent FROM cmp")
def fn_delta_percent(spark, d):
    return _compared(spark, d).select("listing_id", "revenue_delta_percent")


@query("sort_transition_priority", f"{_CMP} SELECT listing_id, transition, revenue_delta, row_number() OVER (ORDER BY CASE transition WHEN 'A_TO_C' THEN 1 WHEN 'A_TO_B' THEN 2 ELSE 3 END, revenue_delta, listing_id) AS position FROM cmp WHERE movement = 'DECLINED'")
def sort_transition_priority(spark, d):
    t = F.col("transition")
    first = F.when(t == "A_TO_C", 1).when(t == "A_TO_B", 2).otherwise(3)
    rows = _compared(spark, d).where("movement = 'DECLINED'").select("listing_id", "transition", "revenue_delta")
    return ranked(rows, first, F.asc("revenue_delta"), F.asc("listing_id"), name="position")
