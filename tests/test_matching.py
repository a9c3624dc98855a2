"""Lines of matched orders and references of packs against plain versions."""

import random

from pyspark.sql import functions as F

from tradelens.operators import matching as mt


def plain_alignment(ours, theirs):
    """Lines are paired greedily, key by key, in the order of their numbers."""
    left, right, pairs = dict(enumerate(ours, 1)), dict(enumerate(theirs, 1)), []
    for level, key in enumerate(mt.LINE_KEYS, 1):
        at = [("sku", "unit_price", "quantity").index(k) for k in key]
        for i in list(left):
            j = next((j for j in right if all(left[i][a] is not None and left[i][a] == right[j][a] for a in at)), None)
            if j is not None:
                pairs.append((level, i, j))
                del left[i], right[j]
    return sorted(pairs, key=repr) + sorted([(None, i, None) for i in left] + [(None, None, j) for j in right], key=repr)


def test_lines_of_matched_orders_are_assigned_one_to_one(spark):
    rng = random.Random(4)

    def some(n):
        return [(rng.choice(["A", "B", None]), rng.choice([5, 6, None]), rng.choice([1, 2])) for _ in range(n)]

    orders = {i: (some(rng.randrange(7)), some(rng.randrange(7))) for i in range(40)}
    orders[99] = ([("A", 5, 1)] * 300, [("A", 5, 2)] * 200 + [("A", 5, 1)] * 50)
    matches = spark.createDataFrame([(i, f"m{i}") for i in orders], "erp_id long, order_id string")
    ddl = "line int, sku string, unit_price int, quantity int"
    ours = spark.createDataFrame([(i, n, *x) for i, (a, _) in orders.items() for n, x in enumerate(a)], f"erp_id long, {ddl}")
    theirs = spark.createDataFrame([(f"m{i}", n, *x) for i, (_, b) in orders.items() for n, x in enumerate(b)], f"order_id string, {ddl}")
    got = {}
    for r in mt.aligned_lines(matches, ours, theirs).collect():
        got.setdefault(r.erp_id, []).append((r.level, r.erp_line and r.erp_line.line, r.market_line and r.market_line.line))
    for i, (a, b) in orders.items():
        rows = got.get(i, [])
        assert sorted([r for r in rows if r[0]], key=repr) + sorted([r for r in rows if not r[0]], key=repr) == plain_alignment(a, b)


def most_rows(df):
    """The largest number of rows that any operator of the executed plan gave."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        own = node.metrics().get("numOutputRows")
        below = [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        return max([own.get().value() if own.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_pack_of_many_orders_named_by_many_makes_no_pairs(spark):
    n = 2000
    market = spark.range(n).select(F.concat(F.lit("o"), "id").alias("order_id"), F.lit("pack").alias("pack_id")).unionByName(spark.createDataFrame([("alone", None)], "order_id string, pack_id string"))
    erp = spark.range(n).select(F.col("id").alias("erp_id"), F.lit("pack").alias("ecommerce_id"), F.lit(None).cast("string").alias("channel_id"))
    erp = erp.unionByName(spark.createDataFrame([(n, "alone", None), (n + 1, "nothing", None)], erp.schema))
    records = spark.createDataFrame([("pack",), ("o7",), ("alone",), ("nothing",), ("alone",)], "order_reference string")
    out = mt.three_way(records, erp, market)
    assert most_rows(out) <= 4 * (2 * n + 3)
    assert {r.order_reference: r.status for r in out.collect()} == {"pack": "AMBIGUOUS", "o7": "AMBIGUOUS", "alone": "MATCHED_EXACT", "nothing": "UNMATCHED"}


def test_lines_are_aligned_in_as_many_tasks_as_are_set(spark):
    """Small partitions are not merged: the sorts of a task all hold its rows."""
    rows = spark.range(400).selectExpr("id as erp_id", "concat('m', id) as order_id", "1 as line", "'A' as sku", "5 as unit_price", "1 as quantity")
    lines = ("line", "sku", "unit_price", "quantity")
    out = mt.aligned_lines(rows.select("erp_id", "order_id"), rows.select("erp_id", *lines), rows.select("order_id", *lines))
    parts = {r.p for r in out.select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert out.count() == 400 and len(parts) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
