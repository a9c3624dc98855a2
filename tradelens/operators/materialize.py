"""Materialisation of products from an approved plan: checks of the plan, comparison with the state, guarded writes.

A plan has candidates (candidate_id, sku, name, reuse_id), links (candidate_id, item_id, seller_sku) and
identities (candidate_id, identity_key). The state has products (product_id, sku, name), items (item_id,
seller_sku, product_id) and identities (identity_key, product_id). Keys must not be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_faults(candidates: DataFrame, links: DataFrame, identities: DataFrame, declared: dict[str, int]) -> DataFrame:
    """Broken rules of a plan as (rule, subject): repeated or homeless keys, candidates without links, wrong counts."""

    def repeated(rows, key, rule):
        n = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        return n.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("subject"))

    def homeless(rows, rule):
        lost = rows.join(candidates.select("candidate_id"), "candidate_id", "left_anti").select("candidate_id").distinct()
        return lost.select(F.lit(rule).alias("rule"), F.col("candidate_id").cast("string").alias("subject"))

    def count(rows, name):
        return rows.agg(F.count("*").alias("n")).where(F.col("n") != declared[name]).select(F.lit("DECLARED_COUNT").alias("rule"), F.lit(name).alias("subject"))

    empty = candidates.join(links.select("candidate_id"), "candidate_id", "left_anti").select(F.lit("NO_LINKS").alias("rule"), F.col("candidate_id").cast("string").alias("subject"))
    parts = {"candidates": candidates, "links": links, "identities": identities}
    faults = [
        repeated(candidates, "candidate_id", "REPEATED_CANDIDATE"), repeated(candidates, "sku", "REPEATED_SKU"), repeated(links, "item_id", "REPEATED_ITEM"),
        repeated(identities, "identity_key", "REPEATED_IDENTITY"), homeless(links, "LINK_WITHOUT_CANDIDATE"), homeless(identities, "IDENTITY_WITHOUT_CANDIDATE"),
        empty, *(count(parts[n], n) for n in declared),
    ]
    return reduce(DataFrame.unionByName, faults)


def targets(candidates: DataFrame, products: DataFrame) -> DataFrame:
    """candidate_id, sku, name, target_id and outcome: CREATE, REUSE, or CONFLICT.

    A candidate that names a product to reuse needs that product under the same sku; one that names none
    takes the product of its sku if the names agree, and is created without one.
    """
    by_sku = products.select("sku", F.col("product_id").alias("sku_id"), F.col("name").alias("sku_name"))
    by_id = products.select(F.col("product_id").alias("reuse_id"), F.col("sku").alias("id_sku"))
    rows = candidates.select("candidate_id", "sku", "name", "reuse_id").join(by_sku, "sku", "left").join(by_id, "reuse_id", "left")
    outcome = (
        F.when(F.col("reuse_id").isNotNull(), F.when(F.col("id_sku").eqNullSafe(F.col("sku")) & F.col("sku_id").eqNullSafe(F.col("reuse_id")), "REUSE").otherwise("CONFLICT"))
        .when(F.col("sku_id").isNull(), "CREATE")
        .when(F.col("sku_name").eqNullSafe(F.col("name")), "REUSE")
        .otherwise("CONFLICT")
    )
    rows = rows.withColumn("outcome", outcome)
    return rows.select("candidate_id", "sku", "name", F.when(F.col("outcome") == "REUSE", F.col("sku_id")).alias("target_id"), "outcome")


def link_outcomes(found: DataFrame, links: DataFrame, items: DataFrame) -> DataFrame:
    """candidate_id, item_id, outcome: CREATE, ALREADY_CORRECT, or CONFLICT (missing, changed, or another product's).

    ``found`` comes from ``targets``.
    """
    now = items.select("item_id", F.col("seller_sku").alias("now_sku"), "product_id", F.lit(True).alias("_found"))
    rows = links.join(found.select("candidate_id", "target_id"), "candidate_id", "left").join(now, "item_id", "left")
    outcome = (
        F.when(F.col("_found").isNull() | ~F.col("now_sku").eqNullSafe(F.col("seller_sku")), "CONFLICT")
        .when(F.col("product_id").isNull(), "CREATE")
        .when(F.col("product_id") == F.col("target_id"), "ALREADY_CORRECT")
        .otherwise("CONFLICT")
    )
    return rows.select("candidate_id", "item_id", outcome.alias("outcome"))


def identity_outcomes(found: DataFrame, planned: DataFrame, stored: DataFrame) -> DataFrame:
    """candidate_id, identity_key, outcome: CREATE, ALREADY_CORRECT, or CONFLICT (another product's, or more than one row)."""
    now = stored.groupBy("identity_key").agg(F.count("*").alias("n"), F.max("product_id").alias("owner"))
    rows = planned.join(found.select("candidate_id", "target_id"), "candidate_id", "left").join(now, "identity_key", "left")
    right = (F.col("n") == 1) & (F.col("owner") == F.col("target_id"))
    outcome = F.when(F.col("n").isNull(), "CREATE").when(right, "ALREADY_CORRECT").otherwise("CONFLICT")
    return rows.select("candidate_id", "identity_key", outcome.alias("outcome"))


def outcomes(found: DataFrame, links: DataFrame, identities: DataFrame) -> DataFrame:
    """Counts of all outcomes by kind: what a dry run reports."""
    kinds = [d.select(F.lit(k).alias("kind"), "outcome") for k, d in (("product", found), ("link", links), ("identity", identities))]
    return reduce(DataFrame.unionByName, kinds).groupBy("kind", "outcome").agg(F.count("*").alias("n"))


def applied_items(items: DataFrame, links: DataFrame, products: DataFrame, candidates: DataFrame) -> DataFrame:
    """``items`` after the plan: only items without a product are linked, and candidates with a conflict write nothing.

    ``links`` comes from ``link_outcomes``; ``products`` holds the created ones too.
    """
    blocked = links.where("outcome = 'CONFLICT'").select("candidate_id").distinct()
    todo = links.where("outcome = 'CREATE'").join(blocked, "candidate_id", "left_anti").join(candidates.select("candidate_id", "sku"), "candidate_id")
    new = todo.join(products.select("sku", F.col("product_id").alias("_new")), "sku").select("item_id", "_new")
    return items.join(new, "item_id", "left").withColumn("product_id", F.coalesce("product_id", "_new")).drop("_new")
