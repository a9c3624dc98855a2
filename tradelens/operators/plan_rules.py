"""The rules that a product plan must keep before anything is written: evidence, canonical keys, independent support.

Tables of a plan, with keys that are not null:

- candidates: candidate_id, sku, group_key, classification, action, status, blockers (count), gtin,
  reuse_id, listing_item_count, accounts (list), evidence (list), erp_products (list of (account,
  erp_product_id)), audit (matches, unlinked, paid_orders, paid_units, order_ids, consistent, divergent).
- links: candidate_id, item_id, account, business_id, listing_id, variation_id, sellable_id,
  seller_sku, erp_product_id, erp_sku, evidence, correlated_orders, conflicting_orders.
- identities: candidate_id, sku, business_id, provider, seller_sku, listing_id, variation_id,
  item_id, action, existing_id.
- support: candidate_id, item_id, market_order_id, erp_order_id, erp_product_id: the orders behind a link.

A rule is a condition over one row (a candidate with what its parts add up to, a link with its
support, a planned identity beside the derived one), so all rules of a kind are judged together
and each part is shuffled once, by candidate. A condition that is null counts as broken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classifications, actions, evidence names, providers and key formats of a plan.
HIGH, PROMOTED, CORRELATED = "HIGH", "PROMOTABLE_TO_HIGH", "DETERMINISTIC_HIGH"
CREATE, REUSE = "CREATE_PRODUCT_AND_LINK", "REUSE_HIGH_PRODUCT_AND_LINK"
EVIDENCE = {HIGH: ["ORDER_PRODUCT_ID", "GTIN_UNIQUE"], PROMOTED: ["OLIST_SKU_EXACT_UNIQUE", "PAID_ORDER_SELLER_SKU_CORROBORATION"], CORRELATED: ["ORDER_PRODUCT_ID"]}
LINK_EVIDENCE = {HIGH: ["ORDER_PRODUCT_ID", "GTIN_UNIQUE"], PROMOTED: ["OLIST_SKU_EXACT_UNIQUE_PLUS_MULTIPLE_PAID_ORDERS"], CORRELATED: ["ORDER_PRODUCT_ID"]}
MARKET, ERP = "MERCADO_LIVRE", "OLIST"
ID_FORMAT, GTIN_FORMAT = "^PC-HIGH-[A-Z0-9][A-Z0-9-]*$", "^[0-9]{8,14}$"
GTIN_SKU, GTIN_GROUP, ERP_SKU, ERP_GROUP = "PRD-GTIN-%s", "GTIN:%s", "PRD-OLIST-%s-%s", "%s:OLIST:%s"
LEAST_ORDERS = 2

IDENTITY_KEY = ["business_id", "provider", "listing_id", "variation_id"]


def broken(rows: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, subject) for every row and rule whose condition does not hold."""
    names = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items())))
    return rows.select(F.explode(names).alias("rule"), F.col(subject).cast("string").alias("subject"))


def _by_class(table: dict[str, Column]) -> Column:
    """The condition of the row's classification; no condition for others."""
    out = F.lit(True)
    for name, holds in table.items():
        out = F.when(F.col("classification") == name, holds).otherwise(out)
    return out


def derived_identities(links: DataFrame) -> DataFrame:
    """The identities that links call for: one of the market for each item, one of the ERP for each of its products.

    Items of one ERP product must agree on its SKU (``agree``).
    """
    market = links.select("candidate_id", "business_id", F.lit(MARKET).alias("provider"), "seller_sku", "listing_id", "variation_id", "item_id")
    none = F.lit(None).cast("string")
    erp = links.select("candidate_id", "business_id", F.lit(ERP).alias("provider"), F.col("erp_sku").alias("seller_sku"), F.col("erp_product_id").alias("listing_id"), none.alias("variation_id"), F.col("item_id").alias("of"))
    first = erp.groupBy("candidate_id", "business_id", "provider", "listing_id", "variation_id").agg(F.min_by("seller_sku", "of").alias("seller_sku"), (F.min("seller_sku").eqNullSafe(F.max("seller_sku")) & ((F.count("seller_sku") == 0) | (F.count("seller_sku") == F.count("*")))).alias("agree"))
    return market.withColumn("agree", F.lit(True)).unionByName(first, allowMissingColumns=True)


def candidate_rules() -> dict[str, Column]:
    """Conditions over a candidate with the sums of its links and identities."""
    c, later = F.col, F.col("classification").isin(PROMOTED, CORRELATED)
    allowed = lambda table: {k: F.size(F.array_except("evidence", F.array(*map(F.lit, v)))) == 0 for k, v in table.items()}
    whole = {k: (F.size("evidence") > 0 if k == HIGH else F.size("evidence") == len(EVIDENCE[k])) & only & (F.size(F.array_distinct("evidence")) == F.size("evidence") if k == PROMOTED else F.lit(True)) for k, only in allowed(EVIDENCE).items()}
    erp_key = (c("sku") == F.format_string(ERP_SKU, c("account"), c("erp_product_id"))) & (c("group_key") == F.format_string(ERP_GROUP, c("account"), c("erp_product_id")))
    single = (c("n_links") == 1) & erp_key
    gtin_key = c("gtin").rlike(GTIN_FORMAT) & (c("sku") == F.format_string(GTIN_SKU, c("gtin"))) & (c("group_key") == F.format_string(GTIN_GROUP, c("gtin")))
    one_product = (c("kinds") == 1) & (F.size("accounts") == 1) & (c("accounts")[0] == c("account")) & (F.size("erp_products") == 1) & (F.get("erp_products", F.lit(0))["account"] == c("account")) & (F.get("erp_products", F.lit(0))["erp_product_id"] == c("erp_product_id"))
    acts = F.when(c("action") == CREATE, c("reuse_id").isNull()).otherwise((c("action") == REUSE) & c("reuse_id").isNotNull())
    audit = c("audit")
    audited = (
        (audit["matches"] == 1) & (audit["unlinked"] == 1) & (audit["paid_orders"] >= LEAST_ORDERS) & (audit["paid_units"] >= 1)
        & (F.size(audit["order_ids"]) >= LEAST_ORDERS) & audit["consistent"] & (audit["divergent"] == 0)
    )
    return {
        "CANDIDATE_ID": c("candidate_id").rlike(ID_FORMAT),
        "CLASSIFICATION": c("classification").isin(*EVIDENCE),
        "READY": (c("status") == "READY") & (c("blockers") == 0) & (c("n_links") > 0) & (c("listing_item_count") == c("n_links")),
        "ACCOUNTS": (F.size(F.array_distinct("accounts")) == F.size("accounts")) & (c("strange_accounts") == 0),
        "EVIDENCE": _by_class(whole) & (c("strange_evidence") == 0),
        "CANONICAL_KEY": _by_class({HIGH: F.when(c("gtin").isNotNull(), gtin_key).otherwise(single), PROMOTED: single, CORRELATED: erp_key & one_product}),
        "PRODUCT_ACTION": _by_class({HIGH: c("action") == CREATE, PROMOTED: acts, CORRELATED: acts}),
        "AUDIT": _by_class({PROMOTED: audited}),
        "REUSE_IDENTITIES": F.when(later, (c("action") == CREATE) == (c("already_correct") == 0)).otherwise(True),
    }


def link_rules() -> dict[str, Column]:
    """Conditions over a link with its candidate and its support."""
    c = F.col
    enough = (c("orders") >= LEAST_ORDERS) & (c("correlated_orders") == c("orders")) & (c("conflicting_orders") == 0)
    return {
        "SELLABLE": c("sellable_id") == F.coalesce("variation_id", "listing_id"),
        "ERP_PRODUCT": F.exists("erp_products", lambda p: (p["account"] == c("account")) & (p["erp_product_id"] == c("erp_product_id"))),
        "ORDER_SUPPORT": _by_class({CORRELATED: enough}),
        "INDEPENDENT_ORDERS": _by_class({CORRELATED: (c("market_orders") == c("orders")) & (c("erp_orders") == c("orders"))}),
        "SUPPORTED_PRODUCT": _by_class({CORRELATED: c("other_products") == 0}),
    }


def identity_rules() -> dict[str, Column]:
    """Conditions over a planned identity beside the derived one of its key; either may be missing."""
    c = F.col
    same = c("seller_sku").eqNullSafe(c("own_sku")) & c("item_id").eqNullSafe(c("own_item")) & c("sku").eqNullSafe(c("candidate_sku"))
    acts = F.when(c("action") == "CREATE", c("existing_id").isNull()).otherwise((c("action") == "ALREADY_CORRECT") & c("existing_id").isNotNull() & (c("provider") == ERP))
    return {"PLANNED_IDENTITY": c("derived") & c("planned") & same, "AGREED_IDENTITY": F.coalesce("agree", F.lit(True)), "IDENTITY_ACTION": F.when(c("planned"), acts).otherwise(True)}


def support_of(support: DataFrame) -> DataFrame:
    """Orders of each link: all, different ones of either side, and those that name another product than most of the link's."""
    return support.groupBy("candidate_id", "item_id").agg(
        F.count("*").alias("orders"), F.count_distinct("market_order_id").alias("market_orders"), F.count_distinct("erp_order_id").alias("erp_orders"),
        F.min("erp_product_id").alias("least_product"), F.max("erp_product_id").alias("most_product"), F.count_if(F.col("erp_product_id").isNull()).alias("no_product"),
    )


def evidence_faults(candidates: DataFrame, links: DataFrame, identities: DataFrame, support: DataFrame) -> DataFrame:
    """(rule, subject): the subject is a candidate, a link's item, or the key of an identity behind its candidate."""
    own = candidates.select("candidate_id", "classification", "accounts", "erp_products")
    backed = links.join(own, "candidate_id").join(support_of(support), ["candidate_id", "item_id"], "left")
    counts = {n: F.coalesce(n, F.lit(0)) for n in ("orders", "market_orders", "erp_orders", "no_product")}
    backed = backed.withColumns(counts)
    apart = (F.col("least_product") != F.col("erp_product_id")) | (F.col("most_product") != F.col("erp_product_id")) | (F.col("no_product") > 0)
    backed = backed.withColumn("other_products", F.when(F.col("orders") == 0, 0).otherwise(F.coalesce(apart, F.lit(True)).cast("int")))
    strange = _by_class({k: F.col("evidence").isin(*v) for k, v in LINK_EVIDENCE.items()})
    by_links = backed.groupBy("candidate_id").agg(
        F.count("*").alias("n_links"), F.count_if(~F.array_contains("accounts", F.col("account"))).alias("strange_accounts"), F.count_if(~F.coalesce(strange, F.lit(False))).alias("strange_evidence"),
        F.min("account").alias("account"), F.min("erp_product_id").alias("erp_product_id"),
        F.when((F.min("account") == F.max("account")) & (F.min("business_id") == F.max("business_id")) & (F.min("erp_product_id") == F.max("erp_product_id")), 1).otherwise(2).alias("kinds"),
    )
    by_identities = identities.groupBy("candidate_id").agg(F.count_if(F.col("action") == "ALREADY_CORRECT").alias("already_correct"))
    whole = candidates.join(by_links, "candidate_id", "left").join(by_identities, "candidate_id", "left")
    whole = whole.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_links", "strange_accounts", "strange_evidence", "already_correct")})

    later = candidates.where(F.col("classification").isin(PROMOTED, CORRELATED)).select("candidate_id", F.col("sku").alias("candidate_sku"))
    key = ["candidate_id", *IDENTITY_KEY]
    null_safe = lambda rows: rows.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in IDENTITY_KEY})
    wanted = null_safe(derived_identities(links.join(later.select("candidate_id"), "candidate_id", "left_semi"))).select(*key, F.col("seller_sku").alias("own_sku"), F.col("item_id").alias("own_item"), "agree", F.lit(True).alias("derived"))
    planned = null_safe(identities.join(later.select("candidate_id"), "candidate_id", "left_semi")).select(*key, "sku", "seller_sku", "item_id", "action", "existing_id", F.lit(True).alias("planned"))
    beside = planned.join(wanted, key, "full").join(later, "candidate_id")
    beside = beside.withColumns({"planned": F.coalesce("planned", F.lit(False)), "derived": F.coalesce("derived", F.lit(False)), "key": F.concat_ws("|", *key)})

    faults = [broken(whole, "candidate_id", candidate_rules()), broken(backed, "item_id", link_rules()), broken(beside, "key", identity_rules())]
    groups = candidates.groupBy("group_key").agg(F.count("*").alias("n"))
    faults.append(groups.where("n > 1").select(F.lit("REPEATED_GROUP").alias("rule"), F.col("group_key").alias("subject")))
    return reduce(DataFrame.unionByName, faults)


def declared_faults(candidates: DataFrame, links: DataFrame, identities: DataFrame, declared: dict[str, int]) -> DataFrame:
    """(rule, subject) for each total of ``declared`` that the plan does not have; one row of totals is compared."""
    both = F.array_contains("accounts", "C1") & F.array_contains("accounts", "C2")
    one = candidates.agg(
        F.count("*").alias("productCandidates"), F.count_if(F.col("action") == CREATE).alias("productsToCreate"), F.count_if(F.col("action") == REUSE).alias("productsToReuse"),
        F.count_if(both).alias("bothAccounts"), F.count_if((F.col("status") == "READY") & (F.col("blockers") == 0)).alias("ready"),
    )
    new = identities.where("action = 'CREATE'").agg(
        F.count_if(F.col("provider") == MARKET).alias("marketIdentities"), F.count_if(F.col("provider") == ERP).alias("erpIdentities"), F.count("*").alias("externalIdentities"),
    )
    totals = one.crossJoin(F.broadcast(new)).crossJoin(F.broadcast(links.agg(F.count("*").alias("listingItems"))))  # one row each
    names = F.array(*(F.when(F.col(n) != v, n) for n, v in declared.items()))
    return totals.select(F.lit("DECLARED_COUNT").alias("rule"), F.explode(F.array_compact(names)).alias("subject"))
