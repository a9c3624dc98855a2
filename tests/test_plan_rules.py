"""Rules of a product plan: one broken rule at a time."""

from tradelens.operators import plan_rules as rules

CANDIDATE = {
    "candidate_id": "PC-HIGH-1", "sku": "PRD-OLIST-C1-E1", "group_key": "C1:OLIST:E1", "classification": rules.CORRELATED, "action": rules.CREATE, "status": "READY", "blockers": 0, "gtin": None, "reuse_id": None,
    "listing_item_count": 1, "accounts": ["C1"], "evidence": ["ORDER_PRODUCT_ID"], "erp_products": [("C1", "E1")], "audit": None,
}
LINK = {
    "candidate_id": "PC-HIGH-1", "item_id": "I1", "account": "C1", "business_id": "B1", "listing_id": "M1", "variation_id": None, "sellable_id": "M1", "seller_sku": None, "erp_product_id": "E1", "erp_sku": "K1",
    "evidence": "ORDER_PRODUCT_ID", "correlated_orders": 2, "conflicting_orders": 0,
}
IDENTITIES = [("PC-HIGH-1", "PRD-OLIST-C1-E1", "B1", rules.MARKET, None, "M1", None, "I1", "CREATE", None), ("PC-HIGH-1", "PRD-OLIST-C1-E1", "B1", rules.ERP, "K1", "E1", None, None, "CREATE", None)]
SUPPORT = [("PC-HIGH-1", "I1", "m1", "e1", "E1"), ("PC-HIGH-1", "I1", "m2", "e2", "E1")]
PAID = (1, 1, 2, 3, ["o1", "o2"], True, 0)

CANDIDATE_DDL = """candidate_id string, sku string, group_key string, classification string, action string, status string, blockers int, gtin string, reuse_id string, listing_item_count int, accounts array<string>, evidence array<string>,
erp_products array<struct<account string, erp_product_id string>>, audit struct<matches int, unlinked int, paid_orders int, paid_units int, order_ids array<string>, consistent boolean, divergent int>"""
LINK_DDL = "candidate_id string, item_id string, account string, business_id string, listing_id string, variation_id string, sellable_id string, seller_sku string, erp_product_id string, erp_sku string, evidence string, correlated_orders int, conflicting_orders int"
IDENTITY_DDL = "candidate_id string, sku string, business_id string, provider string, seller_sku string, listing_id string, variation_id string, item_id string, action string, existing_id string"
SUPPORT_DDL = "candidate_id string, item_id string, market_order_id string, erp_order_id string, erp_product_id string"


def faults(spark, candidates, links, identities=IDENTITIES, support=SUPPORT):
    frames = [
        spark.createDataFrame([tuple(c.values()) for c in candidates], CANDIDATE_DDL), spark.createDataFrame([tuple(x.values()) for x in links], LINK_DDL),
        spark.createDataFrame(identities, IDENTITY_DDL), spark.createDataFrame(support, SUPPORT_DDL),
    ]
    return sorted((r.rule, r.subject) for r in rules.evidence_faults(*frames).collect())


def test_a_sound_plan_has_no_faults(spark):
    promoted = CANDIDATE | {"classification": rules.PROMOTED, "evidence": rules.EVIDENCE[rules.PROMOTED][::-1], "audit": PAID}
    high = CANDIDATE | {"classification": rules.HIGH, "gtin": "12345678", "sku": "PRD-GTIN-12345678", "group_key": "GTIN:12345678", "evidence": ["GTIN_UNIQUE", "ORDER_PRODUCT_ID"]}
    assert faults(spark, [CANDIDATE], [LINK]) == []
    assert faults(spark, [promoted], [LINK | {"evidence": rules.LINK_EVIDENCE[rules.PROMOTED][0]}], support=[]) == []
    assert faults(spark, [high], [LINK, LINK | {"item_id": "I2"}][:1], identities=[], support=[]) == []


BROKEN = [
    ("CANDIDATE_ID", {"candidate_id": "PC-HIGH-"}, {"candidate_id": "PC-HIGH-"}), ("CLASSIFICATION", {"classification": "LOW"}, {}), ("READY", {"status": "BLOCKED"}, {}), ("READY", {"blockers": 1}, {}), ("READY", {"listing_item_count": 2}, {}),
    ("ACCOUNTS", {"accounts": ["C1", "C1"]}, {}), ("ACCOUNTS", {"accounts": ["C2"]}, {}), ("EVIDENCE", {"evidence": []}, {}), ("EVIDENCE", {"evidence": ["TITLE"]}, {}), ("EVIDENCE", {"evidence": None}, {}), ("EVIDENCE", {}, {"evidence": "GTIN_UNIQUE"}),
    ("CANONICAL_KEY", {"sku": "PRD-OLIST-C1-E2"}, {}), ("CANONICAL_KEY", {"group_key": "C1:OLIST:E2"}, {}), ("CANONICAL_KEY", {"erp_products": [("C1", "E1"), ("C1", "E2")]}, {}), ("PRODUCT_ACTION", {"reuse_id": "P1"}, {}), ("PRODUCT_ACTION", {"action": rules.REUSE}, {}),
    ("REUSE_IDENTITIES", {"action": rules.REUSE, "reuse_id": "P1"}, {}), ("SELLABLE", {}, {"sellable_id": "V1"}), ("SELLABLE", {}, {"variation_id": "V1"}), ("ERP_PRODUCT", {}, {"erp_product_id": "E2"}), ("ERP_PRODUCT", {"erp_products": []}, {}),
    ("ORDER_SUPPORT", {}, {"correlated_orders": 3}), ("ORDER_SUPPORT", {}, {"conflicting_orders": 1}), ("SUPPORTED_PRODUCT", {}, {"erp_product_id": "E2"}), ("PLANNED_IDENTITY", {}, {"seller_sku": "S"}), ("PLANNED_IDENTITY", {}, {"listing_id": "M2", "sellable_id": "M2"}),
]


def test_each_broken_rule_is_told(spark):
    candidates, links, identities, support = [], [], [], []
    for n, (_, candidate, link) in enumerate(BROKEN):
        name, item = candidate.get("candidate_id", "PC-HIGH-1") + ("" if candidate.get("candidate_id") else str(n)), f"I{n}"
        candidates.append(CANDIDATE | candidate | {"candidate_id": name})
        links.append(LINK | link | {"candidate_id": name, "item_id": item})
        identities += [(name, *x[1:7], x[7] and item, *x[8:]) for x in IDENTITIES]
        support += [(name, item, *x[2:]) for x in SUPPORT]
    got = faults(spark, candidates, links, identities, support)
    for n, (rule, *_) in enumerate(BROKEN):
        own = {candidates[n]["candidate_id"], f"I{n}"}
        assert rule in {r for r, subject in got if own & set(subject.split("|"))}, (n, rule)


def test_support_counts_different_orders_of_both_sides(spark):
    def of(*rows):
        return [r for r in faults(spark, [CANDIDATE], [LINK], support=[("PC-HIGH-1", "I1", *r) for r in rows]) if r[1] == "I1"]

    assert of(("m1", "e1", "E1"), ("m2", "e1", "E1")) == of(("m1", "e1", "E1"), ("m1", "e2", "E1")) == [("INDEPENDENT_ORDERS", "I1")]
    assert of(("m1", "e1", "E1")) == [("ORDER_SUPPORT", "I1")] == of()
    assert of(("m1", "e1", "E1"), ("m2", "e2", None)) == [("SUPPORTED_PRODUCT", "I1")]


def test_candidates_without_links_and_groups_of_two(spark):
    got = faults(spark, [CANDIDATE, CANDIDATE | {"candidate_id": "PC-HIGH-2"}], [LINK])
    assert ("REPEATED_GROUP", "C1:OLIST:E1") in got and ("READY", "PC-HIGH-2") in got and ("READY", "PC-HIGH-1") not in got


def test_promoted_candidates_need_their_audit(spark):
    link = LINK | {"evidence": rules.LINK_EVIDENCE[rules.PROMOTED][0]}
    audits = [None, (2, *PAID[1:]), (*PAID[:2], 1, *PAID[3:]), (*PAID[:4], ["o1"], True, 0), (*PAID[:5], False, 0), (*PAID[:6], 1), PAID]
    promoted = CANDIDATE | {"classification": rules.PROMOTED, "evidence": rules.EVIDENCE[rules.PROMOTED]}
    got = faults(spark, [promoted | {"candidate_id": f"PC-HIGH-{n}", "audit": a} for n, a in enumerate(audits)], [link | {"candidate_id": f"PC-HIGH-{n}", "item_id": f"I{n}"} for n in range(len(audits))])
    assert [subject for rule, subject in got if rule == "AUDIT"] == [f"PC-HIGH-{n}" for n in range(len(audits) - 1)]


def test_declared_totals(spark):
    frames = [spark.createDataFrame([tuple(CANDIDATE.values())], CANDIDATE_DDL), spark.createDataFrame([tuple(LINK.values())], LINK_DDL), spark.createDataFrame(IDENTITIES, IDENTITY_DDL)]
    right = {"productCandidates": 1, "productsToCreate": 1, "productsToReuse": 0, "bothAccounts": 0, "ready": 1, "marketIdentities": 1, "erpIdentities": 1, "externalIdentities": 2, "listingItems": 1}
    assert rules.declared_faults(*frames, right).collect() == []
    assert [r.subject for r in rules.declared_faults(*frames, right | {"erpIdentities": 2}).collect()] == ["erpIdentities"]


def test_an_unknown_classification_is_told_once_and_its_action_is_not_judged(spark):
    """Neither way to act is wrong for a class that no rule names; a HIGH candidate may only be created."""
    of = lambda **changes: {rule for rule, subject in faults(spark, [CANDIDATE | changes], [LINK]) if subject == "PC-HIGH-1"}
    for action in (rules.REUSE, rules.CREATE):
        assert of(classification="LOW", action=action, reuse_id=None) == of(classification="LOW", action=action, reuse_id="P1") == {"CLASSIFICATION"}
    assert "PRODUCT_ACTION" in of(classification=rules.HIGH, action=rules.REUSE, reuse_id="P1")
