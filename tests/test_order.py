"""Results with an order: the sequence of rows against the sequence that SQL gives, ties included."""

from __future__ import annotations

import pytest

from souklens.workload import ORACLES, QUERIES
from tests.compare import cell

SF = "/root/testdata/sf0.001"

#: Orders that leave no ties: whole rows are compared.
TOTAL = {
    "sort_multi": "country_code DESC NULLS LAST, last_login_at NULLS FIRST, id",
    "topk_recent": "created_at DESC NULLS FIRST, id",
    "topk_items_by_id": "id",
    "topk_pairs": "co_purchase_count DESC, product_1_id, product_2_id",
    "page": "created_at DESC, id",
    "page_after_key": "o_orderkey",
    "publish_sub_cohort": "cohort_month DESC NULLS FIRST, user_id NULLS LAST, subscription_id",
    "publish_pg_orders": "created_at DESC NULLS FIRST, id",
    "publish_pg_order_items": "id NULLS LAST",
    "publish_pg_mkt_invoices": "created_at DESC NULLS FIRST, id",
    "publish_ts_events": "occurred_at DESC NULLS FIRST, id",
    "publish_mg_products": "created_at DESC NULLS FIRST, product_id",
    "publish_neo4j_bought_with": "co_purchase_count DESC NULLS FIRST, product_1_id, product_2_id",
}
#: Orders that may leave ties: the columns of the order are compared in sequence.
PARTIAL = {
    "publish_engagement_revenue": "grp_month, activity_month DESC NULLS FIRST, grp_country, country_code NULLS LAST",
    "publish_geo_density": "grouping_label DESC, total_orders DESC NULLS LAST",
    "publish_sub_retention": "tier_name NULLS LAST, cohort_month DESC NULLS FIRST",
    "publish_billing_trend": "tier_name NULLS LAST, billing_month DESC NULLS FIRST",
}


@pytest.mark.parametrize("name", [*TOTAL, *PARTIAL])
def test_sequence(spark, con, name):
    df = QUERIES[name](spark, SF)
    result = con.execute(f"SELECT * FROM ({ORACLES[name]}) ORDER BY {TOTAL.get(name) or PARTIAL[name]}")
    names = [d[0] for d in result.description]
    wanted = df.columns if name in TOTAL else [clause.split()[0] for clause in PARTIAL[name].split(", ")]
    found = [tuple(cell(r[c]) for c in wanted) for r in df.collect()]
    assert len(found) > 10
    assert found == [tuple(cell(r[names.index(c)]) for c in wanted) for r in result.fetchall()]


def test_every_published_order_is_tested():
    from souklens.workload.published import CATALOG
    assert {f"publish_{n.replace('-', '_')}" for n, p in CATALOG.items() if p.order} <= {*TOTAL, *PARTIAL}


def test_pages_follow_one_another(spark, con):
    """All pages together are the whole result, each row once, in the order of the catalogue."""
    from souklens.sources.market import Market
    from souklens.workload.published import CATALOG
    published, market = CATALOG["sub-cohort"], Market(spark, SF)
    whole = con.execute(f"SELECT subscription_id FROM ({ORACLES['publish_sub_cohort']}) ORDER BY {TOTAL['publish_sub_cohort']}").fetchall()
    pages = [r["subscription_id"] for n in range(4) for r in published.page(market, n, 40).collect()]
    assert pages == [r[0] for r in whole][:160]
