"""Queries whose kept tables are gone, as where the shared folder is emptied between two queries of a session."""

from __future__ import annotations

import shutil

import pytest

from souklens.workload import ORACLES, QUERIES
from tests.compare import difference

KEEPING = [
    "check_price_overlaps",
    "check_document_counts",
    "bought_with",
    "check_unique_keys",
    "cons_seller_order_revenue",
    "cons_product_affinity",
    "cons_user_activity",
    "cons_sub_cohort",
    "cons_user_subscription",
    "dim_product",
    "dim_product_affinity_type",
    "doc_attributes_parse",
    "doc_scalar_types",
    "graph_bought_with",
    "graph_product_vertices",
]


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    """A shared folder of the test's own."""
    settings = type(spark.conf)
    known = settings.get
    monkeypatch.setattr(settings, "get", lambda self, key, *rest: str(tmp_path / "all") if key == "spark.checkpoint.dir" else known(self, key, *rest))
    return tmp_path / "all"


@pytest.mark.parametrize("name", KEEPING)
def test_kept_tables_are_written_anew(spark, folder, tmp_path, con, name):
    (tmp_path / "data").symlink_to("/root/testdata/sf0.001")  # a path of its own: tables are kept by path
    QUERIES[name](spark, str(tmp_path / "data")).collect()
    assert list(folder.glob("souklens/*/*"))
    shutil.rmtree(folder)
    assert difference(QUERIES[name](spark, str(tmp_path / "data")), con, ORACLES[name]) is None
