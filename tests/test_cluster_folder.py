"""Queries that write tables, in a cluster session whose folder only ``SparkContext.setCheckpointDir`` names."""

from __future__ import annotations

import pytest

from souklens import session
from souklens.workload import ORACLES, QUERIES
from tests.compare import difference

WRITING = [
    "agg_distinct_sketch_cube",
    "agg_median",
    "agg_percentile_cont",
    "agg_quantile_sketch_cube",
    "check_price_overlaps",
    "check_document_counts",
    "bought_with",
    "check_unique_keys",
    "cons_seller_order_revenue",
    "cons_order_transactions",
    "cons_product_affinity",
    "cons_sub_billing",
    "cons_user_activity",
    "cons_sub_cohort",
    "cons_user_subscription",
    "dim_product",
    "dim_product_affinity_type",
    "doc_attributes_parse",
    "doc_scalar_types",
    "graph_bought_with",
    "graph_product_vertices",
    "graph_bought_with_split",
]


@pytest.fixture
def cluster(spark, tmp_path, monkeypatch):
    """The session with a cluster's master, that folder and no setting; what it had before comes back."""
    settings, context = type(spark.conf), spark.sparkContext._jsc.sc()
    known, before = settings.get, context.checkpointDir()
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(settings, "get", lambda self, key, *rest: None if key == "spark.checkpoint.dir" else known(self, key, *rest))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "all"))
    yield spark
    getattr(context, "checkpointDir_$eq")(before)


def test_folder_of_set_checkpoint_dir_is_tried(cluster, tmp_path, monkeypatch):
    tried = []
    monkeypatch.setattr(session, "_try_shared", lambda spark, folder: tried.append(folder))
    folder = session.shared_folder(cluster)
    assert tried == [folder] and folder.startswith(f"file:{tmp_path}/all/")


@pytest.mark.parametrize("name", WRITING)
def test_queries_run_with_set_checkpoint_dir(cluster, tmp_path, con, name):
    (tmp_path / "data").symlink_to("/root/testdata/sf0.001")  # a path of its own: tables are kept by path
    assert difference(QUERIES[name](cluster, str(tmp_path / "data")), con, ORACLES[name]) is None
    assert list(tmp_path.glob("all/*/souklens/*/*"))
