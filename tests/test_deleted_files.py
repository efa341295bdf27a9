"""Queries whose kept tables have lost files though their folders are left, as where a cleaner deletes files only."""

from __future__ import annotations

import pytest

from souklens.workload import ORACLES, QUERIES
from tests.compare import difference

KEEPING = [
    "bought_with",
    "check_unique_keys",
    "cons_sub_cohort",
    "cons_user_subscription",
    "dim_product",
    "dim_product_affinity_type",
    "doc_attributes_parse",
    "doc_scalar_types",
    "graph_bought_with",
]


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    """A shared folder of the test's own."""
    settings = type(spark.conf)
    known = settings.get
    monkeypatch.setattr(settings, "get", lambda self, key, *rest: str(tmp_path / "all") if key == "spark.checkpoint.dir" else known(self, key, *rest))
    return tmp_path / "all"


@pytest.mark.parametrize("name", KEEPING)
def test_tables_without_files_are_written_anew(spark, folder, tmp_path, con, name):
    (tmp_path / "data").symlink_to("/root/testdata/sf0.001")  # a path of its own: tables are kept by path
    QUERIES[name](spark, str(tmp_path / "data")).collect()
    tables = list(folder.glob("souklens/*/*"))
    for file in folder.rglob("*"):
        if file.is_file():
            file.unlink()
    assert tables and all(table.is_dir() for table in tables)
    assert difference(QUERIES[name](spark, str(tmp_path / "data")), con, ORACLES[name]) is None
