"""Functions for SQL texts: what the access layer offers as columns, by name in ``spark.sql``.

They are SQL functions, which Catalyst writes out in place: no Python worker runs, and filters and columns reach the scan
as if the expression stood there. They last as long as the session.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from souklens.sources import schemas
from souklens.sources.documents import PAIR_POSITIONS

#: Name -> parameters, result and body.
_SCALARS = {
    "base64_to_uuid": ("text STRING", "STRING", """
        CASE WHEN octet_length(try_to_binary(nullif(trim(text), ''), 'base64')) = 16 THEN
            regexp_replace(lower(hex(try_to_binary(text, 'base64'))), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5') END"""),
    "number_of_text": ("text STRING", "DOUBLE", "try_cast(text AS DOUBLE)"),
    "boolean_of_text": ("text STRING", "BOOLEAN", "lower(text) = 'true'"),
}


def _positions() -> tuple[str, str]:
    columns = ", ".join(f"{name} {kind}" for name, kind in PAIR_POSITIONS.items())
    values = ", ".join(f"try_cast(get(cells, {i}) AS {kind}) AS {name}" for i, (name, kind) in enumerate(PAIR_POSITIONS.items()))
    return columns, f"""SELECT {values} FROM (SELECT explode(from_json(document, 'data STRUCT<values: ARRAY<ARRAY<STRING>>>').data.values) AS cells)"""


def array_table(name: str, row: str) -> str:
    """SQL of a table function: a JSON array of objects as rows of ``row`` ("name type, ..."). Values that do not fit are NULL."""
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(document STRING) RETURNS TABLE ({row})
        RETURN SELECT inline(from_json(document, 'ARRAY<STRUCT<{row}>>'))"""


def register_functions(spark: SparkSession, **tables: str) -> None:
    """``base64_to_uuid``, ``number_of_text`` and ``boolean_of_text``; the table functions ``json_orders``,
    ``json_order_items`` and ``json_pairs`` (documents of the graph store), and one for each of ``tables``, name=row."""
    for name, (parameters, result, body) in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, row in {"json_orders": schemas.ORDER, "json_order_items": schemas.ORDER_ITEM, **tables}.items():
        spark.sql(array_table(name, row))
    columns, body = _positions()
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION json_pairs(document STRING) RETURNS TABLE ({columns}) RETURN {body}")
