"""The access layer: what the remote stores deliver, as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from souklens.functions.texts import base64_to_uuid
from souklens.functions.times import from_epoch_ms, parse_iso
from souklens.operators import baskets
from souklens.sources import documents, schemas


def orders(staged: DataFrame) -> DataFrame:
    return documents.rows_of_arrays(staged, schemas.ORDER)


def order_items(staged: DataFrame) -> DataFrame:
    return documents.rows_of_arrays(staged, schemas.ORDER_ITEM)


def marketplace_invoices(staged: DataFrame) -> DataFrame:
    return documents.rows_of_arrays(staged, schemas.MARKETPLACE_INVOICE)


def events(staged: DataFrame) -> DataFrame:
    """The nested ``metadata`` object stays JSON text."""
    return documents.rows_of_arrays(staged, schemas.EVENT)


def products(staged: DataFrame) -> DataFrame:
    return typed_products(documents.rows_of_arrays(staged, schemas.PRODUCT))


def typed_products(rows: DataFrame) -> DataFrame:
    """Catalogue documents with typed ids and times. An id is base64 of 16 bytes in an object, or
    plain text; a time is epoch milliseconds in an object, or ISO text."""
    def identifier(name: str, out: str) -> list[Column]:
        text = F.col(name)
        raw = F.from_json(text, schemas.BINARY)["$binary"]["base64"]
        plain = F.when(~text.startswith("{"), text)
        return [raw.alias(f"{out}_b64"), F.coalesce(base64_to_uuid(raw), plain).alias(out)]

    def moment(name: str) -> Column:
        text = F.col(name)
        return F.coalesce(from_epoch_ms(F.from_json(text, schemas.DATE)["$date"]), parse_iso(text)).alias(name)

    return rows.select(
        *identifier("id", "product_id"), *identifier("seller_id", "seller_id"), "name", "slug", "product_type", "description",
        "price_usd", "currency", "is_active", moment("created_at"), moment("updated_at"))


def bought_with(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Co-purchased pairs with the names of both products. Finds large orders when the frame is built
    (see ``baskets.bought_with``)."""
    pairs = baskets.bought_with(items, catalogue)
    return name_pairs(pairs, baskets.product_vertices(catalogue))


def name_pairs(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    out = pairs
    for side in (1, 2):
        v = vertices.select(F.col("id").alias(f"_v{side}"), F.col("name").alias(f"product_{side}_name"))
        out = out.join(v, F.col(f"product_{side}_id") == F.col(f"_v{side}"))
    return out.select("product_1_id", "product_1_name", "product_2_id", "product_2_name", "co_purchase_count")
