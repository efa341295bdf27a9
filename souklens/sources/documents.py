"""JSON documents: staged arrays, nested result sets and catalogue documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from souklens.functions.texts import boolean_of_text, json_or_null, number_of_text, timestamp_of_text


def rows_of_arrays(staged: DataFrame, row: str, column: str = "json_doc") -> DataFrame:
    """Each document of ``column`` holds a JSON array; one row per element.

    An element's value that does not fit its type is NULL, the other values stay. A field declared
    as text keeps a nested object as JSON text.
    """
    return staged.select(F.inline(F.from_json(column, f"array<struct<{row}>>")))


def read_document_lines(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Files with one JSON document per line, which Spark can split."""
    return spark.read.schema(row).json(path)


#: Positions of a co-purchase row. Fixed values.
PAIR_POSITIONS = {"product_1_id": "string", "product_1_name": "string", "product_2_id": "string",
                  "product_2_name": "string", "co_purchase_count": "long"}


def rows_of_result_set(staged: DataFrame, positions: dict[str, str], column: str = "json_doc") -> DataFrame:
    """Documents ``{"data": {"values": [[...], ...]}}`` to rows by position; a value of the wrong
    type or a missing position is NULL."""
    parsed = F.from_json(column, "struct<data: struct<values: array<array<string>>>>")
    values = staged.select(F.explode(parsed["data"]["values"]).alias("v"))
    return values.select(*[F.get("v", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(positions.items())])


def stage_arrays(rows: DataFrame, per_document: int = 500) -> DataFrame:
    """Rows packed into documents of at most ``per_document`` elements each."""
    at = F.monotonically_increasing_id()
    numbered = rows.select(F.struct("*").alias("_row")).withColumn("_doc", F.floor(at / per_document))
    return numbered.groupBy("_doc").agg(
        F.to_json(F.collect_list("_row"), {"ignoreNullFields": "false"}).alias("json_doc")).drop("_doc")


def parse_attributes(documents: DataFrame) -> DataFrame:
    """``attributes`` text to a nested value; text that does not parse stays text in
    ``attributes_text``."""
    parsed = json_or_null(F.col("attributes"))
    return documents.withColumn("_parsed", parsed).withColumn(
        "attributes_text", F.when(F.col("_parsed").isNull(), F.col("attributes"))).withColumn(
        "attributes", F.col("_parsed")).drop("_parsed")


def type_scalars(documents: DataFrame) -> DataFrame:
    """Prices, flags and times that are still text get their types; others pass unchanged."""
    kinds = {"price_usd": number_of_text, "is_active": boolean_of_text,
             "created_at": timestamp_of_text, "updated_at": timestamp_of_text}

    def typed(name: str) -> Column:
        text = documents.schema[name].dataType.typeName() == "string"
        return kinds[name](F.col(name)) if text else F.col(name)

    return documents.withColumns({name: typed(name) for name in kinds if name in documents.columns})
