"""CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from souklens.session import written

#: Stands for a quoted empty text while reading; any text that no file holds will do.
_EMPTY = "\u0001empty\u0001"


def _options(**more) -> dict:
    return {"header": True, "quote": '"', "escape": '"'} | more


def read_external(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Text columns, fields optionally quoted, header skipped. Short rows are filled with NULL, longer
    ones cut, and empty fields are NULL; a row of empty fields is a row. Fields hold no line breaks, so
    files can be split."""
    return spark.read.options(**_options(mode="PERMISSIVE")).schema(schema).csv(path)


def read_external_rejects(spark: SparkSession, path: str, schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of ``read_external``, short ones filled and longer ones cut, and the ``record`` of each whose number of
    fields is not that of ``schema``. The parsed rows are written to the shared folder, since Spark does not read records
    on their own."""
    reader = spark.read.options(**_options(mode="PERMISSIVE", columnNameOfCorruptRecord="_record", header=header))
    rows = written(reader.schema(f"{schema}, _record string").csv(path), "external_rows")
    return rows.drop("_record"), rows.filter("_record IS NOT NULL").select(F.col("_record").alias("record"))


def read_copy(spark: SparkSession, path: str, schema: str, line_breaks: bool = True) -> DataFrame:
    """Bulk load: an empty field is NULL, a quoted empty field is an empty text. A row that does not fit
    the schema stops the load.

    Quoted texts may hold line breaks, for which a file is read by one task: write many files. If no
    field has one, ``line_breaks=False`` lets Spark split files; a broken row then stops the load, too.
    """
    return _copied(spark.read.options(**_copy_options(line_breaks, mode="FAILFAST")).schema(schema).csv(path), schema)


def read_copy_rejects(spark: SparkSession, path: str, schema: str, line_breaks: bool = True) -> tuple[DataFrame, DataFrame]:
    """Bulk load that goes on: the rows that fit the schema, and the ``record`` of each that does not.
    The parsed rows are written to the shared folder, since Spark does not read records on their own."""
    layout = f"{schema}, _record string"
    wide = spark.read.options(**_copy_options(line_breaks, mode="PERMISSIVE", columnNameOfCorruptRecord="_record")).schema(layout).csv(path)
    rows = written(wide, "copy_rows")
    return _copied(rows.filter("_record IS NULL").drop("_record"), schema), rows.filter("_record IS NOT NULL").select(F.col("_record").alias("record"))


def _copy_options(line_breaks: bool, **more) -> dict:
    return _options(nullValue="", emptyValue=_EMPTY, multiLine=line_breaks, **more)


def _copied(rows: DataFrame, schema: str) -> DataFrame:
    texts = [f.name for f in StructType.fromDDL(schema) if isinstance(f.dataType, StringType)]
    return rows.withColumns({c: F.when(F.col(c) == _EMPTY, "").otherwise(F.col(c)) for c in texts})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue='""', nullValue="", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    ).mode("overwrite").csv(path)
