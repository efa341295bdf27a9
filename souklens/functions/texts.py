"""Text, identifiers and scalar typing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from souklens.functions.times import parse_iso


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def strip_quotes(text: Column) -> Column:
    """Remove double quotes at both ends."""
    return F.btrim(text, F.lit('"'))


def base64_to_uuid(text: Column) -> Column:
    """Base64 of 16 bytes to a lower-case UUID; NULL when blank, invalid or of another length."""
    raw = F.try_to_binary(blank_to_null(text), F.lit("base64"))
    digits = F.lower(F.hex(raw))
    parts = [F.substring(digits, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.octet_length(raw) == 16, F.concat_ws("-", *parts))


def number_of_text(text: Column) -> Column:
    """Text to double; NULL when it is not a number."""
    return text.try_cast("double")


def boolean_of_text(text: Column) -> Column:
    """True for any spelling of "true", false for other text, NULL for NULL."""
    return F.lower(text) == "true"


def timestamp_of_text(text: Column) -> Column:
    return parse_iso(text)


def json_or_null(text: Column) -> Column:
    """JSON text to a variant; NULL when it does not parse.

    The parser stops after the first value and would accept what follows it. Set inside an object
    and inside an array, only a text that is one value and nothing else parses both times.
    """
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(listed.isNotNull(), F.try_variant_get(inside, "$.v", "variant"))
