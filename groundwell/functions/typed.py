"""Payloads of typed values: ``VARIANT`` objects, and what an exact match compares.

A filter on a payload asks for values of a kind: the number 1, the text "1", ``true`` and null are
four different values. Each value becomes a token that names its kind, so that equal tokens mean
equal typed values, and everything that matches text matches typed values as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwell.functions.binding import let
from groundwell.functions.payload import TEXT_KEY

#: Whole numbers of a floating value up to here are written as integers.
_WHOLE = 1e15


def typed_payload(**values: Column) -> Column:
    """A payload of the given columns, each of its own type."""
    return F.to_variant_object(F.struct(*(v.alias(k) for k, v in values.items())))


def payload_from_json(text: Column) -> Column:
    """A payload from JSON text; null where that is no JSON."""
    return F.try_parse_json(text)


def _object(value: Column) -> Column:
    return value.try_cast("map<string,variant>")


def value_token(value: Column) -> Column:
    """One variant as text that names its kind.

    Numbers are equal by value, whatever their type, so that 1 and 1.0 are one number. A list or
    object is its JSON text. A missing value (SQL null) has no token.
    """

    def number(v: Column) -> Column:
        whole = v.try_cast("double")
        as_is = v.try_cast("string")
        return F.when(
            F.contains(as_is, F.lit("E")) & (F.abs(whole) < _WHOLE) & (F.rint(whole) == whole),
            whole.cast("bigint").cast("string"),
        ).otherwise(F.regexp_replace(as_is, r"\.0+$|(\.\d*?[1-9])0+$", "$1"))

    def token(kind: Column) -> Column:
        return (
            F.when(kind.isNull(), F.lit(None))
            .when(kind == "VOID", F.lit("null"))
            .when(kind == "BOOLEAN", F.concat(F.lit("boolean:"), value.try_cast("string")))
            .when(
                kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
                F.concat(F.lit("number:"), number(value)),
            )
            .when(kind == "STRING", F.concat(F.lit("text:"), value.try_cast("string")))
            .otherwise(F.concat(F.lower(F.split_part(kind, F.lit("<"), F.lit(1))), F.lit(":"), F.to_json(value)))
        )

    return let(F.schema_of_variant(value), token)


def typed_entries(payload: Column) -> Column:
    """``ARRAY<STRUCT<key, value>>``: names and value tokens of a payload, each once.

    A list gives an entry for each of its elements, as a list matches what one of its elements
    matches, and none for itself. The fields of an object inside are named ``outer.inner``; deeper
    ones match only as a whole. The stored text is no metadata. A payload that is null or no
    object has no entries.
    """

    def of(name: Column, value: Column) -> Column:
        items = F.coalesce(
            value.try_cast("array<variant>"), F.array(value)
        )
        return F.transform(
            items, lambda item: F.struct(name.alias("key"), value_token(item).alias("value"))
        )

    def deeper(entry: Column) -> Column:
        inner = F.transform(
            F.map_entries(_object(entry["value"])),
            lambda e: F.struct(
                F.concat(entry["key"], F.lit("."), e["key"]).alias("key"), e["value"].alias("value")
            ),
        )
        return F.coalesce(inner, F.array(entry))

    fields = F.filter(F.map_entries(_object(payload)), lambda e: e["key"] != TEXT_KEY)
    flat = F.flatten(F.transform(fields, deeper))
    entries = F.flatten(F.transform(flat, lambda e: of(e["key"], e["value"])))
    return F.coalesce(F.array_distinct(entries), F.array().cast("array<struct<key:string,value:string>>"))


def text_entries(metadata: Column) -> Column:
    """The same of text metadata (``MAP<STRING,STRING>``): values are compared as text."""
    entries = F.filter(F.map_entries(metadata), lambda e: e["key"] != TEXT_KEY)
    return F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>"))


def typed_filter(filters: Column) -> Column:
    """A filter object as ``MAP<STRING,STRING>`` of names and value tokens, to be matched with
    :func:`typed_entries`. A null value asks for a stored null and not for a missing field; a list
    or an object matches nothing. An object without fields, or none, is no filter."""
    return F.coalesce(
        F.transform_values(_object(filters), lambda _, v: value_token(v)),
        F.create_map().cast("map<string,string>"),
    )
