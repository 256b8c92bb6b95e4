"""Column kinds and the schemas of the catalog tables."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = ("numeric", "date", "boolean", "text", "other")


def kind_of(data_type: T.DataType) -> str:
    """The five-way kind that profiling, discovery and modelling dispatch on.

    Nested types and intervals are ``other``: they have no minimum, average or
    text form that two engines agree on.
    """
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "other"


COLUMNS = "table string, table_ordinal int, ordinal int, column string, type string, kind string"

TOP_VALUES = "array<struct<value:string,count:bigint>>"

PROFILE = (
    COLUMNS
    + ", row_count bigint, null_count bigint, null_percent double, distinct_count bigint, "
    + f"min string, max string, avg double, top_values {TOP_VALUES}, all_values array<string>"
)

RELATIONSHIPS = (
    "ordinal int, from_table string, from_column string, to_table string, to_column string, "
    "confidence int, cardinality string, value_overlap double, name_similarity double, "
    "type_match double, cardinality_shape double"
)

VERDICTS = "key string, verdict string"

GLOSSARY = (
    "ordinal bigint, term string, definition string, synonyms array<string>, map_table string, "
    "map_column string, confidence double, source string, accepted boolean"
)
