"""Relationship signals and the blended confidence, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floors and weights that decide which edges exist.
NAME_FLOOR = 0.15
STRONG_NAME = 0.9
OVERLAP_FLOOR = 0.5
CONFIDENCE_FLOOR = 50
OVERLAP_WEIGHT = 0.55
NAME_WEIGHT = 0.25
TYPE_WEIGHT = 0.10
SHAPE_WEIGHT = 0.10


def joinable_kinds(a: Column, b: Column) -> Column:
    mixed = F.array(a, b)
    crossed = F.array_contains(mixed, F.lit("numeric")) & F.array_contains(mixed, F.lit("text"))
    return (a == b) | crossed


def type_match(foreign_type: Column, key_type: Column, foreign_kind: Column, key_kind: Column) -> Column:
    return (
        F.when(F.upper(foreign_type) == F.upper(key_type), F.lit(1.0))
        .when(foreign_kind == key_kind, F.lit(0.85))
        .when(joinable_kinds(foreign_kind, key_kind), F.lit(0.4))
        .otherwise(F.lit(0.0))
    )


def cardinality_shape(key_unique: Column, foreign_unique: Column) -> Column:
    return (
        F.when(~key_unique, F.lit(0.0))
        .when(foreign_unique, F.lit(0.8))
        .otherwise(F.lit(1.0))
    )


def cardinality(foreign_unique: Column) -> Column:
    return F.when(foreign_unique, F.lit("one-to-one")).otherwise(F.lit("many-to-one"))


def confidence(overlap: Column, name: Column, types: Column, shape: Column) -> Column:
    """Weighted blend on a 0..100 scale, halves rounded up."""
    blend = (
        F.lit(OVERLAP_WEIGHT) * overlap
        + F.lit(NAME_WEIGHT) * name
        + F.lit(TYPE_WEIGHT) * types
        + F.lit(SHAPE_WEIGHT) * shape
    )
    return F.floor(blend * 100 + 0.5).cast("int")


def edge_key(from_table: Column, from_column: Column, to_table: Column, to_column: Column) -> Column:
    return F.concat(from_table, F.lit("."), from_column, F.lit("->"), to_table, F.lit("."), to_column)
