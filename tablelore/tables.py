"""Small helpers shared by the operators."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .types import COLUMNS, kind_of

Tables = Mapping[str, DataFrame]


def ref(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_table(spark: SparkSession, rows: Iterable[dict], schema: str) -> DataFrame:
    """Schema-sized rows the driver already knows, as a one-partition DataFrame."""
    payload = json.dumps(list(rows))
    return spark.range(1).select(F.inline(F.from_json(F.lit(payload), f"array<struct<{_colons(schema)}>>")))


def _colons(schema: str) -> str:
    parts, depth, current = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    parts.append(current)
    fields = []
    for part in parts:
        name, kind = part.strip().split(" ", 1)
        fields.append(f"`{name}`:{kind}")
    return ",".join(fields)


def column_rows(tables: Tables) -> list[dict]:
    """One row per column; tables in name order so no result depends on dict order."""
    rows = []
    for position, table in enumerate(sorted(tables)):
        for ordinal, field in enumerate(tables[table].schema.fields):
            rows.append(
                {
                    "table": table,
                    "table_ordinal": position,
                    "ordinal": ordinal,
                    "column": field.name,
                    "type": field.dataType.simpleString(),
                    "kind": kind_of(field.dataType),
                }
            )
    return rows


def list_columns(spark: SparkSession, tables: Tables) -> DataFrame:
    """Schema listing: table, position, column, type text and kind. Reads no data."""
    return small_table(spark, column_rows(tables), COLUMNS)


def count_rows(tables: Tables) -> DataFrame:
    """Row count of every table in one job; Parquet answers from footers alone."""
    counts = None
    for table in sorted(tables):
        one = tables[table].agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(table).alias("table"), "row_count"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


#: Rows that a peek shows at most.
PEEK = 50


def sample_rows(df: DataFrame, limit: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """A peek of ``limit`` rows, 1 to ``PEEK``; with ``order_by`` it is repeatable. Other limits are refused."""
    if not 1 <= int(limit) <= PEEK:
        raise ValueError(f"a sample has 1 to {PEEK} rows, not {limit}")
    return (df.orderBy(*order_by) if order_by else df).limit(int(limit))
