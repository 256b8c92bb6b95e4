"""Approximate distinct counts that can be added up, and keys found with their help.

A sketch (HyperLogLog) of each column is a few kilobytes, is made in one pass without a
shuffle of values, and sketches of parts of a table can be merged. A key needs an exact
count, but only a column whose estimate comes near the number of rows can be one; so
only those are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_once
from ..tables import Tables, column_rows, ref, small_table
from .lanes import lane_class, lanes_of, text_sql, union_all
from .profile import value_counts

#: A sketch has 2 ** LOG_BUCKETS buckets; its standard error, and the errors that a key's estimate may be off by.
LOG_BUCKETS = 12
ERROR = 1.04 / 2 ** (LOG_BUCKETS / 2)
ERRORS = 5

SKETCHES = "table string, column string, row_count long, null_count long, sketch binary"


def column_sketches(tables: Tables) -> DataFrame:
    """``SKETCHES`` of every column, each table being read once."""
    out = []
    for table in sorted(tables):
        df, cells = tables[table], []
        for i, f in enumerate(df.schema.fields):
            value = F.when(ref(f.name).isNotNull(), F.xxhash64(F.expr(text_sql(f.name, f.dataType))))
            cells += [F.count(ref(f.name)).alias(f"n{i}"), F.hll_sketch_agg(value, F.lit(LOG_BUCKETS)).alias(f"s{i}")]
        if not cells:
            continue
        found = df.agg(F.count(F.lit(1)).alias("rows"), *cells)
        rows = [
            F.struct(
                F.lit(table).alias("table"), F.lit(f.name).alias("column"), F.col("rows").alias("row_count"),
                (F.col("rows") - F.col(f"n{i}")).alias("null_count"), F.col(f"s{i}").alias("sketch"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
        out.append(found.select(F.inline(F.array(*rows))))
    return union_all(out)


def merged(*parts: DataFrame) -> DataFrame:
    """Sketches of tables whose rows are those of all parts together."""
    return union_all(list(parts)).groupBy("table", "column").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"), F.hll_union_agg("sketch").alias("sketch")
    )


def estimated(sketches: DataFrame) -> DataFrame:
    """Adds ``estimate``, the distinct values there are about."""
    return sketches.withColumn("estimate", F.hll_sketch_estimate("sketch"))


def unique_columns(spark: SparkSession, tables: Tables, sketches: DataFrame | None = None) -> DataFrame:
    """``table, column, row_count, null_count, estimate, distinct_count, is_unique`` of every column.

    ``distinct_count`` is exact where the estimate leaves open whether every row has a value of
    its own, else null: such columns cannot be keys, and their values are never shuffled.
    """
    told = estimated(sketches if sketches is not None else column_sketches(tables))
    told = write_once(told.drop("sketch"), "distinct-estimates")
    full = (F.col("row_count") > 0) & (F.col("null_count") == 0)
    open_ = told.where(full & (F.col("estimate") >= (1 - ERRORS * ERROR) * F.col("row_count")))
    near = {(r["table"], r["column"]) for r in open_.select("table", "column").collect()}
    meta = [dict(row, cid=cid) for cid, row in enumerate(column_rows(tables)) if (row["table"], row["column"]) in near]
    for row in meta:
        row["data_type"] = tables[row["table"]].schema[row["column"]].dataType
    counts = []
    for lanes in sorted({lanes_of(lane_class(row["data_type"])) for row in meta}):
        values = value_counts(tables, meta, lanes).where(" or ".join(f"{lane} is not null" for lane in lanes))
        counts.append(values.groupBy("cid").agg(F.count("*").alias("distinct_count")))
    if not counts:
        return told.select("*", F.lit(None).cast("long").alias("distinct_count"), F.lit(False).alias("is_unique"))
    named = small_table(spark, [{k: row[k] for k in ("cid", "table", "column")} for row in meta], "cid int, table string, column string")
    exact = union_all(counts).join(named, "cid").drop("cid")
    return told.join(exact, ["table", "column"], "left").withColumn(
        "is_unique", F.coalesce(F.col("distinct_count") == F.col("row_count"), F.lit(False))
    )
