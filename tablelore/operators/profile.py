"""Column profiles of a whole dataset; every column is scanned and shuffled once.

All columns of all tables go through long tables of typed values (``lanes.long_form``),
one for whole numbers, one for fractions, one for local times and one for text.
Counting equal values, with map-side combine, yields rows, nulls, exact distinct
counts, minimum, maximum, mean and the most frequent values; a value that fills a
third of a table is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_once
from ..tables import Tables, column_rows, small_table
from ..types import COLUMNS, TOP_VALUES
from .lanes import lane_class, lanes_of, long_form, native_lanes, text_lanes, text_sql, union_all

#: Leading values that are reported, and that are found: columns with no more list all theirs.
TOP = 5
LEADERS = 25
RANKED_KINDS = ("text", "boolean", "other")


def profile_dataset(spark: SparkSession, tables: Tables) -> DataFrame:
    """Profile every column of every table; one row per column.

    Reads the tables and writes schema-sized results to the shared folder. The
    number of Spark jobs does not grow with the number of columns.
    """
    meta = [dict(row, cid=cid) for cid, row in enumerate(column_rows(tables))]
    types = {
        (name, field.name): field.dataType
        for name, df in tables.items()
        for field in df.schema.fields
    }
    for row in meta:
        row["data_type"] = types[row["table"], row["column"]]

    found = write_once(_stats_and_top(tables, meta), "profile-counts")
    stats = found.where("part = 'stats'").select("cid", "stats.*")
    ranked_cids = [row["cid"] for row in meta if row["kind"] in RANKED_KINDS]
    top = found.where("part = 'top'").select("cid", "top.*").where(F.col("cid").isin(ranked_cids))

    listed = top.groupBy("cid").agg(
        F.min("count").alias("floor"), F.count(F.lit(1)).alias("listed")
    )
    # long text matters where it is frequent enough to be listed
    wide = {
        row.cid: (row.floor, row.listed)
        for row in listed.join(stats.select("cid", "long_top"), "cid")
        .where((F.col("listed") < LEADERS) | (F.col("long_top") >= F.col("floor")))
        .where(F.col("long_top").isNotNull())
        .collect()
    }
    if wide:
        spelled = write_once(_long_top_values(spark, tables, meta, wide, top), "profile-long-text")
        top = top.where(~F.col("cid").isin(list(wide))).select("cid", "value", "count").unionByName(spelled)
    ranked = _top_rows(top.select("cid", "value", "count"), F.col("value").asc())
    return write_once(_assemble(spark, meta, stats, ranked), "profile")


def value_counts(tables: Tables, meta: list[dict], lanes: tuple[str, ...]) -> DataFrame | None:
    """How often each value occurs in each column held in ``lanes``.

    Nulls form one group per column. None when no column uses these lanes.
    """
    frames = []
    for table in sorted(tables):
        cells = [
            ({"cid": str(row["cid"])}, native_lanes(row["column"], row["data_type"]))
            for row in meta
            if row["table"] == table and lanes_of(lane_class(row["data_type"])) == lanes
        ]
        if cells:
            frames.append(long_form(tables[table], cells, lanes))
    if not frames:
        return None
    return union_all(frames).groupBy("cid", *lanes).agg(F.count(F.lit(1)).alias("n"))


def _top_rows(counts: DataFrame, then: Column) -> DataFrame:
    """The most frequent rows per column; Spark trims before the shuffle."""
    order = Window.partitionBy("cid").orderBy(F.col("count").desc(), then)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEADERS)


def _stats_and_top(tables: Tables, meta: list[dict]) -> DataFrame:
    parts = []
    for lanes in (("k",), ("d",), ("t",), ("s", "h")):
        counts = value_counts(tables, meta, lanes)
        if counts is None:
            continue
        parts.append(_stats(counts, lanes, meta))
        if "s" in lanes:
            # leaves nulls out after counting: a filter on the value alone would move below
            # the aggregation, and the shuffle could not be shared with the statistics
            texts = counts.select("cid", F.col("s").alias("value"), F.col("n").alias("count"), F.col("h").alias("digest"))
            given = F.when(_present(lanes, "value", "digest"), F.col("count")).otherwise(0)
            texts = texts.where(given > 0)
            top = _top_rows(texts, F.col("value").asc_nulls_last())
            top = top.select("cid", F.struct("value", "count", "digest").alias("top"))
            parts.append(top.withColumn("part", F.lit("top")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if "top" not in out.columns:
        out = out.withColumn("top", F.lit(None).cast("struct<value:string,count:bigint,digest:binary>"))
    return out


def _present(lanes: tuple[str, ...], *names: str) -> Column:
    out = F.lit(False)
    for name in names or lanes:
        out = out | F.col(name).isNotNull()
    return out


def _stats(counts: DataFrame, lanes: tuple[str, ...], meta: list[dict]) -> DataFrame:
    """One row per column; the same fields whichever lanes the values came in."""
    types = {"k": "bigint", "d": "double", "t": "timestamp_ntz"}
    lane = {name: F.col(name) if name in lanes else F.lit(None).cast(kind) for name, kind in types.items()}
    number = F.coalesce(lane["k"].cast("double"), lane["d"])
    present = _present(lanes)
    measures = [
        F.sum("n").alias("row_count"),
        F.sum(F.when(present, F.col("n"))).alias("present"),
        F.count(F.when(present, 1)).alias("distinct_count"),
        (F.sum(number * F.col("n")) / F.sum(F.when(number.isNotNull(), F.col("n")))).alias("mean"),
    ]
    for name, value in lane.items():
        measures += [F.min(value).alias(f"min_{name}"), F.max(value).alias(f"max_{name}")]
    long = F.col("h").isNotNull() if "h" in lanes else F.lit(False)
    measures.append(F.max(F.when(long, F.col("n"))).alias("long_top"))
    # decimals beyond 18 digits travel as text; one set of measures serves all such columns
    wide = _wide_decimals(meta)
    text = F.when(F.col("cid").isin(wide), F.col("s")) if "s" in lanes and wide else F.lit(None).cast("string")
    measures += [
        F.min_by(text, _in_order(text)).alias("min_w"),
        F.max_by(text, _in_order(text)).alias("max_w"),
        (F.sum(text.try_cast("double") * F.col("n")) / F.sum(F.when(text.isNotNull(), F.col("n")))).alias("mean_w"),
    ]
    stats = counts.groupBy("cid").agg(*measures)
    fields = [name for name in stats.columns if name != "cid"]
    return stats.select("cid", F.struct(*fields).alias("stats"), F.lit("stats").alias("part"))


def _wide_decimals(meta: list[dict]) -> list[int]:
    return [row["cid"] for row in meta if row["kind"] == "numeric" and lane_class(row["data_type"]) == "text"]


def _in_order(text: Column) -> Column:
    """Decimals of at most 38 digits as texts that sort like the numbers."""
    digits = F.ltrim(F.lit("-"), text)
    fraction = F.when(digits.contains("."), F.substring_index(digits, ".", -1)).otherwise("")
    padded = F.concat(F.lpad(F.substring_index(digits, ".", 1), 38, "0"), F.rpad(fraction, 38, "0"))
    turned = F.translate(padded, "0123456789", "9876543210")
    return F.when(text.startswith("-"), F.concat(F.lit("0"), turned)).otherwise(F.concat(F.lit("1"), padded))


def _long_top_values(
    spark: SparkSession, tables: Tables, meta: list[dict], wide: dict[int, tuple[int, int]], top: DataFrame
) -> DataFrame:
    """Spell out the most frequent values of columns whose leaders include long text.

    ``wide`` maps a column to the count of its last listed value and how many were
    listed. Where the last leader's count is above one, the values at least that frequent
    are looked up by digest. Where it is one, the values listed with a higher count
    are looked up and the rest are the first ones in text order among all others;
    each task keeps only its own first ones, so the text is not shuffled.
    """
    rows = [row for row in meta if row["cid"] in wide]
    texts = union_all(
        [
            tables[row["table"]].selectExpr(
                f"{row['cid']} as cid", f"{text_sql(row['column'], row['data_type'])} as value"
            )
            for row in rows
        ]
    ).where(F.col("value").isNotNull())
    keyed = texts.selectExpr("cid", "value", *[f"{sql} as {lane}" for lane, sql in text_lanes("value").items()])
    key = F.coalesce(F.col("h"), F.col("s").cast("binary"))
    keyed = keyed.select("cid", "value", key.alias("key"))

    deep = [cid for cid, (floor, listed) in wide.items() if listed == LEADERS and floor > 1]
    flat = [cid for cid, (floor, listed) in wide.items() if listed == LEADERS and floor == 1]
    listed_key = F.coalesce(F.col("digest"), F.col("value").cast("binary"))
    wanted = top.where(
        F.col("cid").isin([c for c in wide if c not in deep]) & ((F.col("count") > 1) | ~F.col("cid").isin(flat))
    ).select("cid", listed_key.alias("key"), "count")
    if deep:
        floors = small_table(
            spark, [{"cid": c, "floor": wide[c][0]} for c in deep], "cid int, floor bigint"
        )
        frequent = (
            keyed.where(F.col("cid").isin(deep))
            .groupBy("cid", "key")
            .agg(F.count(F.lit(1)).alias("count"))
            .join(floors, "cid")
            .where(F.col("count") >= F.col("floor"))
            .select("cid", "key", "count")
        )
        wanted = wanted.unionByName(frequent)
    # written first: with its size known, Spark broadcasts it when it is small and the
    # long text below is then looked up without being shuffled
    wanted = write_once(wanted, "profile-frequent-text")
    looked_up = (
        keyed.join(wanted, ["cid", "key"])
        .groupBy("cid", "key", "count")
        .agg(F.first("value").alias("value"))
        .select("cid", "value", "count")
    )
    found = looked_up
    if flat:
        single = (
            keyed.where(F.col("cid").isin(flat))
            .join(wanted.select("cid", "key"), ["cid", "key"], "left_anti")
            .select("cid", "value", F.lit(1).cast("bigint").alias("count"))
        )
        found = found.unionByName(_top_rows(single, F.col("value").asc()).drop("rank"))
    return _top_rows(found, F.col("value").asc()).drop("rank")


def _assemble(spark: SparkSession, meta: list[dict], stats: DataFrame, ranked: DataFrame) -> DataFrame:
    columns = small_table(
        spark,
        [{k: row[k] for k in ("cid", "table", "table_ordinal", "ordinal", "column", "type", "kind")}
         | {"lane": lane_class(row["data_type"])} for row in meta],
        COLUMNS + ", cid int, lane string",
    )
    leaders = ranked.groupBy("cid").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "value", "count"))),
            lambda item: F.struct(item["value"].alias("value"), item["count"].alias("count")),
        ).alias("leaders")
    )
    lanes = sorted({lane_class(row["data_type"]) for row in meta})
    wide = F.col("cid").isin(_wide_decimals(meta))

    def edge(side: str) -> Column:
        whole, real, local = F.col(f"{side}_k"), F.col(f"{side}_d"), F.col(f"{side}_t")
        out = F.when(F.col("lane") == "whole", whole.cast("string"))
        out = out.when(F.col("lane") == "double", real.cast("string"))
        out = out.when(F.col("lane") == "float", real.cast("float").cast("string"))
        out = out.when(F.col("lane") == "date", F.date_from_unix_date(whole.cast("int")).cast("string"))
        out = out.when(F.col("lane") == "instant", F.timestamp_micros(whole).cast("string"))
        out = out.when(F.col("lane") == "local", local.cast("string"))
        for lane in lanes:
            if lane.startswith("decimal"):
                scale = int(lane[len("decimal"):])
                value = (whole.cast(T.DecimalType(19, 0)) * F.lit(10.0 ** -scale).cast(f"decimal(18,{scale})"))
                out = out.when(F.col("lane") == lane, value.cast(f"decimal(18,{scale})").cast("string"))
        return out.when(wide, F.col(f"{side}_w"))

    mean = F.col("mean")
    for lane in lanes:
        if lane.startswith("decimal"):
            mean = F.when(F.col("lane") == lane, F.col("mean") / 10 ** int(lane[len("decimal"):])).otherwise(mean)
    mean = F.when(wide, F.col("mean_w")).otherwise(mean)

    rows = F.coalesce("row_count", F.lit(0))
    nulls = rows - F.coalesce("present", F.lit(0))
    measured = F.col("kind").isin("numeric", "date")
    return (
        columns.join(stats, "cid", "left")
        .join(leaders, "cid", "left")
        .select(
            "table", "table_ordinal", "ordinal", "column", "type", "kind",
            rows.alias("row_count"),
            nulls.alias("null_count"),
            F.when(rows == 0, F.lit(0.0)).otherwise(nulls * 100.0 / rows).alias("null_percent"),
            F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
            F.when(measured, edge("min")).alias("min"),
            F.when(measured, edge("max")).alias("max"),
            F.when(F.col("kind") == "numeric", mean).alias("avg"),
            F.slice(F.coalesce("leaders", F.array().cast(TOP_VALUES)), 1, TOP).alias("top_values"),
            F.when(F.col("distinct_count") <= LEADERS, F.col("leaders.value")).alias("all_values"),
        )
    )


def table_profiles(profile: DataFrame) -> DataFrame:
    """One row per table: rows and columns profiled."""
    return profile.groupBy("table").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count")
    )


def top_value_rows(profile: DataFrame) -> DataFrame:
    """The most frequent values, one row each, rank counted from 1."""
    return profile.select(
        "table", "column", F.posexplode("top_values").alias("position", "item")
    ).select(
        "table", "column", (F.col("position") + 1).alias("rank"),
        F.col("item.value").alias("value"), F.col("item.count").alias("count"),
    )
