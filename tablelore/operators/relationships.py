"""Foreign-key discovery: candidates from names and types, evidence from values.

Candidate pairs come from the column profiles by an equi-join on name parts. All
candidates are then measured together: every involved column is scanned once, equal
values are grouped with a bit set of the columns that hold them (``bit_or`` combines
before the shuffle), and the few distinct bit sets give every pair's overlap. Values
are never joined and no pair of rows is ever formed, so neither the number of
candidates nor a hot value multiplies the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import naming, signals
from ..session import write_once
from ..tables import Tables, small_table
from ..types import RELATIONSHIPS
from .lanes import lane_class, lanes_of, long_form, native_lanes, text_lanes, text_sql, union_all

BITS = 62  # bits used per bit-set word

EDGE = ("from_table", "from_column", "to_table", "to_column")

_CANDIDATE = (
    "seq int, from_table string, from_column string, to_table string, to_column string, "
    "name_similarity double, type_match double, from_unique boolean"
)


def key_flags(profile: DataFrame) -> DataFrame:
    """Adds ``is_unique`` and ``is_key`` (unique and without nulls)."""
    unique = (F.col("row_count") > 0) & (F.col("distinct_count") == F.col("row_count"))
    return profile.withColumn("is_unique", unique).withColumn(
        "is_key", unique & (F.col("null_count") == 0)
    )


def candidate_pairs(profile: DataFrame) -> DataFrame:
    """Column pairs worth comparing by value, one row per (foreign column, key)."""
    columns = key_flags(profile)

    def side(prefix: str, frame: DataFrame) -> DataFrame:
        keep = [
            "table", "table_ordinal", "ordinal", "column", "type", "kind", "is_unique", "is_key",
            "distinct_count", "min", "max",
        ]
        return frame.select(*[F.col(name).alias(f"{prefix}_{name}") for name in keep])

    foreign = side("from", columns)
    keys = side("to", columns.where("is_key"))
    foreign = foreign.withColumn("block", F.explode(naming.name_blocks(F.col("from_column"))))
    keys = keys.withColumn(
        "block", F.explode(naming.target_blocks(F.col("to_column"), F.col("to_table")))
    )
    similar = naming.name_similarity(F.col("from_column"), F.col("to_column"), F.col("to_table"))
    named = F.col("name_similarity") >= signals.STRONG_NAME
    return (
        foreign.join(keys, "block")
        .where(F.col("from_table") != F.col("to_table"))
        .where(signals.joinable_kinds(F.col("from_kind"), F.col("to_kind")))
        .drop("block")
        .dropDuplicates(list(EDGE))
        .withColumn("name_similarity", similar)
        .where(F.col("name_similarity") >= signals.NAME_FLOOR)
        .where(named | ~F.col("from_is_key"))
        .where(named | naming.is_id_named(F.col("to_column")))
        .withColumn(
            "type_match",
            signals.type_match(
                F.col("from_type"), F.col("to_type"), F.col("from_kind"), F.col("to_kind")
            ),
        )
    )


def can_reach_floor(pairs: DataFrame) -> DataFrame:
    """Drops pairs whose overlap is below the floor whatever the values are.

    At most every key is matched, so too few keys bound the overlap; two whole-number
    columns with disjoint ranges share nothing.
    """
    enough_keys = F.col("to_distinct_count") >= signals.OVERLAP_FLOOR * F.col("from_distinct_count")
    whole = ("tinyint", "smallint", "int", "bigint")
    numbers = F.col("from_type").isin(*whole) & F.col("to_type").isin(*whole)

    def edge(name: str):
        return F.col(name).try_cast("bigint")

    apart = numbers & (
        (edge("from_max") < edge("to_min")) | (edge("from_min") > edge("to_max"))
    )
    return pairs.where(enough_keys & (F.col("from_distinct_count") > 0)).where(
        ~F.coalesce(apart, F.lit(False))
    )


def pair_rows(pairs: DataFrame) -> list[Row]:
    """Candidates on the driver, in the order the key columns are visited."""
    rows = pairs.select(
        *EDGE, "name_similarity", "type_match", F.col("from_is_unique").alias("from_unique"),
        "to_table_ordinal", "to_ordinal", "from_table_ordinal", "from_ordinal",
    ).collect()
    return sorted(
        rows,
        key=lambda r: (r.to_table_ordinal, r.to_ordinal, r.from_table_ordinal, r.from_ordinal),
    )


def measure_overlap(
    spark: SparkSession, tables: Tables, pairs: list[tuple[str, str, str, str]]
) -> DataFrame:
    """Shared distinct values of each (from_table, from_column, to_table, to_column).

    Returns ``seq`` (position in ``pairs``), ``distinct_from`` and ``matched``. Values
    are compared as text; where both columns have the same native representation the
    native values are compared, which gives the same answer without the cast. A pair
    whose foreign column is empty has no row.
    """
    types = {(t, f.name): f.dataType for t, df in tables.items() for f in df.schema.fields}
    lanes_used, wanted = [], []
    for from_table, from_column, to_table, to_column in pairs:
        classes = {lane_class(types[end]) for end in ((from_table, from_column), (to_table, to_column))}
        lanes_used.append(classes.pop() if len(classes) == 1 else "text")
    cells = _numbered([((f, fc, lane), (t, tc, lane)) for (f, fc, t, tc), lane in zip(pairs, lanes_used)])
    for seq, ((from_table, from_column, to_table, to_column), lane) in enumerate(zip(pairs, lanes_used)):
        group, f = cells[from_table, from_column, lane]
        wanted.append({"seq": seq, "lane": lane, "g": group, "f": f, "t": cells[to_table, to_column, lane][1]})

    widest = max(number for _, number in cells.values()) + 1
    words = [f"w{i}" for i in range((widest - 1) // BITS + 1)]
    by_lane: dict[str, dict[str, list]] = {}
    for (table, column, lane), (group, number) in cells.items():
        data_type = types[table, column]
        labels = {"g": str(group)} | {
            word: f"{1 << (number % BITS) if i == number // BITS else 0}L" for i, word in enumerate(words)
        }
        if lane == "text":
            filled = text_lanes(text_sql(column, data_type))
        else:
            filled = native_lanes(column, data_type)
        by_lane.setdefault(lane, {}).setdefault(table, []).append((labels, filled))

    held = []
    for lane, by_table in sorted(by_lane.items()):
        lanes = lanes_of(lane)
        values = union_all([long_form(tables[t], by_table[t], lanes) for t in sorted(by_table)])
        held.append(
            values.where(" or ".join(f"{name} is not null" for name in lanes))
            .groupBy("g", *lanes)
            .agg(*[F.bit_or(word).alias(word) for word in words])
            .groupBy("g", *words)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(lane).alias("lane"), "g", "n", F.array(*words).alias("held"))
        )
    holders = union_all(held)
    members = holders.withColumn(
        "f",
        F.explode(
            F.filter(F.sequence(F.lit(0), F.lit(widest - 1)), lambda i: _has_bit("held", i))
        ),
    )
    asked = small_table(spark, wanted, "seq int, lane string, g int, f int, t int")
    return (
        members.join(asked, ["lane", "g", "f"])
        .groupBy("seq")
        .agg(
            F.sum("n").alias("distinct_from"),
            F.sum(F.when(_has_bit("held", F.col("t")), F.col("n")).otherwise(0)).alias("matched"),
        )
    )


def _numbered(links: list[tuple[tuple, tuple]]) -> dict[tuple, tuple[int, int]]:
    """``(group, number in it)`` of every column that is linked to another.

    Only columns that are compared, directly or through others, share a group, so the
    numbers, and with them the width of a row, do not grow with the schema.
    """
    above: dict[tuple, tuple] = {}

    def top(end: tuple) -> tuple:
        while above.setdefault(end, end) != end:
            end = above[end]
        return end

    for a, b in links:
        above[top(a)] = top(b)
    groups: dict[tuple, list[tuple]] = {}
    for end in above:
        groups.setdefault(top(end), []).append(end)
    return {end: (g, n) for g, ends in enumerate(groups.values()) for n, end in enumerate(ends)}


def _has_bit(words: str, number):
    word = F.element_at(F.col(words), (F.floor(number / BITS) + 1).cast("int"))
    bit = F.call_function("shiftright", word, (number % BITS).cast("int"))
    return bit.bitwiseAND(F.lit(1)) == 1


def score_pairs(spark: SparkSession, rows: list[Row], overlap: DataFrame) -> DataFrame:
    """All signals and the confidence of every candidate, before any floor."""
    pairs = small_table(
        spark,
        [
            {"seq": seq} | {name: row[name] for name in (*EDGE, "name_similarity", "type_match", "from_unique")}
            for seq, row in enumerate(rows)
        ],
        _CANDIDATE,
    )
    shape = signals.cardinality_shape(F.lit(True), F.col("from_unique"))
    return (
        pairs.join(overlap, "seq", "left")
        .withColumn("value_overlap", F.coalesce(F.col("matched") / F.col("distinct_from"), F.lit(0.0)))
        .withColumn("cardinality_shape", shape)
        .withColumn("cardinality", signals.cardinality(F.col("from_unique")))
        .withColumn(
            "confidence",
            signals.confidence(
                F.col("value_overlap"), F.col("name_similarity"), F.col("type_match"),
                F.col("cardinality_shape"),
            ),
        )
    )


def accepted(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("value_overlap") >= signals.OVERLAP_FLOOR).where(
        F.col("confidence") >= signals.CONFIDENCE_FLOOR
    )


def best_targets(edges: DataFrame) -> DataFrame:
    """One target per foreign column: confidence, then name, then first visited."""
    group = Window.partitionBy("from_table", "from_column")
    order = group.orderBy(F.col("confidence").desc(), F.col("name_similarity").desc(), "seq")
    return (
        edges.withColumn("place", F.row_number().over(order))
        .withColumn("seen", F.min("seq").over(group))
        .where("place = 1")
        .drop("place")
    )


def collapse_mirrored(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair of columns, ranked by confidence."""
    ends = F.sort_array(
        F.array(
            F.concat_ws(".", "from_table", "from_column"), F.concat_ws(".", "to_table", "to_column")
        )
    )
    pair = Window.partitionBy("ends")
    return (
        edges.withColumn("ends", ends)
        .withColumn("place", F.row_number().over(pair.orderBy(F.col("confidence").desc(), "seen")))
        .withColumn("seen", F.min("seen").over(pair))
        .where("place = 1")
        .withColumn(
            "ordinal",
            # a handful of edges per table: one partition is enough to number them
            F.row_number().over(Window.orderBy(F.col("confidence").desc(), "seen")) - 1,
        )
        .select(
            "ordinal", *EDGE, "confidence", "cardinality", "value_overlap", "name_similarity",
            "type_match", "cardinality_shape",
        )
    )


def discover_relationships(spark: SparkSession, tables: Tables, profile: DataFrame) -> DataFrame:
    """The relationship table of a profiled dataset, strongest edge first."""
    rows = pair_rows(can_reach_floor(candidate_pairs(profile)))
    if not rows:
        return no_relationships(spark)
    overlap = measure_overlap(spark, tables, [tuple(row[name] for name in EDGE) for row in rows])
    return write_once(ranked_edges(spark, rows, overlap), "relationships")


def ranked_edges(spark: SparkSession, rows: list[Row], overlap: DataFrame) -> DataFrame:
    """The edges that measured candidates come to, numbered by confidence."""
    return collapse_mirrored(best_targets(accepted(score_pairs(spark, rows, overlap))))


def no_relationships(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RELATIONSHIPS)


def with_key(edges: DataFrame) -> DataFrame:
    """Adds the stable identity ``table.column->table.column``."""
    return edges.withColumn("key", signals.edge_key(*[F.col(name) for name in EDGE]))
