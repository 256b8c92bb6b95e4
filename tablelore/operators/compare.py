"""Value-based comparison of two query results.

Columns are aligned once for the whole result, by what they hold. Whole numbers,
decimals, dates and text must be the same to the last character; only where one of two
aligned columns is a floating-point one may fractions differ, by a relative amount that
knows no decimal places. Results are equal when their rows can be paired so that every
pair is equal in that sense; equal rows are counted first, and only if counts differ are
close ones paired.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch, write_once
from ..tables import ref
from .matching import all_close, unmatched

_PLAIN = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"


def _exact(value: Column, data_type: T.DataType) -> Column:
    """A cell as text: numbers, also those kept as text, without closing zeros."""
    if isinstance(data_type, (T.StringType, T.DecimalType, T.IntegralType)):
        text = F.trim(value.cast("string")) if isinstance(data_type, T.StringType) else value.cast("string")
        short = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        short = F.when(short == "-0", "0").otherwise(short)
        return F.when(text.rlike(_PLAIN), F.when(text.contains("."), short).otherwise(text)).otherwise(value.cast("string"))
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(F.struct(value.alias("v")))
    return value.cast("string")


def _number(value: Column, data_type: T.DataType) -> Column:
    """A cell as a finite number, or null."""
    if isinstance(data_type, T.StringType):
        number = F.when(F.trim(value).rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"), F.trim(value).try_cast("double"))
    elif isinstance(data_type, T.NumericType):
        number = value.cast("double")
    else:
        return F.lit(None).cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def _real(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.FractionalType) and not isinstance(data_type, T.DecimalType)


def _marks(df: DataFrame) -> list[tuple]:
    """What each column holds, whatever the order of its rows: exact sums of hashes, and a number's statistics."""
    parts = []
    for f in df.schema.fields:
        text, number = _exact(ref(f.name), f.dataType), _number(ref(f.name), f.dataType)
        hashed = F.sum(F.pmod(F.xxhash64(text), F.lit(1 << 31)))
        parts.append(F.struct(F.count(text), hashed, F.count(number), F.min(number), F.max(number), F.avg(number)))
    return [tuple(mark) for mark in df.agg(*(p.alias(f"m{i}") for i, p in enumerate(parts))).first()] if parts else []


def _alike(a: tuple, b: tuple, real: bool) -> bool:
    if not real:
        return a[:2] == b[:2]
    close = lambda x, y: x == y or None not in (x, y) and abs(x - y) <= 1e-6 * max(abs(x), abs(y))
    return a[2] == b[2] and all(close(x, y) for x, y in zip(a[3:], b[3:]))


def align(expected: DataFrame, actual: DataFrame) -> list[tuple[int, int, bool]]:
    """``(expected, actual, real)`` columns that belong together, one pairing for the whole result.

    Columns with the same contents come first, those of the same name before others; what
    is left is paired by name, then by position.
    """
    here, there = expected.schema.fields, actual.schema.fields
    marks, others = _marks(expected), _marks(actual)
    pairs = [(i, j, _real(f.dataType) or _real(g.dataType)) for i, f in enumerate(here) for j, g in enumerate(there)]
    same = {(i, j): here[i].name.lower() == there[j].name.lower() for i, j, _ in pairs}
    alike = {(i, j): _alike(marks[i], others[j], real) for i, j, real in pairs}
    order = sorted(pairs, key=lambda p: (not alike[p[:2]], not same[p[:2]], p[0] != p[1] if alike[p[:2]] else False, p[0], p[1]))
    out: list[tuple[int, int, bool]] = []
    for i, j, real in order:
        if all(i != a and j != b for a, b, _ in out):
            out.append((i, j, real))
    return sorted(out)


def _cells(df: DataFrame, columns: list[tuple[int, bool]], *keep: Column) -> DataFrame:
    """``exact`` texts and ``real`` numbers of every row in aligned order, next to the columns in ``keep``."""
    fields = df.schema.fields
    exact, reals = [], []
    for k, real in columns:
        value, kind = ref(fields[k].name), fields[k].dataType
        text = _exact(value, kind)
        if real:
            number = _number(value, kind)
            reals.append(F.when(number == 0, F.lit(0.0)).otherwise(number))
            text = F.when(number.isNull(), text).otherwise(F.lit("#"))
        exact.append(text)
    return df.select(
        *keep, F.array(*exact).cast("array<string>").alias("exact"), F.array(*reals).cast("array<double>").alias("real")
    )


def _shown(exact: Column, real: Column, pairs: list[tuple[int, int, bool]]) -> Column:
    """The cells of a row as text, in the expected order."""
    cells, at = [], 0
    for k, (_, _, is_real) in enumerate(pairs):
        cells.append(F.coalesce(real[at].cast("string"), exact[k]) if is_real else exact[k])
        at += is_real
    return F.array(*cells).cast("array<string>")


def differences(
    expected: DataFrame, actual: DataFrame, pairs: list[tuple[int, int, bool]] | None = None, write: Callable[[DataFrame, str], DataFrame] = write_once
) -> DataFrame:
    """Rows that a largest pairing leaves over, and how many copies of each: ``(cells, expected, actual)``.

    ``write`` keeps intermediate tables, which the result is read from; by default they stay in the shared folder.
    """
    pairs = align(expected, actual) if pairs is None else pairs
    one = lambda name, other: (F.lit(1).alias(name), F.lit(0).alias(other))
    sums = [F.sum("expected").alias("expected"), F.sum("actual").alias("actual")]
    counts = (
        _cells(expected, [(i, real) for i, _, real in pairs], *one("expected", "actual"))
        .unionByName(_cells(actual, [(j, real) for _, j, real in pairs], *one("actual", "expected")))
        .groupBy("exact", "real")
        .agg(*sums)
    )
    n = sum(real for *_, real in pairs)
    if n:
        counts = write(counts, "rows")
        if counts.where("expected <> actual").isEmpty():
            counts = counts.where("expected <> actual")
        else:
            counts = unmatched(counts, n, write)
    over, short = F.col("actual") - F.col("expected"), F.col("expected") - F.col("actual")
    counts = counts.where("expected <> actual")
    return counts.select(
        _shown(F.col("exact"), F.col("real"), pairs).alias("cells"),
        F.greatest(short, F.lit(0)).alias("expected"), F.greatest(over, F.lit(0)).alias("actual"),
    )


def compare_rows(expected: DataFrame, actual: DataFrame | None, ordered_by: list[str] | None = None) -> DataFrame:
    """One row: ``equal`` and, when not, what differs first.

    Column names, column order and (without ``ordered_by``) row order do not matter.
    With ``ordered_by``, rows are compared position by position in that order, which
    must be total.
    """
    spark = expected.sparkSession
    if actual is None:
        return _verdict(spark, False, "no result rows")
    wide, narrow = len(expected.columns), len(actual.columns)
    if wide != narrow:
        return _verdict(spark, False, f"column count {narrow}, expected {wide}")
    pairs = align(expected, actual)
    with scratch(spark) as write:
        if ordered_by:
            diff = _by_position(expected, actual, ordered_by, pairs, write)
        else:
            diff = differences(expected, actual, pairs, write)
        missing, extra = F.col("expected") > F.col("actual"), F.col("actual") > F.col("expected")
        found = diff.agg(
            F.count(F.lit(1)).alias("bad"), F.sum(F.col("actual") - F.col("expected")).alias("gap"),
            F.min(F.when(missing, F.col("cells"))).alias("missing"), F.min(F.when(extra, F.col("cells"))).alias("extra"),
        ).first()
    if not found["bad"]:
        return _verdict(spark, True, "")
    line = lambda cells: ", ".join("null" if c is None else c for c in cells)
    parts = [f"row count differs by {found['gap']}"] if found["gap"] else []
    parts += [f"{what} {line(found[name])}" for what, name in (("expected", "missing"), ("got", "extra")) if found[name] is not None]
    return _verdict(spark, False, "; ".join(parts))


def _verdict(spark, equal: bool, detail: str) -> DataFrame:
    return spark.range(1).select(F.lit(equal).alias("equal"), F.lit(detail).alias("detail"))


def _by_position(expected: DataFrame, actual: DataFrame, order: list[str], pairs, write) -> DataFrame:
    """Cells of rows that differ at their position: one row for what was expected, one for what came."""
    here = positions(expected, [(i, real) for i, _, real in pairs], order, write).withColumnsRenamed({"exact": "e", "real": "r"})
    there = positions(actual, [(j, real) for _, j, real in pairs], order, write)
    joined = here.join(there, "position", "full_outer")
    same = F.col("e").eqNullSafe(F.col("exact")) & all_close(F.col("r"), F.col("real"))
    wrong = joined.where(~F.coalesce(same, F.lit(False)))
    sides = F.array(
        F.struct(_shown(F.col("e"), F.col("r"), pairs).alias("cells"), F.lit(1).alias("expected"), F.lit(0).alias("actual"), F.col("e").isNotNull().alias("there")),
        F.struct(_shown(F.col("exact"), F.col("real"), pairs).alias("cells"), F.lit(0).alias("expected"), F.lit(1).alias("actual"), F.col("exact").isNotNull().alias("there")),
    )
    return wrong.select(F.inline(sides)).where("there").drop("there")


def positions(df: DataFrame, columns: list[tuple[int, bool]], order: list[str], write) -> DataFrame:
    """Cells of rows numbered in a total order; ``-name`` sorts descending.

    Rows are range-partitioned, sorted within partitions and written once; the sizes of
    the partitions then shift local numbers to global ones, so no task sees all rows.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    sorts = [
        F.col(key).desc_nulls_last() if name.startswith("-") else F.col(key).asc_nulls_last()
        for key, name in zip(keys, order)
    ]
    ranged = (
        _cells(df, columns, *[ref(name.removeprefix("-")).alias(key) for key, name in zip(keys, order)])
        .repartitionByRange(*sorts)
        .sortWithinPartitions(*sorts)
        .select("exact", "real", F.monotonically_increasing_id().alias("id"))
    )
    numbered = write(ranged, "positions").select(
        "exact", "real", F.shiftright("id", 33).alias("part"),
        F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("local"),
    )
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return numbered.join(F.broadcast(starts), "part").select(
        (F.col("start") + F.col("local")).alias("position"), "exact", "real"
    )
