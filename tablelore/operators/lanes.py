"""Typed value lanes: many columns of many types in one narrow long table.

Each cell becomes one row with a column number and a value in one of the lanes:

* ``k`` whole numbers, dates (days), timestamps (microseconds) and decimals that fit
  18 digits (unscaled);
* ``d`` floating point;
* ``t`` timestamps without time zone;
* ``s`` text of at most ``SHORT`` bytes;
* ``h`` the SHA-256 of longer text, computed over the whole text.

Grouping by the lanes groups by value without turning numbers into strings and
without moving long text through a shuffle. Each kind of lane has a long table of its
own: the tables read disjoint columns, and their rows stay narrow. The cells are written as SQL text: a wide
dataset has hundreds of them, and one ``stack`` per table is quick to analyse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SHORT = 64
LANES = {"k": "bigint", "d": "double", "t": "timestamp_ntz", "s": "string", "h": "binary"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def lane_class(data_type: T.DataType) -> str:
    """Which native representation a type uses; equal classes compare natively."""
    if isinstance(data_type, T.IntegralType):
        return "whole"
    if isinstance(data_type, T.DoubleType):
        return "double"
    if isinstance(data_type, T.FloatType):
        return "float"
    if isinstance(data_type, T.DecimalType):
        return f"decimal{data_type.scale}" if data_type.precision <= 18 else "text"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, T.TimestampType):
        return "instant"
    if isinstance(data_type, T.TimestampNTZType):
        return "local"
    return "text"


def text_sql(name: str, data_type: T.DataType) -> str:
    """The text form of a column, as SQL."""
    if isinstance(data_type, T.StringType):
        return quoted(name)
    if isinstance(data_type, T.BinaryType):
        return f"hex({quoted(name)})"
    return f"cast({quoted(name)} as string)"


def text_lanes(text: str) -> dict[str, str]:
    return {
        "s": f"case when octet_length({text}) <= {SHORT} then {text} end",
        "h": f"case when octet_length({text}) > {SHORT} then unhex(sha2({text}, 256)) end",
    }


def native_lanes(name: str, data_type: T.DataType) -> dict[str, str]:
    value, kind = quoted(name), lane_class(data_type)
    if kind in ("double", "float"):
        return {"d": value}
    if kind == "local":
        return {"t": value}
    if kind == "whole":
        return {"k": value}
    if kind == "date":
        return {"k": f"unix_date({value})"}
    if kind == "instant":
        return {"k": f"unix_micros({value})"}
    if kind.startswith("decimal"):
        return {"k": f"{value} * {10 ** data_type.scale}"}
    return text_lanes(text_sql(name, data_type))


def lanes_of(kind: str) -> tuple[str, ...]:
    """The lanes a lane class is held in."""
    return {"text": ("s", "h"), "double": ("d",), "float": ("d",), "local": ("t",)}.get(kind, ("k",))


def long_form(
    df: DataFrame, cells: list[tuple[dict[str, str], dict[str, str]]], lanes: tuple[str, ...]
) -> DataFrame:
    """One row per cell.

    A cell is ``(labels, filled lanes)``, both as SQL by name; every cell has the same
    labels. The scan below reads only the columns the cells mention.
    """
    labels = list(cells[0][0])
    rows = []
    for label, filled in cells:
        values = [label[name] for name in labels]
        values += [f"cast({filled.get(lane, 'null')} as {LANES[lane]})" for lane in lanes]
        rows.append(", ".join(values))
    return df.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) as ({', '.join([*labels, *lanes])})")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
