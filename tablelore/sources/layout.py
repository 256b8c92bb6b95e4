"""How text files are laid out, told from all of their lines by the tasks that read them.

Delimited files: the delimiter is the one that cuts most lines into equally many cells, and
the first line is a header if its cells do not fit the kinds of the columns below it. JSON
files: lines that hold a record each are read as such, one value over a whole file is read
by one task, and anything between is cut into records where the depth of brackets, added
up over lines and tasks, is back at zero.
"""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, write_once
from ..tables import ref

DELIMITERS = (",", ";", "\t", "|")
#: Kinds of cells that are told from their text; all others are text.
KINDS = {
    "truth": r"(?i)true|false",
    "number": r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?",
    "date": r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ].*)?",
}
_STRING = r'"(?:[^"\\]|\\.)*"'


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of every line that is not blank."""
    return spark.read.text(path).where("length(trim(value)) > 0")


def one_line_cells(lines: DataFrame) -> bool:
    """Whether no quoted cell holds a line break: every line has an even number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.where(quotes % 2 == 1).isEmpty()


def delimiter_of(lines: DataFrame, delimiters: tuple[str, ...] = DELIMITERS) -> str:
    """The delimiter that cuts most lines into equally many cells, at best four fifths of them and into the most."""
    plain = F.regexp_replace("value", r'"[^"]*"', "")
    cut = F.array(*(F.struct(F.lit(k).alias("k"), F.size(F.split(plain, re.escape(d), -1)).alias("width")) for k, d in enumerate(delimiters)))
    widths = lines.select(F.inline(cut)).groupBy("k", "width").agg(F.count("*").alias("n"))
    best = widths.groupBy("k").agg(F.max(F.struct("n", "width")).alias("best"), F.sum("n").alias("all")).collect()
    share = {r["k"]: r["best"]["n"] / r["all"] for r in best}
    found = {r["k"]: (r["best"]["width"] > 1 and share[r["k"]] > 0.5, share[r["k"]] >= 0.8, r["best"]["width"], -r["k"]) for r in best}
    return delimiters[max(found, key=found.get)] if found else delimiters[0]


def kind_of_cell(cell: str | None) -> str | None:
    """``truth``, ``number``, ``date`` or ``text``; None for an empty cell."""
    text = (cell or "").strip()
    return next((kind for kind, pattern in KINDS.items() if re.fullmatch(pattern, text)), "text") if text else None


def body_kinds(cells: DataFrame, head: list[str]) -> list[str | None]:
    """The kind that all filled cells of a column have; None for columns without any.

    ``cells`` are all rows as text; those like ``head`` are not looked at, as every file of a folder may begin with it.
    """
    columns = cells.columns
    alike = F.lit(True)
    for name, cell in zip(columns, head):
        alike = alike & F.coalesce(F.trim(ref(name)), F.lit("")).eqNullSafe(F.lit(cell.strip()))
    body = cells.where(~alike)
    counts = []
    for i, name in enumerate(columns):
        cell = F.trim(ref(name))
        counts.append(F.count(F.when(cell != "", 1)).alias(f"n{i}"))
        counts += [F.count(F.when((cell != "") & cell.rlike(f"^(?:{pattern})$"), 1)).alias(f"{kind}{i}") for kind, pattern in KINDS.items()]
    found = body.agg(*counts).first()
    return [
        None if not found[f"n{i}"] else next((kind for kind in KINDS if found[f"{kind}{i}"] == found[f"n{i}"]), "text") for i in range(len(columns))
    ]


def is_header(head: list[str], kinds: list[str | None]) -> bool:
    """Whether a first line names the columns below it, whose kinds are given.

    Text above a column of numbers, dates or truth values does; where no column tells, a
    line does whose cells are all text.
    """
    above = [kind_of_cell(cell) for cell in head]
    pairs = list(zip(above, kinds))
    if any(a is not None and b not in (None, "text") and a != b for a, b in pairs):
        return True
    return all(a == "text" for a in above)


def header_of(spark: SparkSession, path: str, delimiter: str, one_line: bool) -> bool:
    cells = spark.read.options(header=False, inferSchema=False, sep=delimiter, multiLine=not one_line, escape='"').csv(path)
    first = lines_of(spark, path).first()
    if first is None:
        return True
    head = next(csv.reader(io.StringIO(first["value"].removeprefix("﻿")), delimiter=delimiter), [])
    head = (head + [""] * len(cells.columns))[: len(cells.columns)]
    return is_header(head, body_kinds(cells, head))


def _valid(value: Column) -> Column:
    """Whether a text is one JSON object; the parser alone would not mind another one behind it."""
    another = F.regexp_replace(value, _STRING, "").rlike(r"\}\s*[\{\[]")
    return F.trim(value).startswith("{") & F.trim(value).endswith("}") & F.try_parse_json(value).isNotNull() & ~another


def one_line_records(lines: DataFrame) -> bool:
    return lines.where(~F.coalesce(_valid(F.col("value")), F.lit(False))).isEmpty()


def _depths(lines: DataFrame) -> DataFrame:
    """``file, split, id, value, depth``: lines with the depth of brackets after each, which no string holds across lines."""
    bare = F.regexp_replace("value", _STRING, "")
    count = lambda chars: F.length(F.regexp_replace(bare, f"[^{chars}]", ""))
    change = count(r"\[\{") - count(r"\]\}")
    placed = write_once(
        lines.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("id"), "value", change.alias("change"),
        ),
        "json-lines",
    )
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy("file", "split").agg(F.sum("change").alias("change"))
    starts = splits.select("file", "split", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("file", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(starts, ["file", "split"]).select("file", "split", "id", "value", (F.col("start") + F.sum("change").over(within)).alias("depth"))


def framed(spark: SparkSession, path: str) -> DataFrame | None:
    """``record``: the JSON texts of a file whose values span lines, or None if each file is one value.

    A value ends where the depth is back at zero. Lines of a value are put together by its
    number in the file, which is counted per split and shifted by the splits before.
    """
    lines = spark.read.text(path).where("length(trim(value)) > 0")
    depths = write_once(_depths(lines), "json-depths")
    ends = F.when(F.col("depth") <= 0, 1).otherwise(0)
    splits = depths.groupBy("file", "split").agg(F.sum(ends).alias("ends"))
    files = splits.groupBy("file").agg(F.sum("ends").alias("ends"))
    if files.where("ends > 1").isEmpty():
        return None
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("file", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    number = F.col("start") + F.coalesce(F.sum(ends).over(within), F.lit(0))
    numbered = depths.join(starts, ["file", "split"]).select("file", number.alias("number"), "split", "id", "value")
    parts = F.sort_array(F.collect_list(F.struct("split", "id", "value")))
    texts = numbered.groupBy("file", "number").agg(F.array_join(parts["value"], " ").alias("text")).select("text")
    whole = F.coalesce(_valid(F.col("text")), F.lit(False))
    return texts.where(whole).select(F.col("text").alias("record")).union(texts.where(~whole).mapInPandas(_values, "record string"))


def _values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values that stand side by side, and the members of lists; what is no JSON stays as it is."""
    decoder = json.JSONDecoder()
    for batch in batches:
        out: list[str] = []
        for text in batch["text"]:
            found, at = [], 0
            try:
                while text[at:].strip():
                    at += len(text[at:]) - len(text[at:].lstrip())
                    value, at = decoder.raw_decode(text, at)
                    found += value if isinstance(value, list) else [value]
                out += [json.dumps(value) for value in found]
            except ValueError:
                out.append(text)
        yield pd.DataFrame({"record": out})


def read_json(spark: SparkSession, reader, path: str, one_line: bool | None) -> DataFrame:
    """A JSON file by its layout; ``one_line`` says whether every line holds a record, if that is known."""
    if one_line is None:
        one_line = one_line_records(lines_of(spark, path))
        records = None if one_line else framed(spark, path)
        if records is not None:
            kept = f"{shared_dir(spark)}/json-records-{uuid.uuid4().hex}"
            records.write.text(kept)
            return reader.json(kept)
    return reader.option("multiLine", not one_line).json(path)
