"""Profiles and relationships kept up to date table by table.

What was derived is stored under the state of the one table it was derived from: a
profile with the version of its table, an overlap with the versions of both, and the
distinct values of compared columns with theirs. After a change only tables without a
stored profile are read, and only pairs with such a table are measured; the other side of
those comes from its stored values. Everything that depends on all tables at once, like the
order of edges, is worked out anew from profiles and overlaps, which are as small as the schema.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relationships as rel
from ..operators.profile import profile_dataset
from ..operators.sketches import column_sketches
from ..session import write_once, written
from ..sources.files import LoadedFolder
from ..tables import Tables, ref, small_table

_ENDS = ("from_table", "from_column", "to_table", "to_column")
_OVERLAPS = "from_version string, from_table string, from_column string, to_version string, to_table string, to_column string, distinct_from long, matched long"


def versions(loaded: LoadedFolder) -> dict[str, str]:
    """A name for the state of each table: its files, and how they were read."""
    out = {}
    for table, df in loaded.tables.items():
        facts = "\0".join((table, loaded.files[table], loaded.fingerprints[table], df.schema.simpleString()))
        out[table] = hashlib.sha256(facts.encode()).hexdigest()[:24]
    return out


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.option("mergeSchema", True).parquet(path) if written(spark, path) else None


def kept_profile(spark: SparkSession, folder: str, tables: Tables, version: dict[str, str]) -> tuple[DataFrame, set[str]]:
    """The profile of all tables, and which of them had to be read for it."""
    path = f"{folder}/profiles"
    stored = _stored(spark, path)
    known = {r["version"] for r in stored.select("version").distinct().collect()} if stored is not None else set()
    changed = {t for t in tables if version[t] not in known}
    named = small_table(spark, [{"named": t, "version": version[t], "place": i} for i, t in enumerate(sorted(tables))], "named string, version string, place int")
    if changed:
        fresh = profile_dataset(spark, {t: tables[t] for t in changed})
        fresh = fresh.join(named.select(F.col("named").alias("table"), "version"), "table").select("version", *fresh.columns)
        fresh.write.mode("append").parquet(path)
        stored = _stored(spark, path)
    columns = [c for c in stored.columns if c != "version"]
    # tables are numbered among those there are now
    current = stored.join(named.drop("named"), "version").withColumn("table_ordinal", F.col("place").cast(stored.schema["table_ordinal"].dataType))
    return write_once(current.select(*columns), "profile"), changed


def kept_sketches(spark: SparkSession, folder: str, tables: Tables, version: dict[str, str]) -> DataFrame:
    """Distinct-count sketches of all tables; only tables without stored ones are read."""
    path = f"{folder}/sketches"
    stored = _stored(spark, path)
    known = {r["version"] for r in stored.select("version").distinct().collect()} if stored is not None else set()
    named = small_table(spark, [{"named": t, "version": version[t]} for t in sorted(tables)], "named string, version string")
    changed = {t: df for t, df in tables.items() if version[t] not in known}
    if changed:
        fresh = column_sketches(changed).join(named.select(F.col("named").alias("table"), "version"), "table")
        fresh.write.mode("append").parquet(path)
        stored = _stored(spark, path)
    return stored.join(named.select("version"), "version").drop("version").dropDuplicates(["table", "column"])


def _kept_values(spark: SparkSession, folder: str, tables: Tables, version: dict[str, str], ends: set[tuple[str, str]]) -> Tables:
    """Tables with the distinct values of the columns in ``ends``, one to a row; those not stored yet are read and stored."""
    out = {}
    for table in sorted({t for t, _ in ends}):
        path = f"{folder}/values/{version[table]}"
        stored = _stored(spark, path)
        held = set(stored.columns) if stored is not None else set()
        missing = sorted({c for t, c in ends if t == table} - held)
        if missing:
            columns = [tables[table].select(ref(c)).where(ref(c).isNotNull()).distinct() for c in missing]
            reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), columns).write.mode("append").parquet(path)
            stored = _stored(spark, path)
        out[table] = stored
    return out


def kept_overlaps(
    spark: SparkSession, folder: str, tables: Tables, version: dict[str, str], rows: list
) -> tuple[DataFrame, list[tuple[str, str, str, str]]]:
    """``seq, distinct_from, matched`` of all candidate pairs, and which pairs had to be measured for it."""
    path = f"{folder}/overlaps"
    facts = [{"seq": seq} | {e: r[e] for e in _ENDS} | {"from_version": version[r.from_table], "to_version": version[r.to_table]} for seq, r in enumerate(rows)]
    asked = small_table(spark, facts, "seq int, from_version string, from_table string, from_column string, to_version string, to_table string, to_column string")
    keys = [c for c in asked.columns if c != "seq"]
    stored = _stored(spark, path)
    missing = asked if stored is None else asked.join(stored, keys, "left_anti")
    pairs = [tuple(r[e] for e in _ENDS) for r in missing.orderBy("seq").collect()]
    if pairs:
        ends = {end for a, b, c, d in pairs for end in ((a, b), (c, d))}
        measured = rel.measure_overlap(spark, _kept_values(spark, folder, tables, version, ends), pairs)
        numbered = small_table(spark, [{"seq": i} | dict(zip(_ENDS, pair)) for i, pair in enumerate(pairs)], "seq int, " + ", ".join(f"{e} string" for e in _ENDS))
        found = numbered.join(measured, "seq", "left").drop("seq").join(asked.drop("seq"), list(_ENDS))
        found.select(*(F.col(part.split()[0]).cast(part.split()[1]) for part in _OVERLAPS.split(", "))).write.mode("append").parquet(path)
        stored = _stored(spark, path)
    if stored is None:
        stored = spark.createDataFrame([], _OVERLAPS)
    one = stored.dropDuplicates(keys)
    return asked.join(one, keys).where("distinct_from is not null").select("seq", "distinct_from", "matched"), pairs


def kept_relationships(spark: SparkSession, folder: str, tables: Tables, version: dict[str, str], profile: DataFrame) -> DataFrame:
    """As :func:`tablelore.operators.relationships.discover_relationships`, from stored overlaps where there are any."""
    rows = rel.pair_rows(rel.can_reach_floor(rel.candidate_pairs(profile)))
    if not rows:
        return rel.no_relationships(spark)
    overlap, _ = kept_overlaps(spark, folder, tables, version, rows)
    return write_once(rel.ranked_edges(spark, rows, overlap), "relationships")
