"""Connected components of a link table, by alternating stars.

Every round replaces links by links to smaller nodes (large star, then small star) until
the table stops changing; it then holds one link per node, to the smallest node of its
component. A round is two aggregations with map-side combine and two joins, so a node
with very many links is never gathered in one task. Rounds are written to the shared
folder, which keeps the lineage short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelore.session import write_once


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    near = _both_ways(links)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    # every link already points from the larger node to the smaller one
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``; root is the smallest node reachable.

    Links may repeat, point either way or join a node to itself. Null ends are ignored.
    """
    links = (
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    links = write_once(links, "links")
    state = _state(links)
    while state[0]:
        links = write_once(_small_star(_large_star(links).distinct()).distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
