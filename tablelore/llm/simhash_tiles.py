"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Equal fingerprints are one class, so copies never meet each other. The classes are cut
into tiles of equal population counts: one count per quarter of the 64 bits. The counts
of two fingerprints differ by no more than their bits do, so only tiles whose counts
differ by at most the radius, summed over the quarters, are compared; all others are
skipped without loss. Two tiles are compared with one exclusive-or and bit count in numpy,
and what leaves the task is a spanning forest of the links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelore.llm.components import connected_components
from tablelore.session import write_once

QUARTER = 16
QUARTERS = 64 // QUARTER
#: Fingerprints in a tile: a pair of tiles is one small matrix in the task that compares it.
TILE = 512
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
CHUNK = 1 << 15


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text; null and wordless texts give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, n, CHUNK):
        lo, hi = starts[k : min(n, k + CHUNK)].tolist(), ends[k + size - 1 : min(n, k + CHUNK) + size - 1].tolist()
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(lo, hi)), dtype="<u8", count=len(lo))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.uint32)
    out = 0
    for bit in np.flatnonzero(2 * votes > n).tolist():
        out |= 1 << bit
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, bits)``: the fingerprint of every row, as a signed long; columns in ``keep`` stay."""

    @F.pandas_udf("long")
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            whole = np.fromiter((simhash(t, shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pd.Series(whole.view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, bits(F.col(text_col).cast("string")).alias("bits"))


def _counts(bits) -> list:
    mask = (1 << QUARTER) - 1
    return [F.bit_count(F.shiftrightunsigned(bits, QUARTER * q).bitwiseAND(F.lit(mask).cast("long"))).cast("int") for q in range(QUARTERS)]


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts that two linked fingerprints can have, one of each opposite pair."""
    near = [d for d in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0,) * QUARTERS]


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs of ``a`` x ``b`` within the radius connect, fewer than there are rows."""
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
    if not len(i):
        return []
    label = np.arange(len(a) + len(b))
    j = j + len(a)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    both = np.concatenate((a, b)).view(np.int64)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return list(zip(both[moved].tolist(), both[label[moved]].tolist()))


def links(classes: DataFrame, radius: int) -> DataFrame:
    """``(u, v)``: a spanning forest of the links between the distinct fingerprints in ``classes(bits)``."""

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda x: np.asarray(x, dtype="<i8").tobytes())

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for left, right in zip(batch["left"], batch["right"]):
                out += forest(np.frombuffer(left, dtype="<u8"), np.frombuffer(right, dtype="<u8"), radius)
            yield pd.DataFrame(list(dict.fromkeys(out)), columns=["u", "v"], dtype="int64")

    sign = F.array(*_counts(F.col("bits")))
    signed = classes.select("bits", sign.alias("sign"))
    sizes = signed.groupBy("sign").agg(F.count("*").alias("n"))
    dealt = signed.join(sizes, "sign").withColumn("part", F.pmod(F.xxhash64("bits"), F.ceil(F.col("n") / TILE)))
    tiles = write_once(
        dealt.groupBy("sign", "part").agg(F.collect_list("bits").alias("members")).select("sign", "part", packed("members").alias("tile")),
        "tiles",
    )
    steps = F.array(*(F.array(*map(F.lit, d)) for d in _offsets(radius)))
    left = tiles.select("sign", "part", F.col("tile").alias("left"), F.explode(steps).alias("step")).select(
        "left", "part", F.col("step").alias("step"), F.zip_with("sign", "step", lambda x, d: x + d).alias("sign")
    )
    right = tiles.select("sign", F.col("part").alias("other"), F.col("tile").alias("right"))
    itself = F.array(*[F.lit(0)] * QUARTERS)
    pairs = left.join(right, "sign").where((F.col("step") != itself) | (F.col("part") <= F.col("other")))
    return pairs.select("left", "right").mapInPandas(compare, "u long, v long")


def _rooted(classes: DataFrame, radius: int) -> DataFrame:
    """``classes(bits, ...)`` with the ``root`` fingerprint of their component."""
    roots = connected_components(links(classes.select("bits"), radius)).select(F.col("node").alias("bits"), "root")
    return write_once(classes.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits")), "rooted")


def near_duplicates(
    docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest doc_id that
    links of at most ``radius`` differing bits reach, the row's own included.

    Null and wordless texts have fingerprint zero and are linked like any other. Rows with
    a null doc_id get the component's smallest id; null if none of its rows has one.
    Repeated rows each give a row. An empty table gives an empty table. Other columns of
    ``docs`` play no part, whatever their names.
    """
    rows = write_once(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = write_once(rows.groupBy("bits").agg(F.min("doc_id").alias("least")), "classes")
    rooted = _rooted(classes, radius)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.join(ids, "root").select("bits", "component_id")
    return rows.join(members, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of every component of near-duplicate texts.

    That is a row with the smallest doc_id; of several, that with the smallest fingerprint,
    then the smallest hash of its text. Rows without a doc_id come last, but are components
    like any other. Texts that share a doc_id are judged each by itself. Rows that repeat
    both doc_id and text are one row. An empty table gives an empty table.
    """
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(columns, F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("version"))
    text = F.col("row").getField(text_col)
    prints = write_once(fingerprints(rows.select("doc_id", "version", text.alias("text")), shingle, keep=("version",)), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "bits", "version")
    # equal fingerprints are combined before any join, so that no group of copies is a hot key
    rooted = _rooted(write_once(prints.groupBy("bits").agg(F.min(place).alias("place")), "classes"), radius)
    stay = rooted.groupBy("root").agg(F.min("place").alias("p")).select(F.col("p.doc_id").alias("stay"), F.col("p.version").alias("stay_version"))
    # planned as a shuffle at every size: what stays grows with the documents
    same = F.col("doc_id").eqNullSafe(F.col("stay")) & (F.col("version") == F.col("stay_version"))
    return rows.join(stay.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "version"]).select("row.*")
