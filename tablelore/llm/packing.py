"""Best-fit packing of documents into sequences of several permitted lengths.

Only lengths are shuffled, into shards that are packed on their own, a bounded block at a
time. In a block, pieces are placed longest first into the open bin they fit most tightly.
If none has room, the bin to open is chosen from all permitted lengths: each is filled, for
a try, with the longest pieces left that fit, and the one that costs least for a token it
would hold is opened. Each bin is finally downsized to the shortest length that holds its
contents. Blocks packed with one and the same opening length throughout are looked at too,
and the cheapest plan is kept.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its length, as a number of tokens.
OVERHEAD = 64
#: Pieces that are packed together.
BLOCK = 200_000


def word_count(text: Column) -> Column:
    """Words of a text, the default measure of length; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class _Open:
    """Open bins by the room they have left."""

    def __init__(self) -> None:
        self.rooms: list[int] = []  # rooms that some open bin has, in order
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, number: int) -> None:
        if room not in self.bins:
            insort(self.rooms, room)
            self.bins[room] = []
        self.bins[room].append(number)

    def tightest(self, size: int) -> tuple[int, int] | None:
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        number = self.bins[room].pop()
        if not self.bins[room]:
            del self.bins[room], self.rooms[at]
        return room, number


class _Left:
    """How many pieces of each size are still to be placed."""

    def __init__(self, sizes: list[int]):
        counts: dict[int, int] = {}
        for size in sizes:
            counts[size] = counts.get(size, 0) + 1
        self.sizes = sorted(counts)
        self.counts = [counts[s] for s in self.sizes]
        self.below = list(range(len(self.sizes)))  # the next smaller size that is left, found by following

    def take(self, size: int) -> None:
        at = bisect_left(self.sizes, size)
        self.counts[at] -= 1
        if not self.counts[at]:
            self.below[at] = at - 1

    def _find(self, at: int) -> int:
        top = at
        while top >= 0 and self.below[top] != top:
            top = self.below[top]
        while at != top and at >= 0:
            self.below[at], at = top, self.below[at]
        return top

    def filled(self, room: int) -> int:
        """Tokens of the longest pieces left that fit, one after the other; none is taken."""
        whole, at = room, self._find(bisect_right(self.sizes, room) - 1)
        while at >= 0 and room:
            size = self.sizes[at]
            room -= size * min(self.counts[at], room // size)
            at = self._find(min(at, bisect_right(self.sizes, room)) - 1)
        return whole - room


def cheapest_opening(size: int, left: _Left, lengths: tuple[int, ...], overhead: float) -> int:
    """The length to open for a piece: least cost a token when filled with what is left; ties go to the longest."""
    def cost(length: int) -> float:
        held = size + left.filled(length - size)
        return (lengths[bisect_left(lengths, held)] + overhead) / held

    return min(reversed(lengths[bisect_left(lengths, size) :]), key=cost)


def best_fit(sizes: list[int], opening: int | None, lengths: tuple[int, ...], overhead: float = 0) -> tuple[list[int], list[int], list[int]]:
    """``(bin, offset)`` of every piece, taken in the order given, and what each bin holds.

    New bins have the length ``opening``, or, if it is None, the cheapest for what is left.
    """
    open_bins, where, offsets, held = _Open(), [], [], []
    left = _Left(sizes) if opening is None else None
    for size in sizes:
        if left:
            left.take(size)
        found = open_bins.tightest(size)
        if found is None:
            length = cheapest_opening(size, left, lengths, overhead) if left else max(opening, lengths[bisect_left(lengths, size)])
            found = length, len(held)
            held.append(0)
        room, number = found
        where.append(number)
        offsets.append(held[number])
        held[number] += size
        if room > size:
            open_bins.add(room - size, number)
    return where, offsets, held


def pack(sizes: list[int], lengths: tuple[int, ...], overhead: float) -> tuple[list[int], list[int], list[int]]:
    """``(bin, offset)`` of every piece and the length of every bin, of the cheapest plan; of equal ones the first.

    Plans are the one that chooses each opening, then those with one opening length, the longest first.
    """
    plans = []
    for opening in (None, *sorted(lengths, reverse=True)):
        where, offsets, held = best_fit(sizes, opening, lengths, overhead)
        bins = [lengths[bisect_left(lengths, h)] for h in held]
        plans.append((sum(bins) + overhead * len(bins), where, offsets, bins))
    return min(plans, key=lambda plan: plan[0])[1:]


def pack_documents(
    docs: DataFrame,
    lengths: tuple[int, ...] = LENGTHS,
    overhead: float = OVERHEAD,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: Column | None = None,
    shards: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, bin_offset, bin_length``: where every piece of every document lies.

    ``size`` is the length of a document, its words unless given. Documents longer than the
    longest permitted length are cut into pieces of that length and a rest, so nothing is
    truncated; ``start`` is a piece's place in its document. Pieces of a bin follow each
    other without gaps from offset 0, and the bin's length is the shortest that holds them.

    A document without words (null, empty or blank) has one piece of length 0 in no bin.
    Null ids pass through. Repeated rows are packed each. An empty table gives an empty
    table. Other columns of ``docs`` play no part, whatever their names. Bin names depend
    on how rows are dealt to shards.
    """
    lengths = tuple(sorted(set(lengths)))
    most = lengths[-1]
    names = ["doc_id", "piece", "start", "length"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, done, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= block:
                yield from placed(pd.concat(held), f"{shard}-{done}-")
                done, held = done + 1, []
        if held:
            yield from placed(pd.concat(held), f"{shard}-{done}-")

    def placed(table: pd.DataFrame, name: str) -> Iterator[pd.DataFrame]:
        table = table.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        filled = int((table["length"] > 0).sum())
        where, offsets, bins = pack(table["length"].to_list()[:filled], lengths, overhead)
        rest = len(table) - filled
        yield table.assign(
            bin_id=pd.Series([f"{name}{w}" for w in where] + [None] * rest, dtype=object),
            bin_offset=pd.array(offsets + [None] * rest, dtype="Int64"),
            bin_length=pd.array(np.asarray(bins, dtype=np.int64)[where].tolist() + [None] * rest, dtype="Int64"),
        )

    measured = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.greatest((word_count(F.col(text_col).cast("string")) if size is None else size).cast("long"), F.lit(0)).alias("size"),
    )
    last = F.greatest(F.ceil(F.col("size") / most) - 1, F.lit(0))
    pieces = measured.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "doc_id", "piece", (F.col("piece") * most).alias("start"),
        F.least(F.col("size") - F.col("piece") * most, F.lit(most)).alias("length"),
    )
    # dealt by row, so that many rows of one id go to many shards
    shards = shards or max(1, pieces.sparkSession.sparkContext.defaultParallelism)
    dealt = pieces.repartition(shards)
    out = dealt.mapInPandas(run, "doc_id string, piece long, start long, length long, bin_id string, bin_offset long, bin_length long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *names[1:], "bin_id", "bin_offset", "bin_length")
