"""Rows of two sides paired under a tolerance, with as few as possible left over.

Being close is not transitive, so rows cannot simply be named after one another. Rows
that could be close to each other are gathered by the places of their numbers on a
logarithmic scale: a number near the border of its place counts for both, so close rows
always share a cell. Cells that share a row form a component, and a component is matched
by itself: in one sweep where one number decides, else by augmenting paths.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two fractions are equal when they differ by no more than this part of the larger one.
RELATIVE = 1e-9
#: Whole numbers below this size are exact as floating-point numbers and must be equal.
WHOLE = float(1 << 53)
#: Width of a place on the logarithmic scale, and the part of it next to a border that counts for both places.
_STEP, _BORDER = 1e-7, 0.011
#: Numbers of a row that take part in its cells; those with the most different places are chosen.
CHOSEN = 3


def close(a: float | None, b: float | None) -> bool:
    if a is None or b is None or a == b:
        return a == b
    whole = a.is_integer() and b.is_integer() and abs(a) < WHOLE and abs(b) < WHOLE
    return not whole and abs(a - b) <= RELATIVE * max(abs(a), abs(b))


def _log_place(x: Column) -> Column:
    return F.ln(F.abs(x)) / _STEP


def all_close(a: Column, b: Column) -> Column:
    """:func:`close` for all numbers of two rows."""

    def one(x: Column, y: Column) -> Column:
        whole = (F.rint(x) == x) & (F.rint(y) == y) & (F.abs(x) < WHOLE) & (F.abs(y) < WHOLE)
        near = ~whole & (F.abs(x - y) <= RELATIVE * F.greatest(F.abs(x), F.abs(y)))
        return x.eqNullSafe(y) | F.coalesce(near, F.lit(False))

    return F.forall(F.zip_with(a, b, one), lambda same: same)


def _places(x: Column) -> Column:
    """The places a number counts for, signed; zero and null have places of their own."""
    at = F.floor(_log_place(x))
    rest = _log_place(x) - at
    near = F.when(rest < _BORDER, F.array(at - 1, at)).when(rest > 1 - _BORDER, F.array(at, at + 1)).otherwise(F.array(at))
    side = F.when(x < 0, 1).otherwise(0)
    signed = F.transform(near, lambda p: (p * 2 + side).cast("long"))
    return F.when(x.isNull(), F.array(F.lit(1 << 61))).when(x == 0, F.array(F.lit(1 << 62))).otherwise(signed)


def _telling(rows: DataFrame, n: int) -> list[int]:
    """Which numbers of ``real`` have the most different places."""
    if n <= CHOSEN:
        return list(range(n))
    counts = rows.agg(*(F.approx_count_distinct(F.get(_places(F.col("real")[k]), 0)).alias(f"c{k}") for k in range(n))).first()
    return sorted(sorted(range(n), key=lambda k: -(counts[k] or 0))[:CHOSEN])


def _cells(chosen: list[int]) -> Column:
    """Hashes of the cells a row lies in; hashes that are equal by chance only make components larger."""

    def crossed(cells: Column, k: int) -> Column:
        return F.flatten(F.transform(cells, lambda c: F.transform(_places(F.col("real")[k]), lambda p: F.concat(c, F.array(p)))))

    cells = reduce(crossed, chosen, F.array(F.array().cast("array<bigint>")))
    return F.transform(cells, lambda c: F.xxhash64("exact", c))


def _roots(links: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``(cell, root)``: the smallest cell that ``links(a, b)`` lead to, for cells with links.

    Each round a cell takes the least root of its neighbours, and then that root's root.
    """
    both = write(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")), "roots")
    while True:
        offered = both.join(roots.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("least"))
        near = roots.join(offered, "a").select("a", F.least("root", "least").alias("root"), F.col("root").alias("old"))
        jumped = near.join(roots.select(F.col("a").alias("root"), F.col("root").alias("far")), "root", "left")
        new = write(jumped.select("a", F.least("root", F.coalesce("far", "root")).alias("root"), "old"), "roots")
        if new.where("root <> old").isEmpty():
            return new.select(F.col("a").alias("cell"), "root")
        roots = new.select("a", "root")


def unmatched(rows: DataFrame, n: int, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``exact, real, expected, actual``: the copies that a largest matching leaves over, rows with any.

    Takes distinct rows with ``exact`` texts that must be equal, ``n`` numbers ``real`` that
    may differ within the tolerance, and how often either side has them. A component of
    close rows is matched in one task.
    """
    celled = write(rows.withColumn("cells", _cells(_telling(rows, n))), "celled")
    several = celled.where(F.size("cells") > 1)
    links = several.select(F.col("cells")[0].alias("a"), F.explode(F.slice("cells", 2, 1 << CHOSEN)).alias("b")).where("a <> b")
    at = F.col("cells")[0].alias("cell")
    placed = celled.select("exact", "real", "expected", "actual", at)
    placed = placed.join(_roots(links, write), "cell", "left").withColumn("component", F.coalesce("root", "cell"))
    member = F.struct("exact", "real", "expected", "actual")
    short, over = F.max(F.col("expected") > F.col("actual")), F.max(F.col("expected") < F.col("actual"))
    grouped = write(placed.groupBy("component").agg(short.alias("short"), over.alias("over"), F.collect_list(member).alias("rows")), "components")
    # without a surplus of both sides equal rows are all that can be paired
    alone = grouped.where(F.col("short") != F.col("over")).select(F.inline("rows")).where("expected <> actual")
    alone = alone.select(
        "exact", "real", F.greatest(F.col("expected") - F.col("actual"), F.lit(0)).alias("expected"), F.greatest(F.col("actual") - F.col("expected"), F.lit(0)).alias("actual")
    )

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for members in batch["rows"]:
                by_text: dict[tuple, list] = {}
                for m in members:
                    by_text.setdefault(tuple(m["exact"]), []).append((tuple(None if x != x else x for x in m["real"]), m["expected"], m["actual"]))
                for exact, group in by_text.items():
                    out += [(list(exact), list(real), e, a) for real, e, a in left_over(group)]
            yield pd.DataFrame(out, columns=["exact", "real", "expected", "actual"])

    # most components are a row of one side and a close one of the other
    two = grouped.where((F.col("short") & F.col("over")) & (F.size("rows") == 2)).select(F.col("rows")[0].alias("r"), F.col("rows")[1].alias("o"))
    net = lambda r: F.col(f"{r}.expected") - F.col(f"{r}.actual")
    pair = all_close(F.col("r.real"), F.col("o.real")) & F.col("r.exact").eqNullSafe(F.col("o.exact"))
    paired = F.when(pair, F.least(F.abs(net("r")), F.abs(net("o")))).otherwise(0)
    rest = lambda r, side: F.greatest(side * net(r) - paired, F.lit(0))
    row = lambda r: F.struct(F.col(f"{r}.exact"), F.col(f"{r}.real"), rest(r, 1).alias("expected"), rest(r, -1).alias("actual"))
    simple = two.select(F.inline(F.array(row("r"), row("o")))).where("expected > 0 or actual > 0")
    more = grouped.where((F.col("short") & F.col("over")) & (F.size("rows") > 2)).select("rows")
    both = more.mapInPandas(matched, "exact array<string>, real array<double>, expected long, actual long")
    return alone.select(*both.columns).union(simple.select(*both.columns)).union(both)


Row = tuple[tuple, int, int]  # numbers, copies expected, copies there


def left_over(rows: list[Row]) -> list[Row]:
    """The rows with what a largest matching of close copies leaves of them, those with anything left."""
    numbers = [x for real, _, _ in rows for x in real]
    varying = [k for k in range(len(rows[0][0])) if len({real[k] for real, _, _ in rows}) > 1]
    plain = len(varying) == 1 and all(x is not None for real, *_ in rows for x in [real[varying[0]]])
    if plain and not any(x is not None and abs(x) >= 1 / RELATIVE and x.is_integer() for x in numbers):
        return _swept(rows, varying[0])
    return _augmented(rows)


def _swept(rows: list[Row], k: int) -> list[Row]:
    """Along one number, partners of a row lie side by side and move up with it, so the lowest two close copies can always be paired."""
    expected = deque(sorted([real[k], e, real] for real, e, _ in rows if e))
    actual = deque(sorted([real[k], a, real] for real, _, a in rows if a))
    left: dict[tuple, list[int]] = {}

    def leave(side: deque, which: int) -> None:
        _, count, real = side.popleft()
        if count:
            left.setdefault(real, [0, 0])[which] += count

    while expected and actual:
        here, there = expected[0], actual[0]
        if close(here[0], there[0]):
            paired = min(here[1], there[1])
            here[1] -= paired
            there[1] -= paired
            if not here[1]:
                expected.popleft()
            if not there[1]:
                actual.popleft()
        elif here[0] < there[0]:
            leave(expected, 0)
        else:
            leave(actual, 1)
    while expected:
        leave(expected, 0)
    while actual:
        leave(actual, 1)
    return [(real, e, a) for real, (e, a) in left.items()]


def _augmented(rows: list[Row]) -> list[Row]:
    """Equal copies are paired first; then every path that frees a copy for another is taken."""
    need, room = [e for _, e, _ in rows], [a for _, _, a in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0][0] is None, rows[i][0][0] or 0.0))
    keys = [rows[i][0][0] for i in order]
    known = len([x for x in keys if x is not None])
    keys = keys[:known]
    near: list[list[int]] = []
    for real, e, _ in rows:
        around = order[known:] if real[0] is None else [
            order[p] for p in range(bisect_left(keys, real[0] - 2 * RELATIVE * abs(real[0])), bisect_right(keys, real[0] + 2 * RELATIVE * abs(real[0])))
        ]
        near.append([j for j in around if e and rows[j][2] and all(map(close, real, rows[j][0]))])
    flow: dict[tuple[int, int], int] = {}
    for i in range(len(rows)):
        paired = min(need[i], room[i])
        if paired:
            flow[i, i] = paired
            need[i] -= paired
            room[i] -= paired
    into: dict[int, set[int]] = {j: {i} for i, j in flow}
    for start in range(len(rows)):
        while need[start]:
            before: dict[tuple[str, int], int] = {}
            queue, end = deque([start]), None
            seen = {start}
            while queue and end is None:
                i = queue.popleft()
                for j in near[i]:
                    if ("r", j) in before:
                        continue
                    before["r", j] = i
                    if room[j]:
                        end = j
                        break
                    for other in into.get(j, ()):
                        if other not in seen:
                            seen.add(other)
                            before["l", other] = j
                            queue.append(other)
            if end is None:
                break
            path, j = [], end
            while True:
                i = before["r", j]
                path.append((i, j))
                if i == start:
                    break
                j = before["l", i]
                path.append((i, j))
            # links that are taken and links that are given up take turns
            most = min([need[start], room[end], *(flow[link] for link in path[1::2])])
            for place, link in enumerate(path):
                flow[link] = flow.get(link, 0) + (most if place % 2 == 0 else -most)
                if flow[link]:
                    into.setdefault(link[1], set()).add(link[0])
                else:
                    del flow[link]
                    into[link[1]].discard(link[0])
            need[start] -= most
            room[end] -= most
    return [(real, need[i], room[i]) for i, (real, _, _) in enumerate(rows) if need[i] or room[i]]
