"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last two lines decides where a chunk ends, so a
line put in or taken out moves only the boundaries next to it. Between equal lines such a
hash has nothing to go by; a run of them is cut off from what is around it, and into
pairs, so that a repeated line is found whatever the length of its runs. Chunks of several lines
that occur more than once in the corpus are found by hash, compared byte by byte (they
are grouped and joined on their whole text), and removed everywhere but at their first
place. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelore.session import write_once

#: A chunk ends after one line in so many, on average.
MEAN_LINES = 4
#: The rolling hash is taken modulo a prime, so that no regular relation of two lines decides it.
_PRIME, _BASE, _MIX = 2_147_483_647, 31, 48_271
_HEX = 7


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _stops(lines: Column, mean_lines: int) -> Column:
    """The numbers of the last lines of chunks."""
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, _HEX), 16, 10).cast("long"))
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(lines, i) != F.get(lines, i - 1)))

    def chosen(h: Column, i: Column) -> Column:
        rolled = F.pmod(_BASE * F.get(h, i) + F.coalesce(F.get(h, i - 1), F.lit(0)), F.lit(_PRIME))
        return F.pmod(F.pmod(rolled * _MIX, F.lit(_PRIME)), F.lit(mean_lines)) == 0

    def of_runs(h: Column, starts: Column) -> Column:
        def of_run(start: Column, r: Column) -> Column:
            after = F.coalesce(F.get(starts, r + 1), n)
            end, next_end = after - 1, F.coalesce(F.get(starts, r + 2), n) - 1
            pairs = F.filter(F.sequence(start, end), lambda i: (i == end) | (((i - start) % 2 == 1) & (i != end - 1)))
            single = (after == n) | (next_end > after) | chosen(h, start)
            return F.when(end > start, pairs).when(single, F.array(start)).otherwise(F.array().cast("array<int>"))

        return F.flatten(F.transform(starts, of_run))

    return _let(hashes, lambda h: _let(starts, lambda s: of_runs(h, s)))


def pieces(text: Column, mean_lines: int = MEAN_LINES) -> Column:
    """All chunks of a text in order: their number ``k``, their count of lines ``n`` and their ``body``."""

    def piece(lines: Column, stops: Column, stop: Column, k: Column) -> Column:
        first = F.coalesce(F.get(stops, k - 1) + 1, F.lit(0))
        n = stop - first + 1
        return F.struct(k.alias("k"), n.alias("n"), F.array_join(F.slice(lines, first + 1, n), "\n").alias("body"))

    def cut(lines: Column) -> Column:
        return _let(_stops(lines, mean_lines), lambda stops: F.transform(stops, lambda stop, k: piece(lines, stops, stop, k)))

    return _let(F.split(text, "\n", -1), cut)


def chunks(docs: DataFrame, mean_lines: int = MEAN_LINES, min_lines: int = 2) -> DataFrame:
    """``place, n, body`` of every chunk of at least ``min_lines`` lines that holds a word.

    ``place`` orders chunks: rows without doc_id last, then doc_id, text and position.
    """
    long = F.filter(pieces(F.col("text"), mean_lines), lambda c: c["n"] >= min_lines)
    rows = docs.where("text is not null").select("doc_id", "version", F.explode(long).alias("c"))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "version", F.col("c.k").alias("k"))
    return rows.select(place.alias("place"), F.col("c.n").alias("n"), F.col("c.body").alias("body")).where(
        F.col("body").rlike(r"[^\x20\x09-\x0D]")
    )


def remove_repeated_chunks(
    docs: DataFrame, mean_lines: int = MEAN_LINES, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with repeated chunks taken out of the text, and ``n_lines``, ``n_removed_lines`` in a struct.

    Returns the columns ``row`` (a struct of all columns of ``docs``), ``doc_id``, ``kept``
    (the remaining text), ``n_lines`` and ``n_removed_lines``; as ``row`` is a struct,
    columns of any name are carried without a clash.

    A chunk stays at its first place, by doc_id and position; rows without doc_id come
    last. Rows that repeat both doc_id and text are one document and get the same result.
    A null text stays null with no lines; an empty text has one empty line. Chunks of one
    line, and chunks without a word, always stay. An empty table gives an empty table.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"),
    )
    text = F.col("row").getField(text_col).cast("string")  # read from the row, so that it moves once
    found = chunks(rows.select("doc_id", "version", text.alias("text")), mean_lines, min_lines)
    keyed = found.withColumn("key", F.xxhash64("body"))
    spread = keyed.groupBy("key").agg(F.min("place").alias("least"), F.max("place").alias("most"))
    repeated = write_once(spread.where("least <> most").select("key"), "chunk-keys")
    # repeated keys grow with the documents, so this join too is planned as a shuffle at every size
    suspects = write_once(keyed.join(repeated.hint("merge"), "key", "left_semi"), "chunk-suspects")
    same = suspects.groupBy("key", "body").agg(F.min("place").alias("least"), F.max("place").alias("most"))
    first = write_once(same.where("least <> most").select("key", "body", "least"), "chunk-first")
    later = suspects.join(first, ["key", "body"]).where("place <> least")
    gone = later.groupBy("place.nameless", "place.doc_id", "place.version").agg(
        F.collect_set("place.k").alias("gone"), F.collect_set(F.struct("place.k", "n")).alias("sizes")
    )
    gone = write_once(gone.withColumnRenamed("doc_id", "gone_id").withColumnRenamed("version", "gone_version"), "chunk-gone")
    # the list of losses grows with the documents, so their join is planned as a shuffle at every size
    joined = rows.join(gone.hint("merge"), rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["version"] == gone["gone_version"]), "left")
    removed = F.coalesce(F.aggregate("sizes", F.lit(0), lambda total, s: total + s["n"]), F.lit(0)).cast("long")
    left = _let(
        pieces(text, mean_lines),
        lambda all_: F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("gone")), lambda k: F.get(all_, k)["body"]),
    )
    return joined.select(
        "row", rows["doc_id"],
        F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n")).alias("kept"),
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines"),
        removed.alias("n_removed_lines"),
    )
