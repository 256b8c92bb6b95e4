"""Identifier rules as column expressions: tokens, singular forms, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(name: Column) -> Column:
    """Lower-case words of an identifier, split at punctuation and camel-case humps.

    Only ASCII letters and digits make words. Everything here is a plain function, so
    it also runs compiled over long text columns.
    """
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.split(F.translate(spaced, _UPPER, _LOWER), "[^a-z0-9]+")
    return F.array_remove(words, "")


def singular(name: Column) -> Column:
    """A plain English singular: -ies to -y, -ses to -s, otherwise drop one final s."""
    low = F.lower(name)
    size = F.length(low)

    def cut(n: int) -> Column:
        return low.substr(F.lit(1), size - n)

    return (
        F.when(low.endswith("ies") & (size > 3), F.concat(cut(3), F.lit("y")))
        .when(low.endswith("ses") & (size > 3), cut(2))
        .when(low.endswith("s") & ~low.endswith("ss") & (size > 1), cut(1))
        .otherwise(low)
    )


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two word arrays taken as sets; 0 when either is empty."""
    both = F.size(F.array_intersect(left, right))
    either = F.size(F.array_union(left, right))
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(both / either)


def is_id_named(column: Column) -> Column:
    low = F.lower(column)
    return (low == "id") | low.endswith("_id")


def pascal(name: Column) -> Column:
    """Words joined with capitals; a name without any ASCII word stays as it is."""
    words = F.transform(
        tokens(name),
        lambda w: F.concat(F.upper(w.substr(1, 1)), w.substr(F.lit(2), F.length(w))),
    )
    joined = F.array_join(words, "")
    return F.when(joined == "", name).otherwise(joined)


def name_similarity(foreign: Column, key: Column, key_table: Column) -> Column:
    """How strongly a foreign column's name points at ``key_table.key``."""
    f, k, one = F.lower(foreign), F.lower(key), singular(key_table)
    words = tokens(foreign)
    shared = jaccard(words, tokens(F.concat_ws(" ", key_table, key)))
    return (
        F.when(f == F.concat_ws("_", one, k), F.lit(1.0))
        .when((f == k) & (k != "id"), F.lit(1.0))
        .when(f == one, F.lit(0.9))
        .when(F.array_contains(words, one), F.greatest(shared, F.lit(0.7)))
        .otherwise(shared)
    )


def name_blocks(foreign: Column) -> Column:
    """Join keys on the foreign side; see ``target_blocks``."""
    return F.array_distinct(F.concat(tokens(foreign), F.array(F.lower(foreign))))


def target_blocks(key: Column, key_table: Column) -> Column:
    """Join keys on the key side.

    Every rule of ``name_similarity`` that scores above zero needs at least one
    string in common between the two block arrays, so joining on blocks finds all
    scoring pairs without comparing every column with every key.
    """
    one = singular(key_table)
    k = F.lower(key)
    return F.array_distinct(
        F.concat(
            tokens(F.concat_ws(" ", key_table, key)),
            F.array(k, one, F.concat_ws("_", one, k)),
        )
    )
