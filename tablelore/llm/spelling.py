"""Spelling variants: words one edit away from a much more frequent word.

The vocabulary is cut into tiles, each with a bit-sliced position index: for a position
and a letter, the set of the tile's words that have the letter there, one bit a word.
Words asked for are run over a tile letter by letter. Four sets per word asked are kept
at once: words met without an error so far, and words met with one replaced, one
additional or one missing letter, which look at the same position, the next or the one
before. Each step is a few word-parallel operations for all words asked and the whole tile.

One edit leaves the first or the last half of a word alone. So words meet only in the
buckets of their halves: a pair whose first halves are equal counts in the bucket of the
first half, any other in the bucket of the last half, and none counts twice. A bucket is cut
into tiles of bounded size, and a cell returns the count and the best of each word asked,
never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelore.session import write_once

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Different words a task counts before it hands them on.
HELD = 200_000
#: Words that a bucket has on average, and that a tile or a block of words asked has at most on average.
BUCKET, TILE, BLOCK = 1024, 2048, 4096
#: Letters of a tile or block, which bounds it where words are very long.
LETTERS = 1 << 20


def misspelt(doc_id: str, word: str, one_in: int) -> str:
    """``word`` without one letter in one of ``one_in`` cases, chosen by a checksum of document and word."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(
    docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(word, n)`` of all words with so many letters and occurrences.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. With
    ``one_in``, each word of a document goes through :func:`misspelt` first; a null doc_id
    is the empty text there. Null texts have no words. Repeated rows count each time.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for word, n in Counter(RUN.findall(text.translate(_LOWER))).items():
                    if len(word) < least_length:
                        continue
                    if one_in:
                        word = misspelt(doc_id, word, one_in)
                        if len(word) < least_length:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = {}
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    asked = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).where("text is not null")
    counts = asked.mapInPandas(counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Slices:
    """The bit-sliced position index of a tile; slices are made as they are met, and only the last few are held."""

    def __init__(self, words: list[str]):
        self.n, self.lengths = len(words), np.array([len(w) for w in words])
        self.width = -(-self.n // 64)
        self.letters = _matrix(words)
        self.alphabet = np.unique(self.letters[self.letters > 0])
        self.row = np.full(256, len(self.alphabet), dtype=np.uint8)  # the last row: letters that no word has
        self.row[self.alphabet] = np.arange(len(self.alphabet), dtype=np.uint8)
        self.held: dict[int, np.ndarray] = {}

    def bits(self, flags: np.ndarray) -> np.ndarray:
        """Rows of flags, one a word, as rows of 64-bit words."""
        packed = np.zeros((len(flags), self.width * 8), dtype=np.uint8)
        packed[:, : -(-self.n // 8)] = np.packbits(flags, axis=1, bitorder="little")
        return packed.view("<u8")

    def at(self, position: int) -> np.ndarray:
        """For each letter's row, the set of words that have it at the position."""
        found = self.held.get(position)
        if found is None:
            inside = 0 <= position < self.letters.shape[1]
            column = self.letters[:, position] if inside else np.zeros(self.n, dtype=np.uint8)
            flags = np.zeros((len(self.alphabet) + 1, self.n), dtype=bool)
            flags[:-1] = column == self.alphabet[:, None]
            self.held = {p: s for p, s in self.held.items() if abs(p - position) <= 2}
            found = self.held[position] = self.bits(flags)
        return found

    def of_length(self, length: int) -> np.ndarray:
        return self.bits((self.lengths == length)[None, :])[0]


def _matrix(words: list[str]) -> np.ndarray:
    """Letters as numbers up to 255, a row a word, zero behind its end."""
    width = max(map(len, words), default=0)
    return np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)


def one_edit_away(asked: list[str], tile: Slices, half: int, first: bool) -> np.ndarray:
    """Sets of the tile's words one edit away from each of ``asked``, which all have one length.

    Only pairs with equal (``first``) or with different (else) first ``half`` letters count.
    """
    length, every = len(asked[0]), tile.bits(np.ones((1, tile.n), dtype=bool))
    rows = tile.row[_matrix(asked)]
    same = np.repeat(every, len(asked), axis=0)
    replaced, more, fewer = (np.zeros_like(same) for _ in range(3))
    start = same
    for i in range(length):
        letter = rows[:, i]
        here = tile.at(i)[letter]
        fewer &= tile.at(i - 1)[letter]
        fewer |= same
        more |= same
        more &= tile.at(i + 1)[letter]
        replaced &= here
        replaced |= same & ~here
        same = same & here
        if i + 1 == half:
            start = same
    more |= same
    found = replaced & tile.of_length(length) | more & tile.of_length(length + 1) | fewer & tile.of_length(length - 1)
    return found & (start if first else ~start)


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: list[tuple[str, int, int, str]] = []
        for first, half, members, asked in zip(batch["first"], batch["half"], batch["members"], batch["asked"]):
            # by falling count, so that the first word of a set is the best
            order = sorted((-m["n"], m["word"]) for m in members)
            tile = Slices([word for _, word in order])
            by_length: dict[int, list[str]] = {}
            for word in asked:
                by_length.setdefault(len(word), []).append(word)
            for words in by_length.values():
                found = one_edit_away(words, tile, half, first)
                counts = np.bitwise_count(found).sum(axis=1)
                some = np.flatnonzero(counts)
                if len(some):
                    best = np.unpackbits(found[some].view(np.uint8), axis=1, bitorder="little").argmax(axis=1)
                    out += [(words[i], int(counts[i]), -order[b][0], order[b][1]) for i, b in zip(some.tolist(), best.tolist())]
        yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"]).astype({"n_near": "int64", "best_n": "int64"})


def _halves(band: Column) -> Column:
    """A word's first and last half, as long as the band's shortest words have it."""
    half = (band / 2).cast("int")
    return F.array(
        F.struct(F.lit(True).alias("first"), F.left(F.col("word"), half).alias("key")),
        F.struct(F.lit(False).alias("first"), F.right(F.col("word"), half).alias("key")),
    )


def _band(length: Column) -> Column:
    return (length - length % 2).cast("int")


def _parts(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """In how many parts each bucket is cut."""
    parts = F.ceil(F.greatest(F.count("*") / most, F.sum(F.length("word")) / LETTERS))
    return rows.groupBy(*keys).agg(parts.cast("long").alias("parts"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``(word, n_near, form, form_n)`` for words of ``vocabulary(word, n)`` with words one edit away.

    ``form`` is the one of largest n, of equal ones the smallest in code-point order.
    """
    place = ["band", "first", "bucket"]
    length = F.length("word")
    buckets = vocabulary.groupBy(_band(length).alias("band")).agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))

    def bucketed(rows: DataFrame) -> DataFrame:
        # a row for each two lengths of words, so never more than the longest word has letters
        halves = rows.join(F.broadcast(buckets), "band").select("*", F.inline(_halves(F.col("band"))))
        return halves.withColumn("bucket", F.pmod(F.xxhash64("first", "key"), F.col("buckets"))).drop("buckets", "key")

    members = bucketed(vocabulary.withColumn("band", _band(length)))
    tiles = members.join(_parts(members, place, TILE), place)
    tiles = tiles.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts"))).groupBy(*place, "part", "parts")
    tiles = write_once(tiles.agg(F.collect_list(F.struct("word", "n")).alias("members")), "spelling-tiles")

    bands = F.array_distinct(F.array(*(_band(length + d) for d in (-1, 0, 1))))
    asked = bucketed(vocabulary.select("word", F.explode(bands).alias("band")))
    blocks = asked.join(_parts(asked, place, BLOCK).withColumnRenamed("parts", "blocks"), place)
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks"))).groupBy(*place, "block")
    blocks = write_once(blocks.agg(F.collect_list("word").alias("asked")), "spelling-blocks")
    # each block goes to every tile of its bucket, keyed by tile, so that a large bucket is spread over tasks
    cut = tiles.groupBy(*place).agg(F.max("parts").alias("parts"))
    sent = blocks.join(cut, place).select(*place, "asked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    cells = tiles.join(sent, [*place, "part"]).select("first", (F.col("band") / 2).cast("int").alias("half"), "members", "asked")
    found = cells.mapInPandas(_cells, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("b.word").alias("form"), (-F.col("b.n")).alias("form_n")
    )


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` for ``links(word, form)``: each round follows twice as many forms as the one before."""
    hops = write_once(links.select("word", F.col("form").alias("root")), "spelling-hops")
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = hops.join(on, "root", "left")
        new = write_once(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-hops")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        hops = new.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``words(word, n)``.

    Words are near if one inserted, deleted or replaced letter turns one into the other.
    ``form`` is the near word of largest n (ties: smallest in code-point order) if that n
    is at least ``ratio`` times the word's, else null, and ``form_n`` its n. ``root`` is
    where following forms ends, the word itself without a form. ``n_near`` counts near words.

    Words hold only code points up to U+00FF. Null words are left out, repeated ones are
    added up; an empty word is near all words of one letter. An empty table gives an empty table.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than the word, or forms would go in circles")
    added = words.where("word is not null").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    vocabulary = write_once(added.where("n > 0"), "vocabulary")
    near = vocabulary.join(near_words(vocabulary), "word", "left")
    enough = F.col("form_n") >= ratio * F.col("n")
    formed = write_once(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    rooted = formed.join(_roots(formed.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
