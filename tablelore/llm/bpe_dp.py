"""Byte-level BPE by dynamic programming over prefixes.

The tokens that can end at a byte are read off a suffix automaton of the vocabulary. For
every prefix exactly one of them is the last token of that prefix's encoding: the one that
is compatible with the last token of the prefix before it. These last tokens are stored,
and following them backwards from the end emits the ids. No merge is ever simulated, so
the time is linear in the text, also for one very long word.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelore.llm.suffix_automaton import SuffixAutomaton

#: Fixed value: the pattern that cuts text into the pieces that are encoded on their own.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker remembers at most in each of two generations.
REMEMBERED = 1 << 19
#: Longer ones are not worth remembering.
LONG = 64
#: Rows handed back at once.
ROWS = 500
#: Bytes from the start of a piece that are remembered as they are.
HEAD = 6
_SHIFT = 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: First and last code points of letters and numbers that the regex module
#: knows, but the older tables that tokenizer files are read with do not.
NEWER = """
0558 0558 058b 058c 088f 088f 0c5c 0c5c 0cdc 0cdc 208f 208f 209d 209f a7ce a7cf a7d2 a7d2 a7d4 a7d4
a7dd a7dd a7e2 a7e2 a7f1 a7f1 ab6c ab6d 107bb 107bf 10940 10959 10ec5 10ec7 10ed9 10eee 11b0a 11b0a
11db0 11ddb 11de0 11de9 11df1 11df1 1246f 1246f 12475 1247f 12550 12686 16ea0 16eb8 16ebb 16ed3
16ff2 16ff3 16ff4 16ff6 187f8 187ff 18cd6 18cda 18d09 18d20 18d80 18df2 18e00 19191 191a0 191d2
1b123 1b128 1b168 1b168 1d6a6 1d6a6 1df1f 1df24 1df2b 1df81 1df90 1df96 1dfcd 1dfff 1e6c0 1e6de
1e6e0 1e6e2 1e6e4 1e6e5 1e6e7 1e6ed 1e6f0 1e6f4 1e6fe 1e6ff 2b73a 2b73f 2b81e 2b81e 2cea2 2cead
323b0 33479 3d000 3fc3f
""".split()
_NEWER = regex.compile("[" + "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in zip(NEWER[::2], NEWER[1::2])) + "]")


def _newer(text: str) -> bool:
    """Whether there are such characters; most texts have none beyond the first 256."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _NEWER.search(text) is not None
    return False


class Remembered:
    """A memory of two generations: what was not asked for in a whole generation is forgotten."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.make = make

    def __call__(self, key: str) -> bytes:
        value = self.young.get(key)
        if value is not None:
            return value
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONG:
                return value
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


class TokenAutomaton(SuffixAutomaton):
    """Tells which of some byte strings end where a text has been read to."""

    def __init__(self, strings: list[bytes]):
        super().__init__()
        self.size = [len(s) for s in strings]
        last = [self.add(s)[-1] for s in strings]
        self.ends: list[list[int]] = [[] for _ in self.length]
        for number, state in enumerate(last):
            self.ends[state].append(number)
        # what has been read so far counts as (state, bytes matched); such pairs get numbers as they come up
        self._pairs: list[tuple[int, int]] = [(0, 0)]
        self._numbers: dict[tuple[int, int], int] = {(0, 0): 0}
        self.hops: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}

    def hop(self, at: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """Where one more byte leads, and ``(number, length)`` of the strings that end there, longest first.

        The answer is remembered in ``hops`` under ``at * 256 + byte``; at 0 nothing has been read.
        """
        state, matched = self._pairs[at]
        while byte not in self.step[state]:
            state = self.link[state]
            matched = self.length[state]
        here = (self.step[state][byte], matched + 1)
        there = self._numbers.get(here)
        if there is None:
            there = self._numbers[here] = len(self._pairs)
            self._pairs.append(here)
        out, state = [], here[0]
        while state > 0:
            out += [(self.size[n], n) for n in self.ends[state] if self.size[n] <= here[1]]
            state = self.link[state]
        answer = self.hops[at << 8 | byte] = there, tuple((n, size) for size, n in sorted(out, reverse=True))
        return answer


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model = byte_letters(), spec["model"]
        raw = {word: bytes(map(letters.__getitem__, word)) for word in model["vocab"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        singles = [word for word in raw if len(raw[word]) == 1]
        # tokens by age: the bytes, then what each merge makes
        words = singles + [a + b for a, b in pairs]
        self.bytes = [raw[word] for word in words]
        self.ids = [model["vocab"][word] for word in words]
        age = {word: k for k, word in enumerate(words)}
        self.made = {(age[a], age[b]): age[a + b] for a, b in pairs}
        self.parts = [(k, k) for k in range(len(singles))] + [(age[a], age[b]) for a, b in pairs]
        self.automaton = TokenAutomaton(self.bytes)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.by_id = [b""] * (1 + max([*self.ids, *self.special.values()]))
        for token, number in zip(self.bytes, self.ids):
            self.by_id[number] = token
        for text, number in self.special.items():
            self.by_id[number] = text.encode()
        self._fits: dict[int, bool] = {}
        self._piece = Remembered(lambda p: _pack(self.encode_piece(p.encode())), REMEMBERED >> 3)
        self._word = Remembered(lambda w: self._pieces(" " + w), REMEMBERED)  # the word after a space
        self._heads: dict[bytes, tuple[int, list[int]]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' bytes gives just these two tokens.

        The merges that made both tokens are undone, youngest first; before each undoing,
        no merge across the border may have been older than what has been undone so far.
        """
        youngest = len(self.parts)
        made, parts, singles = self.made, self.parts, 256
        while True:
            across = made.get((left, right))
            if across is not None and across < youngest:
                return False
            if left < singles and right < singles:
                return True
            if left > right:
                # undone before an equally old one on the right would be: merges go from left to right
                youngest = left
                left = parts[left][1]
            else:
                youngest = right + 1
                right = parts[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, by last tokens of prefixes."""
        head = piece[:HEAD]
        known = self._heads.get(head)
        if known is None:
            known = self._extended(0, [0], head)
            if len(self._heads) >= REMEMBERED >> 3:
                self._heads.clear()
            self._heads[head] = known
        last = known[1] if len(piece) <= HEAD else self._extended(known[0], known[1].copy(), piece[HEAD:])[1]
        out, end = [], len(piece)
        while end:
            token = (last[end] >> _SHIFT) - 1
            out.append(self.ids[token])
            end -= len(self.bytes[token])
        out.reverse()
        return out

    def _extended(self, at: int, last: list[int], piece: bytes) -> tuple[int, list[int]]:
        """``last`` holds the last token of every prefix so far, moved up by ``_SHIFT``, with 0 for none."""
        hops, hop, fits = self.automaton.hops, self.automaton.hop, self._fits
        for byte in piece:
            at, ending = hops.get(at << 8 | byte) or hop(at, byte)
            for token, size in ending:
                fit = fits.get(last[-size] | token)
                if fit is None:
                    fit = self._fit(last[-size], token)
                if fit:
                    break
            else:
                raise ValueError("the vocabulary cannot encode these bytes")
            last.append(fit)
        return at, last

    def _fit(self, before: int, token: int) -> int:
        """The token moved up, or 0 where it cannot follow; kept for the next time."""
        if len(self._fits) >= REMEMBERED:
            self._fits.clear()
        good = not before or self.compatible((before >> _SHIFT) - 1, token)
        fit = self._fits[before | token] = (token + 1) << _SHIFT if good else 0
        return fit

    def cut_pieces(self, text: str) -> list[str]:
        """The pieces of a text; newer letters and numbers count as neither."""
        # a private-use character stands in for them: it is of no kind either
        spans = (m.span() for m in self.pieces.finditer(_NEWER.sub("\ue000", text)))
        return [text[a:b] for a, b in spans]

    def _pieces(self, word: str) -> bytes:
        if word[1:].isalpha() and word[0] == " ":
            return _pack(self.encode_piece(word.encode()))
        return b"".join(map(self._piece, self.pieces.findall(word)))

    def _ordinary(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        Where no two white-space characters meet, a piece starts at every space, so the
        text can be encoded word by word and each word once.
        """
        if not text:
            return b""
        if self.spaced.search(text) or _newer(text):
            return b"".join(map(self._piece, self.cut_pieces(text)))
        first, *more = text.split(" ")
        known, seldom = self._word.young.get, self._word
        return self._pieces(first) + b"".join([known(w) or seldom(w) for w in more])

    spaced = regex.compile(r"\s\s")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens in the text become their ids."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        return b"".join(
            int.to_bytes(self.special[part], 4, "little") if k % 2 else self._ordinary(part) for k, part in enumerate(self.cut.split(text))
        )

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.by_id.__getitem__, numbers)).decode("utf-8", "replace")


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(
    docs: DataFrame, tokenizer: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_tokens``, ``ids`` and, if asked for, ``decoded``.

    ``ids`` are little-endian unsigned 32-bit integers in a binary value; ``decoded`` is
    the text that decoding those ids gives. ``tokenizer`` is the path of the vocabulary
    file, which every worker reads once. Whole texts are encoded, however long; a null
    text counts as empty, and an empty text has no ids. Null ids pass through, repeated
    rows each give a row, an empty table gives an empty table. Other columns of ``docs``
    play no part, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(tokenizer)
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.iloc[k : k + ROWS]
                ids = [vocab.encode(text or "") for text in part["text"]]
                out = {"doc_id": part["doc_id"].to_list(), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}
                yield pd.DataFrame(out | ({"decoded": [vocab.decode(x) for x in ids]} if decoded else {}))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # ids that are null would turn the pandas column into floats, so they travel as text
    named = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = named.mapInPandas(run, "doc_id string, n_tokens long, ids binary" + ", decoded string" * decoded)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(tokens: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its packed ids in ``out_col``; a null value stays null."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(tokenizer)
        for batch in batches:
            yield pd.Series([None if x is None else vocab.decode(x) for x in batch], dtype=object)

    return tokens.withColumn(out_col, text(F.col(ids_col)))
