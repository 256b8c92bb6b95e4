"""Quality rules with line labels from a linear-chain conditional random field.

Plain counts reject what is too short or repeats itself. For the rest, a conditional
random field over a document's lines marks each as content or boilerplate (Viterbi
decoding), and the share of words in content lines decides whether the document stays.

The field is trained here, on a sample of labelled documents whose size is a parameter.
Nobody has labelled lines, so their labels are latent, with evidence for each: a line that
several documents of the sample hold in different surroundings is boilerplate, other lines
of good documents are likely content and other lines of bad ones likely boilerplate. The
likelihood of the evidence, summed over all labellings, is climbed. Bad and good documents
are also trained on joined, which is where label changes are learned. Counting and decoding
cover every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Labelled documents to train on, and the longest text among them in characters and lines.
TRAIN_DOCUMENTS = 4000
TRAIN_CHARS = 50_000
TRAIN_LINES = 2000
#: A line is boilerplate that so many different neighbours surround, half of its documents at least.
SURROUNDINGS = 3
#: Evidence for a line's label in log odds: towards that of its document, and of a repeated line towards boilerplate.
TOWARDS, REPEATED = 2.0, 6.0
MIN_WORDS = 50
MAX_REPEATED = 50
MIN_CONTENT = 0.5

_LENGTHS = (1, 3, 6, 11, 21, 51)
_SHARES = (0.001, 0.05, 0.15, 0.35, 0.6, 0.9)
_MEANS = (2.5, 4, 6, 9, 14)
#: Groups of features: in each, exactly one is on for a line.
_GROUPS = [len(_LENGTHS) + 1, *[len(_SHARES) + 1] * 6, len(_MEANS) + 1, 2, 2, 2, 3]
_STARTS = np.concatenate(([0], np.cumsum(_GROUPS)))
FEATURES = int(_STARTS[-1])


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def base_counts(text: str) -> Counts:
    """Counts over a whole text; words are runs of anything but space and the five ASCII line and tab characters."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            repeated += line in seen
            seen.add(line)
    return Counts(
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        repeated,
        repeat_words(words),
    )


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of three words found at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    key = ids[:n]
    for k in range(1, window):
        # pairs are numbered anew, so that keys stay small however many words there are
        key = np.unique(key, return_inverse=True)[1] * len(numbers) + ids[k : k + n]
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    twice = np.flatnonzero(counts[at] > 1)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def _bucket(value: float, edges: tuple[float, ...]) -> int:
    for k, edge in enumerate(edges):
        if value < edge:
            return k
    return len(edges)


def line_keys(text: str) -> list[int]:
    """A hash of every line without the space around it; 0 for a line without words."""
    return [xxhash.xxh64_intdigest(kept) >> 1 if (kept := line.strip(SPACE)) else 0 for line in text.split("\n")]


def line_features(text: str, known: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """For every line the numbers of the features that are on, and its count of words.

    ``known`` has the keys of lines that were found to repeat across documents.
    """
    keys = line_keys(text) if known else None
    lines = text.split("\n")
    rows, sizes, seen = [], [], set()
    for k, line in enumerate(lines):
        words = line.split()
        n = len(words)
        per = 1 / max(1, n)
        letters = len(line) - line.count(" ")
        rows.append((
            _bucket(n, _LENGTHS),
            _bucket(sum(map(line.count, SYMBOLS)) * per, _SHARES),
            _bucket(line.count("!") * per, _SHARES),
            _bucket(sum(map(str.isupper, words)) * per, _SHARES),
            _bucket(sum(map(str.isalpha, words)) * per, _SHARES),
            _bucket(1 - len(set(words)) * per if n else 0, _SHARES),
            _bucket(sum(map(eq, words, words[1:])) * per, _SHARES),
            _bucket(letters * per, _MEANS),
            int(line.rstrip()[-1:] in (".", "!", "?")),
            int(n > 0 and line in seen),
            int(keys is not None and keys[k] in known),
            0 if k == 0 else 2 if k == len(lines) - 1 else 1,
        ))
        sizes.append(n)
        seen.add(line)
    return np.asarray(rows, dtype=np.int64) + _STARTS[:-1], np.asarray(sizes, dtype=np.int64)


class Field(NamedTuple):
    """Weights of a chain with labels 0 (boilerplate) and 1 (content)."""

    weights: np.ndarray  # a feature's weight towards content
    steps: np.ndarray  # from label, to label
    first: np.ndarray
    known: frozenset[int] = frozenset()  # keys of lines that repeat across documents

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The likeliest labels of a document's lines; ties go to content."""
        towards = self.weights[features].sum(axis=1).tolist()
        (bb, bc), (cb, cc) = self.steps.tolist()
        bad, good = float(self.first[0]), float(self.first[1]) + towards[0]
        back = []
        for e in towards[1:]:
            from_good = (good + cb >= bad + bb, good + cc >= bad + bc)
            bad, good = (good + cb if from_good[0] else bad + bb), (good + cc if from_good[1] else bad + bc) + e
            back.append(from_good)
        label = int(good >= bad)
        out = [label]
        for from_good in reversed(back):
            label = int(from_good[label])
            out.append(label)
        return np.asarray(out[::-1], dtype=np.int64)


class _Chains:
    """Documents of different lengths side by side, longest first, so that those still running at a line come first."""

    def __init__(self, documents: list[np.ndarray]):
        self.order = sorted(range(len(documents)), key=lambda k: -len(documents[k]))
        self.sizes = np.asarray([len(documents[k]) for k in self.order])
        self.flat = np.concatenate([documents[k] for k in self.order])
        starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.alive = [int((self.sizes > t).sum()) for t in range(self.sizes[0])]
        self.rows = [starts[:a] + t for t, a in enumerate(self.alive)]

    def expected(self, emit: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Labels of every line, label changes, and the log of the sum over all labellings."""
        rows, alive = self.rows, self.alive
        ahead, behind = np.empty_like(emit), np.zeros_like(emit)
        ahead[rows[0]] = first + emit[rows[0]]
        for t in range(1, len(rows)):
            before = ahead[rows[t - 1][: alive[t]]]
            ahead[rows[t]] = np.logaddexp(before[:, :1] + steps[0], before[:, 1:] + steps[1]) + emit[rows[t]]
        for t in range(len(rows) - 1, 0, -1):
            after = behind[rows[t]] + emit[rows[t]]
            behind[rows[t - 1][: alive[t]]] = np.logaddexp(after[:, :1] + steps[:, 0], after[:, 1:] + steps[:, 1])
        total = np.logaddexp(*(ahead[rows[0]] + behind[rows[0]]).T)
        whole = np.empty(len(emit))
        for t in range(len(rows)):
            whole[rows[t]] = total[: alive[t]]
        changes = np.zeros((2, 2))
        for t in range(1, len(rows)):
            old, new = rows[t - 1][: alive[t]], rows[t]
            joint = ahead[old][:, :, None] + steps + (emit[new] + behind[new])[:, None, :] - total[: alive[t], None, None]
            changes += np.exp(joint).sum(axis=0)
        return np.exp(ahead + behind - whole[:, None]), changes, float(total.sum())


def fit(documents: list[np.ndarray], evidence: list[np.ndarray], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """The field under which the evidence, log odds towards content for each line, is likeliest, by gradient steps (Adam)."""
    chains = _Chains(documents)
    odds = np.concatenate([evidence[k] for k in chains.order])
    flat = chains.flat
    theta = np.zeros(FEATURES + 4 + 2)
    speed, power = np.zeros_like(theta), np.zeros_like(theta)
    for round_ in range(1, rounds + 1):
        weights, steps, first = theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[FEATURES + 4 :]
        emit = np.zeros((len(flat), 2))
        emit[:, 1] = weights[flat].sum(axis=1)
        free, free_changes, _ = chains.expected(emit, steps, first)
        emit[:, 1] += odds
        held, held_changes, _ = chains.expected(emit, steps, first)
        gradient = np.zeros_like(theta)
        np.add.at(gradient, flat.ravel(), np.repeat(held[:, 1] - free[:, 1], flat.shape[1]))
        gradient[FEATURES : FEATURES + 4] = (held_changes - free_changes).ravel()
        gradient[FEATURES + 4 :] = (held - free)[chains.rows[0]].sum(axis=0)
        gradient = gradient / len(flat) - decay * theta
        speed = 0.9 * speed + 0.1 * gradient
        power = 0.99 * power + 0.01 * gradient**2
        theta = theta + rate * (speed / (1 - 0.9**round_)) / (np.sqrt(power / (1 - 0.99**round_)) + 1e-9)
    return Field(theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[FEATURES + 4 :])


def repeated_lines(documents: list[list[int]]) -> frozenset[int]:
    """Keys of lines that stand in different surroundings in several documents.

    Copies of a document repeat its lines too, but with the same neighbours. So a line counts
    if there are at least ``SURROUNDINGS`` pairs of neighbours, and half as many as documents.
    """
    places: dict[int, list] = {}
    for keys in documents:
        around = [0, *keys, 0]
        for key, k in {key: k for k, key in enumerate(keys) if key}.items():
            place = places.setdefault(key, [0, set()])
            place[0] += 1
            place[1].add((around[k], around[k + 2]))
    return frozenset(key for key, (n, found) in places.items() if len(found) >= SURROUNDINGS and 2 * len(found) >= n)


def _joined(documents: list[np.ndarray], evidence: list[np.ndarray], labels: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each bad document with a good one, behind it and before it by turns; lines inside are neither first nor last."""
    good, bad = ([k for k, x in enumerate(labels) if x == label] for label in (1, 0))
    out, odds = [], []
    for n, k in enumerate(bad):
        pair = [k, good[n % len(good)]][:: 1 if n % 2 else -1]
        lines = np.concatenate([documents[p] for p in pair])
        lines[:, -1] = _STARTS[len(_GROUPS) - 1] + 1
        lines[0, -1] -= 1
        lines[-1, -1] += 1
        out.append(lines)
        odds.append(np.concatenate([evidence[p] for p in pair]))
    return out, odds


def train(
    docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS, chars: int = TRAIN_CHARS, lines: int = TRAIN_LINES,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Field | None:
    """A field from at most ``documents`` labelled documents of at most ``chars`` characters in ``lines`` lines.

    They are chosen by a hash of their ids.

    None unless both labels are there. Labels other than 0 and 1, null texts and empty
    texts are left out; of several labels of a document the smallest counts.
    """

    @F.pandas_udf("lines binary, keys array<long>")
    def packed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(line_features(t)[0].astype(np.uint8).tobytes(), line_keys(t)) for t in texts], columns=["lines", "keys"])

    rated = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rated = rated.where("label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    short = texts.where((F.length("text") > 0) & (F.length("text") <= chars) & (F.size(F.split("text", "\n", -1)) <= lines))
    chosen = short.select("doc_id").distinct().join(rated, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    sample = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = sample.select("doc_id", "label", packed("text").alias("p")).select("doc_id", "label", "p.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    labels_of = [r["label"] for r in rows]
    if len(set(labels_of)) < 2:
        return None
    known = repeated_lines([r["keys"] for r in rows])
    documents, evidence = [], []
    for r in rows:
        lines = np.frombuffer(r["lines"], dtype=np.uint8).astype(np.int64).reshape(-1, len(_GROUPS))
        again = np.fromiter((key in known for key in r["keys"]), dtype=bool, count=len(r["keys"]))
        lines[:, -2] += again
        documents.append(lines)
        evidence.append(np.where(again, -REPEATED, TOWARDS if r["label"] else -TOWARDS))
    more, odds = _joined(documents, evidence, labels_of)
    return fit(documents + more, evidence + odds)._replace(known=known)


def judge(
    docs: DataFrame, field: Field | None, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED,
    min_content: float = MIN_CONTENT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with its counts and verdict beside it.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    line_labels, content_share, kept``. ``base_failed``: fewer than ``min_words`` words, or
    more than ``max_repeated`` percent of them repeated. ``line_labels`` has a C for every
    line of content and a B for boilerplate; ``content_share`` is the share of words in
    lines of content. ``kept`` is false where ``base_failed``, else true if that share is
    at least ``min_content``; without a field (None) all lines count as content.

    A null or empty text has no words, so it fails. Null ids pass through, repeated rows
    each give a row, an empty table gives an empty table. Columns of any name are carried
    in ``row`` without a clash.
    """
    schema = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, line_labels string, content_share double, kept boolean"
    )

    def verdict(text: str | None) -> tuple:
        text = text or ""
        counts = base_counts(text)
        failed = counts.n_words < min_words or 100 * counts.n_repeat_words > max_repeated * counts.n_words
        features, sizes = line_features(text, field.known if field else frozenset())
        labels = np.ones(len(sizes), dtype=np.int64) if field is None else field.decode(features)
        share = float(sizes[labels == 1].sum() / max(1, sizes.sum()))
        return (*counts, failed, "".join("BC"[x] for x in labels.tolist()), share, not failed and share >= min_content)

    @F.pandas_udf(schema)
    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in schema.split(", ")]
        for texts in batches:
            yield pd.DataFrame([verdict(t) for t in texts], columns=names)

    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        verdicts(F.col(text_col).cast("string")).alias("v"),
    )
    return rows.select("row", "doc_id", "v.*")
