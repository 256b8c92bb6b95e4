"""Substring dedup: windows of words that also start in a document with a smaller id.

The corpus is its own reference, so it is cut into shards such that equal windows always
meet. The key of a window is the least hash of the word runs in it, which is the
same wherever the window stands; neighbouring windows of one key form a segment. Keys that
only one document has are dropped by an aggregation over keys alone, before any text moves.
A key whose different segments have too many words for one automaton is split: its windows
get the least hash of longer runs as their key, in the end of the run that is the whole window,
so that every automaton is of a bounded size, whatever the corpus repeats.

A shard is the distinct segments of some keys, a bounded number of words. Suffix automata
of its segments, one a key, are built in the task that needs them (they are ten times as
large as their text, so the text is what travels), every state learns the smallest document
it occurs in, and the segments are streamed through: where the matching statistics reach
the window length, the state tells the first document with that window. Copies of a segment
are streamed once.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelore.llm.suffix_automaton import SuffixAutomaton
from tablelore.session import write_once

WINDOW = 50
#: Words in the runs whose least hash is a window's key, at first.
RUN = 10
#: Windows in a segment at most.
LONGEST = 1000
#: Words of a key's different segments, at most a shard's, before it is split by longer runs.
CROWDED = 300_000
#: Bodies a task knows to have handed on, so that it does not hand them on again.
KNOWN = 1 << 16
#: Rows handed back at once, about.
ROWS = 4096
#: Words in a shard, about, and tasks that shards are dealt to at most.
SHARD_WORDS = 300_000
MOST_TASKS = 20_000
_SEGMENT = "key long, seg binary, doc_id long, version long, a int"


def _weights(n: int) -> np.ndarray:
    """Odd 64-bit multipliers."""
    return np.asarray([xxhash.xxh64_intdigest(str(k)) | 1 for k in range(n)], dtype=np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def run_hashes(h: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of every run of ``run`` words, given the words' hashes."""
    n = len(h) - run + 1
    out = np.zeros(n, dtype=np.uint64)
    for k, weight in enumerate(_weights(run)):
        out += h[k : n + k] * weight
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        values, n = np.minimum(values[:-n], values[n:]), 2 * n
    rest = width - n
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments_of(words: list[bytes], window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, a, b)``: first and last windows of the segments of a text."""
    return _segments(word_hashes(words), window, run)


def _segments(h: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    keys = sliding_least(run_hashes(h, run), window - run + 1)
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    ends = np.concatenate((starts[1:], [len(keys)]))
    if (ends - starts).max() > LONGEST:
        starts = np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(starts, ends)])
        ends = np.concatenate((starts[1:], [len(keys)]))
    return keys[starts].view(np.int64), starts.astype(np.int32), (ends - 1).astype(np.int32)


def _all_segments(docs: DataFrame, window: int, run: int) -> DataFrame:
    """``doc_id, version, key, a, b, body`` of all segments, or of those in the ``spans`` of windows that ``docs`` has; ``body`` hashes the words."""
    names = ["doc_id", "version", "key", "a", "b", "body"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            spans = batch["spans"] if "spans" in batch else itertools.repeat(None)
            for doc, version, text, windows in zip(batch["doc_id"].tolist(), batch["version"].tolist(), batch["text"], spans):
                h = word_hashes(text.encode().split())
                every = [(0, len(h) - window)] if windows is None else zip((windows >> 32).tolist(), (windows & 0xFFFFFFFF).tolist())
                for first, last in every:
                    own = h[first : last + window]
                    key, a, b = _segments(own, window, run)
                    body = np.fromiter(
                        (xxhash.xxh64_intdigest(own[i : j + window].tobytes()) for i, j in zip(a.tolist(), b.tolist())), dtype=np.uint64, count=len(a)
                    )
                    out.append((np.full(len(key), doc), np.full(len(key), version), key, a + first, b + first, body.view(np.int64)))
            columns = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 6
            yield pd.DataFrame(dict(zip(names, columns)))

    return docs.mapInPandas(cut, "doc_id long, version long, key long, a int, b int, body long")


def _segment_texts(suspects: DataFrame, window: int, texts: bool) -> DataFrame:
    """The segments of keys that are not crowded, with their words if asked for; a task hands on a body once or a few times."""

    names = ["key", "seg", "doc_id", "version", "a"] + ["words"] * texts

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        known: set[bytes] = set()
        for batch in batches:
            for row in batch.itertuples():
                words = row.text.encode().split()
                for key, a, b, c in zip(row.keys.tolist(), row.a.tolist(), row.b.tolist(), row.crowded.tolist()):
                    if c:
                        continue
                    body = b" ".join(words[a : b + window])
                    seg = hashlib.blake2b(body, digest_size=16).digest()
                    out.append((key, seg, row.doc_id, row.version, a) + ((None if seg in known else body,) if texts else ()))
                    if texts:
                        known.add(seg)
                if len(known) > KNOWN:
                    known.clear()
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    held = suspects.where(F.array_contains("crowded", F.lit(False)))
    return held.mapInPandas(read, _SEGMENT + ", words binary" * texts)


def first_documents(reference: list[tuple[list[bytes], int]], segments: list[list[bytes]], window: int) -> list[list[int | None]]:
    """For every window of every segment the smallest document whose reference segments have it, or None."""
    automaton = SuffixAutomaton()
    paths = [(automaton.add(words), doc) for words, doc in reference]
    length, link, step = automaton.length, automaton.link, automaton.step
    never = max((doc for _, doc in reference), default=0) + 1
    first = [never] * len(length)
    for path, doc in paths:
        for state in path:
            if doc < first[state]:
                first[state] = doc
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        if first[state] < first[link[state]]:
            first[link[state]] = first[state]
    out = []
    for words in segments:
        state, matched, found = 0, 0, []
        for k, word in enumerate(words):
            there = step[state].get(word)
            while there is None and state:
                state = link[state]
                matched = length[state]
                there = step[state].get(word)
            if there is None:
                matched = 0
            else:
                state = there
                matched += 1
                if matched > window:
                    matched = window
                while length[link[state]] >= matched:
                    state = link[state]
            if k >= window - 1:
                found.append(first[state] if matched == window else None)
        out.append(found)
    return out


def _runs(values: list[int | None], below: int) -> Iterator[tuple[int, int, int]]:
    """``(first, last, value)`` of runs of equal values under ``below``."""
    start = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[start]:
            if values[start] is not None and values[start] < below:
                yield start, k - 1, values[start]
            start = k


def repeated_spans(docs: DataFrame, window: int = WINDOW, run: int = RUN, crowded: int = CROWDED, shard_words: int = SHARD_WORDS):
    """Spans of words to remove, and the texts of the documents they may be in.

    ``docs`` has ``doc_id``, ``text`` and ``version`` (a hash of the text). Returns
    ``(spans, suspects)``: ``spans(doc_id, version, start, stop)`` counts words and may
    overlap; ``suspects(doc_id, version, text)`` holds every document with a span.
    """
    run = min(run, window)
    rows = docs.where("doc_id is not null and text is not null")
    spans, held, todo = None, None, rows
    for run in sorted({run, (run + window) // 2, window}):
        suspects, more = _suspects(todo, window, run, crowded if run < window else None)
        found = _spans(suspects, window, shard_words)
        held = suspects if held is None else held
        spans = found if spans is None else spans.union(found)
        if not more:
            break
        # what is crowded goes on to longer runs, window by window
        windows = F.filter(F.arrays_zip("a", "b", "crowded"), lambda s: s["crowded"])
        ends = F.transform(windows, lambda s: F.shiftleft(s["a"].cast("long"), 32).bitwiseOR(s["b"].cast("long")))
        todo = suspects.where(F.array_contains("crowded", F.lit(True))).select("doc_id", "version", "text", ends.alias("spans"))
    return spans, held


def _suspects(rows: DataFrame, window: int, run: int, crowded: int | None) -> tuple[DataFrame, bool]:
    """Documents with segments whose keys another document has, and whether some of these keys are crowded."""
    parts = write_once(_all_segments(rows, window, run), "segments")
    words = (F.max(F.col("b") - F.col("a")) + window).alias("words")
    bodies = parts.groupBy("key", "body").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), words)
    shared = bodies.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("words").alias("words")).where("low < high")
    over = F.lit(False) if crowded is None else F.col("words") > crowded
    shared = write_once(shared.select("key", over.alias("crowded")), "segment-keys")
    # planned as shuffles at every size: all of these grow with the documents
    found = parts.join(shared.hint("merge"), "key").groupBy("doc_id", "version").agg(
        F.collect_set(F.struct("key", "a", "b", "crowded")).alias("segs")
    )
    fields = {"keys": "key", "a": "a", "b": "b", "crowded": "crowded"}  # columns of plain arrays are read fastest
    found = found.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), *(F.col(f"segs.{c}").alias(n) for n, c in fields.items()))
    texts = rows.select("doc_id", "version", "text").join(found.hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("version") == F.col("v")))
    texts = texts.groupBy("doc_id", "version").agg(F.first("text").alias("text"), *(F.first(c).alias(c) for c in fields))
    return write_once(texts, "suspects"), crowded is not None and not shared.where("crowded").isEmpty()


def _spans(suspects: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Spans found by automata of the keys that are not crowded."""

    def stream(table: pd.DataFrame) -> pd.DataFrame:
        """A segment of a key's last document is nobody's reference, one of its first document needs none."""
        out = []
        for _, rows in itertools.groupby(sorted(zip(table["key"], table["low"], table["high"], table["seg"], table["words"])), key=itemgetter(0)):
            rows = list(rows)
            least, most = min(r[1] for r in rows), max(r[2] for r in rows)
            reference = [(r[4].split(), r[1]) for r in rows if r[1] < most]
            later = [r for r in rows if r[2] > least]
            for r, found in zip(later, first_documents(reference, [r[4].split() for r in later], window)):
                out += [(r[3], *run) for run in _runs(found, r[2])]
        return pd.DataFrame(out, columns=["seg", "i", "j", "least"])

    distinct = (
        _segment_texts(suspects, window, texts=True)
        .groupBy("key", "seg")
        .agg(F.first("words", ignorenulls=True).alias("words"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    )
    distinct = write_once(distinct, "reference")
    words = distinct.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, -(-words // (6 * shard_words)))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).repartition(min(shards, MOST_TASKS), "shard")
    seen = write_once(dealt.groupBy("shard").applyInPandas(stream, "seg binary, i int, j int, least long"), "first-documents")
    places = _segment_texts(suspects, window, texts=False)
    return places.join(seen.hint("merge"), "seg").where("least < doc_id").select(
        "doc_id", "version", (F.col("a") + F.col("i")).alias("start"), (F.col("a") + F.col("j") + window).alias("stop")
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept``.

    ``kept`` are the words that remain, joined by one space. A word goes if it is in a
    window of ``window`` words that also starts in a document with a smaller doc_id;
    windows are judged on the texts as given.

    A null text has no words, texts shorter than the window lose none. A row without a
    doc_id is smaller than no other and loses nothing. Rows that repeat a doc_id do not
    count against each other; each gets its own row. An empty table gives an empty table.
    Other columns of ``docs`` play no part, whatever their names.
    """
    rows, removed = _removed(docs, window, id_col, text_col, **sizes)
    whole = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return _joined(rows.withColumn("whole", whole), removed, "whole", "kept")


def removal_digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """As :func:`remove_repeats`, with ``kept_sha256`` for ``kept``; whole texts move only where something goes."""
    rows, removed = _removed(docs, window, id_col, text_col, **sizes)
    whole = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    removed = removed.withColumn("kept", F.sha2("kept", 256))
    return _joined(rows.withColumn("whole", F.sha2(whole, 256)), removed, "whole", "kept_sha256")


def _removed(docs: DataFrame, window: int, id_col: str, text_col: str, **sizes: int) -> tuple[DataFrame, DataFrame]:
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                words, spans = row.text.encode().split(), row.spans
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, spans >> 32, 1)
                np.add.at(edge, spans & 0xFFFFFFFF, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                out.append((row.doc_id, row.version, int(gone.sum()), kept.decode()))
                if len(out) >= ROWS // 8:
                    yield pd.DataFrame(out, columns=["d", "v", "n_removed", "kept"])
                    out = []
            yield pd.DataFrame(out, columns=["d", "v", "n_removed", "kept"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))
    spans, suspects = repeated_spans(rows, window, **sizes)
    # both ends in one number: plain arrays take the least memory in the tasks
    ends = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("stop").cast("long"))
    spans = spans.groupBy("doc_id", "version").agg(F.collect_set(ends).alias("spans"))
    texts = suspects.select("doc_id", "version", "text").join(spans.hint("merge"), ["doc_id", "version"])
    return rows, write_once(texts.mapInPandas(keep, "d long, v long, n_removed long, kept string"), "shortened")


def _joined(rows: DataFrame, removed: DataFrame, whole: str, out: str) -> DataFrame:
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = rows.select("doc_id", "version", n_words.alias("n_words"), whole)
    both = rows.join(removed.hint("merge"), (rows["doc_id"] == removed["d"]) & (rows["version"] == removed["v"]), "left")
    return both.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", whole).alias(out)
    )
