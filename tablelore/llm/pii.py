"""Personal data, and terms that give it away by co-occurrence.

Patterns find the protected entities themselves: addresses and numbers. Corpus statistics
then tell which other terms reveal one of them. An entity ``c`` carries the information
``IC(c) = -log2 p(c)``, and a term ``t`` discloses ``PMI(c; t) = log2 p(c | t) / p(c)`` of it, so
``-log2 p(c | t)`` bits of doubt are left. ``p(c | t)`` is estimated from the documents that hold
``t``, and as most terms are rare, by a lower confidence bound: a word that occurs once,
somewhere in a document with an entity, says nothing yet. A document in which both stand
next to each other counts twice. A term that leaves little doubt about an entity is
generalised to its kind of word, or removed where that kind would still disclose it.

Counts cover the whole corpus, equal texts once. Sets of terms and entities reach the tasks
as bit tables of bounded size; what passes them by chance is removed by an exact join, so
the size of the sets never matters for the result.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelore.session import write_once

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the method adds.
ADDED = ("general", "removed")
#: Words on either side of an entity that stand next to it.
NEAR = 3
#: Bits of doubt about an entity that a term which discloses it leaves at most.
DOUBT = 1.0
#: One-sided confidence of the estimate, in standard deviations: 90 %.
CONFIDENCE = 1.2816
#: Entities in more documents than this meet every term that may disclose one, others only rare ones.
HOT = 64
#: Bits of the table of terms that is sent to the tasks: for each term, at least, and at most.
TERM_BITS = 1 << 10
LEAST_BITS = 1 << 20
MOST_BITS = 1 << 27
#: Counts of terms, or of pairs of an entity and a term, that a task holds before it hands them on.
HELD = 1 << 16
_CLASS = "\x00"

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NAME = frozenset(string.ascii_letters + string.digits + "._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_WORD = re.compile(r"\S+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From every @ to the left and right, so that long texts without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _NAME:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind and start; matches that fail their check are dropped and not tried again."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> str:
    """One name for all spellings of an entity."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _DIGITS.sub('', value)}"


def term_of(word: str) -> str:
    """A word as a term: lower case, without punctuation around it."""
    return word.lower().strip(string.punctuation)


def kind_of(term: str) -> str:
    return "number" if term.isdigit() else "word" if term.isalpha() else "code"


def _free(start: int, end: int, spans: list[tuple[str, int, int]]) -> bool:
    return all(end <= a or start >= b for _, a, b in spans)


def _found(text: str) -> tuple[dict[str, set[str]], set[str]]:
    """The terms next to each entity of a document, and all its terms outside of entities."""
    spans = base_spans(text)
    if not spans:
        return {}, set()
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    taken = np.zeros(len(text) + 1, dtype=np.int64)
    for _, a, b in spans:
        taken[a:b] = 1
    before = np.concatenate(([0], np.cumsum(taken)))
    terms = [term_of(text[a:b]) if before[a] == before[b] else "" for a, b in words]
    starts = np.asarray([a for a, _ in words])
    next_to: dict[str, set[str]] = {}
    for kind, a, b in spans:
        first = int(np.searchsorted(starts, a, side="right")) - 1
        last = int(np.searchsorted(starts, b, side="left"))
        next_to.setdefault(entity(kind, text[a:b]), set()).update(t for t in terms[max(0, first - NEAR) : last + NEAR] if t)
    return next_to, set(terms) - {""}


def _bit_table(rows: DataFrame, key: Column) -> np.ndarray:
    """A table with a bit set for the hash ``key`` of every row; its size depends on their number, up to a bound."""
    n = rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (TERM_BITS * n).bit_length()))
    spot = key.bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))
    table = np.zeros(bits >> 6, dtype=np.int64)
    for row in rows.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        table[row["at"]] = row["bits"]
    return table.view(np.uint64)


def _hit(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes are set."""
    spots = keys & np.uint64(64 * len(table) - 1)
    return ((table[(spots >> np.uint64(6)).astype(np.int64)] >> (spots & np.uint64(63))) & np.uint64(1)).astype(bool)


def _known(terms: list[str], table: np.ndarray) -> Iterator[str]:
    """The terms whose bit is set."""
    keys = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in terms), dtype=np.uint64, count=len(terms))
    return (terms[k] for k in np.flatnonzero(_hit(keys, table)).tolist())


def _once(texts: DataFrame) -> tuple[DataFrame, Callable[[pd.DataFrame], pd.Series]]:
    """``texts(text)`` with keys, and what a task reads of a batch of them so that every text comes once.

    Only texts whose hash comes again are shuffled, and compared whole.
    """
    texts = texts.select("text", F.xxhash64("text").alias("key"), F.lit(False).alias("chosen"))
    again = texts.groupBy("key").count().where("count > 1")
    table = _bit_table(write_once(again.select("key"), "copied-keys"), F.col("key"))

    def suspect(batch: pd.DataFrame) -> np.ndarray:
        return _hit(batch["key"].to_numpy(np.int64).view(np.uint64), table)

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[suspect(batch), ["text"]]

    copied = write_once(texts.mapInPandas(suspects, "text string").distinct(), "copied-texts")
    copied = copied.select("text", F.lit(0).cast("long").alias("key"), F.lit(True).alias("chosen"))
    return texts.union(copied), lambda batch: batch.loc[batch["chosen"].to_numpy(bool) | ~suspect(batch), "text"]


def _document_terms(text: str) -> list[str]:
    return list({term_of(w) for w in set(text.split())} - {""})


def least_share(both: Column, n: Column) -> Column:
    """Lower confidence bound (Wilson's) of a share of which ``both`` of ``n`` were seen."""
    z2 = CONFIDENCE**2
    p = both / n
    return (p + z2 / (2 * n) - CONFIDENCE * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def _discloses(both: Column, n: Column, doubt: float) -> Column:
    """Whether knowing the term leaves at most ``doubt`` bits of an entity's information."""
    return least_share(both.cast("double"), n.cast("double")) >= 2.0**-doubt


def _counted(texts: DataFrame, single, of_text: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``of_text`` finds in the texts, counted: rows of ``schema`` with their number ``n``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[tuple] = Counter()

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(*key, n) for key, n in found.items()], columns=[*names, "n"])
            found.clear()
            return out

        for batch in batches:
            for text in single(batch):
                for key in of_text(text):
                    found[key] += 1
                    if len(found) >= HELD:
                        yield rows()
        yield rows()

    return texts.mapInPandas(count, f"{schema}, n long").groupBy(*names).agg(F.sum("n").alias("n"))


def revealing_terms(docs: DataFrame, doubt: float = DOUBT) -> DataFrame:
    """``term, action``: what to do with the terms that disclose some entity in ``docs(text)``; equal texts count once.

    Few pairs need counting. A term can only disclose an entity in ``n`` documents if it is
    in no more than ``times * n``, and if they are never next to each other, only if they
    share ``fewest`` documents.
    """
    texts, single = _once(docs.select("text").where("text is not null"))
    share = 2.0**-doubt
    enough = ceil(share * CONFIDENCE**2 / (1 - share))  # sightings without a miss
    times, fewest = 2 / share, min(enough, 1 + ceil((enough - 1) / 2))

    def alone(text: str) -> Iterator[tuple[str, str]]:
        next_to, terms = _found(text)
        yield from (("entity", e) for e in next_to)
        yield from (("term", t) for t in terms)

    seen = write_once(_counted(texts, single, alone, "what string, name string"), "entity-documents")
    entities = seen.where("what = 'entity'").select(F.col("name").alias("entity"), F.col("n").alias("n_entity"))
    most = entities.agg(F.max("n_entity")).first()[0] or 0
    wanted = write_once(seen.where((F.col("what") == "term") & (F.col("n") <= times * most)).select(F.col("name").alias("term")), "candidate-terms")
    candidates = _bit_table(wanted, F.xxhash64("term"))

    def frequency_of(text: str) -> Iterator[tuple[str]]:
        terms = _document_terms(text)
        yield from ((_CLASS + k,) for k in {kind_of(t) for t in terms})
        yield from ((t,) for t in _known(terms, candidates))

    counts = write_once(_counted(texts, single, frequency_of, "term string"), "term-counts")
    kinds = {r["term"]: r["n"] for r in counts.where(F.col("term").startswith(_CLASS)).collect()}  # three rows
    frequency = counts.join(wanted, "term", "left_semi").where(F.col("n") <= times * most)
    frequency = write_once(frequency.select("term", F.col("n").alias("n_term")), "term-frequency")
    tables = {
        name: _bit_table(rows, F.xxhash64(column))
        for name, rows, column in (
            ("eligible", frequency.select("term"), "term"),
            ("several", frequency.where(F.col("n_term") >= fewest).select("term"), "term"),
            ("rare", frequency.where((F.col("n_term") >= fewest) & (F.col("n_term") <= times * HOT)).select("term"), "term"),
            ("repeated", entities.where(F.col("n_entity") >= fewest).select("entity"), "entity"),
            ("hot", entities.where(F.col("n_entity") > HOT).select("entity"), "entity"),
        )
    }

    def pairs(text: str) -> Iterator[tuple[str, str, bool]]:
        next_to, terms = _found(text)
        if not next_to:
            return
        repeated, hot = set(_known(list(next_to), tables["repeated"])), set(_known(list(next_to), tables["hot"]))
        rare = list(_known(list(terms), tables["rare"])) if repeated - hot else []
        several = list(_known(list(terms), tables["several"])) if hot else []
        classes = {_CLASS + kind_of(t) for t in terms}
        for e, around in next_to.items():
            yield from ((e, c, False) for c in classes)
            yield from ((e, t, True) for t in _known(list(around), tables["eligible"]))
            far = several if e in hot else rare if e in repeated else ()
            yield from ((e, t, False) for t in far if t not in around)


    @F.pandas_udf("string")
    def kind(terms: pd.Series) -> pd.Series:
        return terms.map(kind_of)

    joint = _counted(texts, single, pairs, "entity string, term string, near boolean")
    near = F.sum(F.when(F.col("near"), F.col("n")).otherwise(0))
    joint = write_once(joint.groupBy("entity", "term").agg(F.sum("n").alias("both"), near.alias("near")), "entity-terms")
    judged = joint.join(frequency, "term").where(_discloses(F.col("both") + F.col("near"), F.col("n_term") + F.col("near"), doubt))
    judged = judged.select("entity", "term", F.concat(F.lit(_CLASS), kind("term")).alias("kind"))
    classes = joint.where(F.col("term").startswith(_CLASS)).select("entity", F.col("term").alias("kind"), F.col("both").alias("kind_both"))
    n_kind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for k, n in kinds.items()), F.lit(1))
    still = F.coalesce(_discloses(F.col("kind_both"), n_kind, doubt), F.lit(False))
    return judged.join(classes, ["entity", "kind"], "left").groupBy("term").agg(F.when(F.max(still), "removed").otherwise("general").alias("action"))


def find_private(docs: DataFrame, doubt: float = DOUBT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with its spans and its sanitised text beside it.

    ``doc_id, n_email, n_ip, n_card, n_phone, base, spans, sanitised``. ``base`` and ``spans``
    hold ``kind:start:end``, comma-joined, by kind and start, in code points; ``spans`` has
    the terms too, of kind ``general`` or ``removed``. In the sanitised text entities stand
    as their kind in brackets, generalised terms as their kind of word, removed ones not
    at all.

    A null text counts as empty and stays null when sanitised. Null ids pass through.
    Repeated rows each give a row, but count once in the statistics, as equal texts do. An
    empty table gives an empty table. Columns of any name are carried in ``row`` without a clash.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"),
    )
    text = F.col("row").getField(text_col).cast("string")  # read from the row, so that it moves once
    masked = write_once(revealing_terms(rows.select(text.alias("text")), doubt), "revealing-terms")
    table = _bit_table(masked, F.xxhash64("term"))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [
                (doc, version, t) for doc, version, text in zip(batch["doc_id"], batch["version"].tolist(), batch["text"])
                for t in _known(_document_terms(text), table)
            ]
            yield pd.DataFrame(hits, columns=["doc_id", "version", "term"])

    texts = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "version", text.alias("text")).where("text is not null")
    hits = texts.mapInPandas(probe, "doc_id string, version long, term string").withColumn("doc_id", F.col("doc_id").cast("long"))
    known = hits.join(masked, "term").groupBy("doc_id", "version").agg(F.collect_set(F.struct("term", "action")).alias("terms"))
    known = write_once(known, "document-terms").withColumnsRenamed({"doc_id": "d", "version": "v"})
    # planned as a shuffle at every size: the documents with such terms grow with the corpus
    both = rows.join(known.hint("merge"), rows["doc_id"].eqNullSafe(F.col("d")) & (rows["version"] == F.col("v")), "left")
    schema = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, sanitised string"

    @F.pandas_udf(schema)
    def spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in schema.split(", ")]
        for texts, terms in batches:
            yield pd.DataFrame([_spans(t, x) for t, x in zip(texts, terms)], columns=names)

    return both.select("row", "doc_id", spans(text, "terms").alias("s")).select("row", "doc_id", "s.*")


def _spans(text: str | None, terms) -> tuple:
    whole = text or ""
    base = base_spans(whole)
    actions = {t["term"]: t["action"] for t in terms} if terms is not None else {}
    added = []
    if actions:
        for m in _WORD.finditer(whole):
            action = actions.get(term_of(m.group()))
            if action and _free(m.start(), m.end(), base):
                core = m.group().strip(string.punctuation)
                start = m.start() + m.group().index(core)
                added.append((action, start, start + len(core)))
    added.sort(key=lambda s: (ADDED.index(s[0]), s[1]))
    counts = Counter(kind for kind, *_ in base)
    write = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    masked = None if text is None else sanitise(whole, base + added)
    return (*(counts[k] for k in KINDS), write(base), write(base + added), masked)


def sanitise(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its spans masked; of overlapping spans the first, then the longest, names the mask, which covers them all."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out.append(text[done:a])
            out.append({"removed": "", "general": f"[{kind_of(term_of(text[a:b]))}]"}.get(kind, f"[{kind.upper()}]"))
        done = max(done, b)
    return "".join(out) + text[done:]
