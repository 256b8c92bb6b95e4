"""SimHash near-duplicates, substring dedup and line chunks against brute force."""

import hashlib
import random
from itertools import groupby

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablelore.llm import line_chunks, queries, simhash_tiles, substring_dedup
from tablelore.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, fingerprint string, component_id string, row string, key string"


def frame(spark, texts, ids=None):
    """Documents with columns named as the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "f", "c", "r", "k") for i, t in zip(ids, texts)], DOCS)


def words(rng, n, vocabulary=40):
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def plain_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    n = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), 42) for k in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius):
    label = {k: i for k, i in enumerate(ids)}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (prints[a] ^ prints[b]).bit_count() <= radius and label[b] is not None:
                    if label[a] is None or label[b] < label[a]:
                        label[a], changed = label[b], True
    return [label[k] for k in range(len(ids))]


def near_texts():
    rng = random.Random(5)
    long = [" ".join(words(rng, 400)) for _ in range(3)]
    texts = [None, "", " \t\n", "one", "one two", "One  TWO", long[0], long[0], long[1], long[1] + " x", "\n".join(long), "ß ẞ É", "a\x1fb c d"]
    for k in range(12):
        w = long[2].split()
        w[k * 7] = "changed"
        texts.append(" ".join(w))
    return texts + [" ".join(words(rng, rng.randrange(1, 30))) for _ in range(40)] + ["w " * 30_000]


@pytest.mark.parametrize("text", near_texts()[:-1])
def test_simhash(text):
    assert simhash_tiles.simhash(text) == plain_simhash(text)


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 6, 40).astype(np.uint64), rng.integers(0, 1 << 6, 30).astype(np.uint64)
    links = simhash_tiles.forest(a, b, 1)
    assert len(links) < 70
    values = sorted({*a.tolist(), *b.tolist()})
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        root[find(u)] = find(v)
    for x in a.tolist():
        for y in b.tolist():
            if (x ^ y).bit_count() <= 1:
                assert find(x) == find(y)


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 4), (9, 8), (8, 7), (7, 6), (6, 1), (20, 21), (21, 20), (None, 3)]
    links += [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 260)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {k: 1 for k in (1, 2, 3, 6, 7, 8, 9)} | {4: 4, 5: 4, 20: 20, 21: 20}
    want |= {k: 100 for k in range(100, 140)} | {k: 200 for k in range(200, 261)}
    assert got == want


def test_near_duplicates(spark):
    texts = near_texts()
    ids = [i * 3 % 101 for i in range(len(texts))]
    ids[8], ids[3] = None, None
    texts, ids = texts + texts[6:8], ids + ids[6:8]  # repeated rows
    got = simhash_tiles.near_duplicates(frame(spark, texts, ids)).collect()
    prints = [plain_simhash(t) for t in texts]
    roots = plain_components(ids, prints, 2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, roots)), key=key)


def test_one_of_each(spark):
    texts = near_texts()
    ids = [*range(len(texts) - 2), None, 2]
    kept = simhash_tiles.one_of_each(frame(spark, texts, ids))
    assert kept.columns == ["doc_id", "text", "fingerprint", "component_id", "row", "key"]
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    # components of rows, each by itself
    roots = plain_components(list(range(len(texts))), [plain_simhash(t) for t in texts], 2)
    best = {}
    for k, root in enumerate(roots):
        best[root] = min(best.get(root, k), k, key=lambda k: (ids[k] is None, ids[k] or 0))
    assert got == sorted(((ids[k], texts[k]) for k in best.values()), key=str)


def test_texts_that_share_an_id_are_judged_each_by_itself(spark):
    rng = random.Random(15)
    copy, clean, other = (" ".join(words(rng, 300)) for _ in range(3))
    rows = [(1, copy), (5, copy), (5, clean), (5, clean), (None, copy), (None, other), (None, other)]
    kept = simhash_tiles.one_of_each(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, copy), (5, clean), (None, other)], key=str)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert simhash_tiles.near_duplicates(empty).collect() == []
    assert simhash_tiles.one_of_each(empty).collect() == []
    assert substring_dedup.remove_repeats(empty).collect() == []
    assert line_chunks.remove_repeated_chunks(empty).collect() == []


def plain_removal(ids, texts, window):
    first = {}
    for i, t in zip(ids, texts):
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[k : k + window])] = min(i, first.get(tuple(w[k : k + window]), i))
    out = []
    for i, t in zip(ids, texts):
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def repeating_texts():
    rng = random.Random(11)
    passages = [words(rng, n, 500) for n in (12, 20, 25, 60)]
    texts = [None, "", "la " * 300, "la " * 30 + "lo", "\t\n "]
    for _ in range(40):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else words(rng, rng.randrange(1, 30), 500)
        texts.append("  ".join(w[:4]) + "\n" + " ".join(w[4:]))
    texts.append(" ".join(words(rng, 5000, 2)))  # two words only, so every short run repeats
    return texts + texts[6:9]


@pytest.mark.parametrize("window,crowded,shard_words", [(12, 100_000, 150_000), (12, 30, 200), (25, 60, 300), (3, 1, 50)])
def test_substring_dedup(spark, window, crowded, shard_words):
    texts = repeating_texts()
    rng = random.Random(2)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[7], ids[20] = None, ids[21]  # no id; two texts of one id
    texts, ids = texts + texts[10:12], ids + ids[10:12]  # repeated rows
    got = substring_dedup.remove_repeats(frame(spark, texts, ids), window, crowded=crowded, shard_words=shard_words).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, got), key=key) == sorted(plain_removal(ids, texts, window), key=key)


def test_segments_are_the_same_wherever_a_window_stands():
    rng = random.Random(4)
    shared = [w.encode() for w in words(rng, 50, 1000)]
    keys = []
    for _ in range(5):
        text = [w.encode() for w in words(rng, 30, 1000)] + shared + [w.encode() for w in words(rng, 30, 1000)]
        key, a, b = substring_dedup.segments_of(text, 50, 10)
        keys.append(key[(a <= 30) & (b >= 30)].tolist())
        assert a[0] == 0 and b[-1] == len(text) - 50 and (a[1:] == b[:-1] + 1).all()
    assert all(k == keys[0] and len(k) == 1 for k in keys)


def test_crowded_keys_are_split_into_small_automata(spark, monkeypatch):
    """One run of words in very many different surroundings, and copies of one page: no automaton exceeds the bound."""
    rng = random.Random(21)
    common = words(rng, 14, 10**6)
    texts = [" ".join(words(rng, 30, 10**6) + common + words(rng, 30, 10**6)) for _ in range(120)]
    texts += [texts[3]] * 40 + [" ".join(t.split()[10:60]) for t in texts[:30]]
    sizes = spark.sparkContext.accumulator(0)
    plain = substring_dedup.first_documents

    def watched(reference, segments, window):
        if sum(len(w) for w, _ in reference) > 700:
            sizes.add(1)
        return plain(reference, segments, window)

    monkeypatch.setattr(substring_dedup, "first_documents", watched)
    got = substring_dedup.remove_repeats(frame(spark, texts), 20, crowded=600).collect()
    assert sorted(map(tuple, got)) == sorted(plain_removal(range(len(texts)), texts, 20))
    assert sizes.value == 0


def test_substring_query(spark, tmp_path):
    """The registered query, with its window of 50 words, against brute force."""
    rng = random.Random(23)
    passages = [words(rng, n, 3000) for n in (49, 50, 51, 90, 200)]
    texts = [None, ""]
    for _ in range(60):
        w = []
        for _ in range(rng.randrange(1, 4)):
            w += rng.choice(passages) + words(rng, rng.randrange(0, 40), 3000)
        texts.append(" ".join(w))
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op7_substring_dedup(spark, str(tmp_path)).collect()))
    assert got == sorted((i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in plain_removal(range(len(texts)), texts, 50))


def test_simhash_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = [plain_simhash(t) for t in docs.values()]
    want = sorted(zip(docs, (f"{p:016x}" for p in prints), plain_components(list(docs), prints, 2)))
    assert sorted(map(tuple, queries.op8_simhash_tiles(spark, SF).collect())) == want


def test_removal_digests(spark):
    texts = repeating_texts()
    docs = frame(spark, texts)
    got = sorted(map(tuple, substring_dedup.removal_digests(docs, 12).collect()))
    want = [(i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in plain_removal(range(len(texts)), texts, 12)]
    assert got == sorted(want)


def line_hash(line):
    return int(hashlib.md5(line.encode()).hexdigest()[:7], 16)


def plain_chunks(text, mean):
    """Runs of equal lines go by twos and are cut off; elsewhere two neighbours decide."""
    runs = [list(same) for _, same in groupby(text.split("\n"))]
    out, held, before = [], [], 0
    for k, run in enumerate(runs):
        if len(run) > 1:
            while run:
                out.append([run.pop() for _ in range(3 if len(run) == 3 else 2)])
            before = line_hash(out[-1][0])
            continue
        h = line_hash(run[0])
        held += run
        long_next = k + 1 < len(runs) and len(runs[k + 1]) > 1
        if long_next or (31 * h + before) % (2**31 - 1) * 48_271 % (2**31 - 1) % mean == 0:
            out.append(held)
            held = []
        before = h
    return out + [held] * bool(held)


def plain_dedup(ids, texts, mean=4):
    """``(kept, lines, lines removed)`` of every row, going through the rows in order of their ids."""
    seen, result = set(), {}
    for k in sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0)):
        if (ids[k], texts[k]) in result:
            continue
        kept, gone = [], 0
        for chunk in plain_chunks(texts[k], mean) if texts[k] is not None else []:
            body = "\n".join(chunk)
            if len(chunk) > 1 and body.strip() and body in seen:
                gone += len(chunk)
            else:
                kept.append(body)
            seen.add(body)
        n = len(texts[k].split("\n")) if texts[k] is not None else 0
        result[ids[k], texts[k]] = ("\n".join(kept) if texts[k] is not None else None, n, gone)
    return [result[i, t] for i, t in zip(ids, texts)]


def test_line_chunks(spark):
    rng = random.Random(8)
    block = [f"shared line {k}" for k in range(40)]
    texts = [None, "", "\n\n\n\n", "\n\n\n\n", "single", "single", "\n".join(["same"] * 500)]
    for k in range(30):
        start = rng.randrange(30)
        own = [f"own {k} {j}" for j in range(rng.randrange(6))]
        texts.append("\n".join(own + block[start : start + rng.randrange(2, 20)] + own[:2]))
    ids = list(range(len(texts)))
    ids[9] = None
    texts, ids = texts + [texts[10]], ids + [ids[10]]  # a repeated row
    want = [(i, *found) for i, found in zip(ids, plain_dedup(ids, texts))]
    got = line_chunks.remove_repeated_chunks(frame(spark, texts, ids))
    assert got.select("row.*").columns == ["doc_id", "text", "fingerprint", "component_id", "row", "key"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.drop("row").collect()), key=key) == sorted(want, key=key)


def test_runs_of_one_line_go(spark):
    """Whatever surrounds a run, however long it is: two of its lines stay in all the corpus, and a third where runs are odd."""
    rng = random.Random(18)
    texts = []
    for k in range(40):
        around = lambda: [f"own {k} {rng.random()}" for _ in range(rng.randrange(4))]
        texts.append("\n".join([*around(), *["click here to subscribe"] * rng.randrange(2, 90), *around()]))
    kept = [r["kept"] for r in line_chunks.remove_repeated_chunks(frame(spark, texts)).collect()]
    assert sum(t.split("\n").count("click here to subscribe") for t in kept) <= 5
    own = [line for t in texts for line in t.split("\n") if line.startswith("own")]
    assert sorted(line for t in kept for line in t.split("\n") if line.startswith("own")) == sorted(own)


def test_shared_blocks_go_but_for_their_ends(spark):
    """A block of different lines inside other text: only lines next to its ends may stay a second time."""
    rng = random.Random(19)
    block = [f"shared {rng.random()}" for _ in range(60)]
    texts = ["\n".join([f"own {k} {rng.random()}" for _ in range(5)] + block + [f"own {k} {rng.random()}" for _ in range(5)]) for k in range(30)]
    kept = [r["kept"].split("\n") for r in line_chunks.remove_repeated_chunks(frame(spark, texts)).collect()]
    assert sum(line.startswith("own") for lines in kept for line in lines) == 300
    again = sorted(sum(line.startswith("shared") for line in lines) for lines in kept)
    assert again[-1] == 60 and again[-2] <= 30 and sum(again[:-1]) / 29 < 20


def test_line_chunks_run_no_python(spark):
    plan = line_chunks.remove_repeated_chunks(frame(spark, ["a\nb", "a\nb"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_boundaries_resist_shifts(spark):
    text = "\n".join(f"line {k}" for k in range(200))
    cut = lambda t: spark.range(1).select(line_chunks.pieces(F.lit(t)).alias("p")).first()["p"]
    before, after = {p["body"] for p in cut(text)}, {p["body"] for p in cut("put in front\n" + text)}
    assert len(before - after) <= 2
