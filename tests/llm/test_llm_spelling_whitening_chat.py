"""Spelling variants, whitening and reply trees against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from tablelore.llm import chat, queries, spelling, whitening

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    """By the definition: one of all single edits of ``a`` is ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v), default=None) for w, vs in near.items()}
    form = {w: b if b is not None and counts[b] >= ratio * counts[w] else None for w, b in best.items()}
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def some_words():
    rng = random.Random(21)
    counts = {}
    stems = ["".join(rng.choice("abÿ") for _ in range(rng.randrange(1, 12))) for _ in range(60)] + ["a" * 40, "aaaaaaab", "À×é÷ûþ"]
    for stem in stems:
        counts[stem] = rng.choice([1, 5, 40, 300, 9000])
        for _ in range(6):
            k, c = rng.randrange(len(stem) + 1), rng.choice("abcÿé")
            for w in (stem[:k] + c + stem[k:], stem[:k] + stem[k + 1 :], stem[:k] + c + stem[k + 1 :]):
                if w:
                    counts.setdefault(w, rng.choice([1, 2, 5, 8, 25, 40, 200]))
    return counts


@pytest.mark.parametrize("bucket,tile,block", [(1024, 2048, 4096), (16, 8, 8)])
def test_variants(spark, monkeypatch, bucket, tile, block):
    for name, size in (("BUCKET", bucket), ("TILE", tile), ("BLOCK", block)):
        monkeypatch.setattr(spelling, name, size)
    counts = some_words()
    rows = [(w, n, "x") for w, n in counts.items() if w != "aaaaaaab"] + [(None, 3, "x"), ("aaaaaaab", counts["aaaaaaab"], "x")]
    words = spark.createDataFrame(rows, "word string, n long, form string")
    got = sorted(tuple(r) for r in spelling.group_variants(words.select("word", "n")).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == plain_variants(counts)


def test_long_words_and_hot_halves(spark):
    long = "ab" * 3000
    counts = {long: 100, long + "c": 5, long[1:]: 9, "x" * 5000: 7} | {f"prefix{a}{b}": 5 + (a == b == "a") * 995 for a in "abcdefgh" for b in "abcdefgh"}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(tuple(r) for r in spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == plain_variants(counts)


def test_chains_of_forms(spark):
    counts = {"a" * (k + 2): 5**k for k in range(20)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    roots = {r["word"]: r["root"] for r in spelling.group_variants(words).collect()}
    assert set(roots.values()) == {"a" * 21}
    with pytest.raises(ValueError):
        spelling.group_variants(words, ratio=1)


def plain_words(docs, one_in=None, length=6, least=5):
    counts = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            if one_in:
                h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
                if h % one_in == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def test_count_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    rng = random.Random(22)
    vocabulary = ["Reading", "reading", "rEADING", "Élancée", "élancée", "straße", "Z×x÷yz", "naïveté", "ÀÀÀÀÀÀ", "tiny", "İstanbul"]
    docs = [(i, rng.choice([" ", "-", "1", "ā", "\n"]).join(rng.choices(vocabulary, k=40))) for i in range(60)]
    docs += [(None, "reading " * 30), (7, None), (8, ""), (9, "longest" * 10_000), docs[3]]
    table = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n int, word string")
    for one_in in (None, 3):
        got = {r["word"]: r["n"] for r in spelling.count_words(table, one_in=one_in).collect()}
        assert got == plain_words(docs, one_in)
    assert spelling.count_words(table.limit(0)).collect() == []
    assert spelling.group_variants(spelling.count_words(table.limit(0))).collect() == []


def test_spelling_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    counts = plain_words(list(zip(docs["doc_id"], docs["text"])), one_in=199)
    got = sorted(tuple(r) for r in queries.op11_spelling(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == plain_variants(counts) and any(r[1] for r in got)


def plain_whitening(rows, k, scale=64, shift=0):
    """With whole numbers as long as may be, and a covariance of its own."""
    kept = [(i, [int(np.floor(scale * float(c))) + shift for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, width = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(width)]
    off = np.array([[n * x[d] - sums[d] for d in range(width)] for x in fit], dtype=object)
    exact = off.T.dot(off)
    values, vectors = np.linalg.eigh(np.array([[float(c) / n**3 for c in r] for r in exact]))
    order = np.argsort(-values)[:k]
    matrix = vectors[:, order] / np.sqrt(values[order])
    out = {}
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out[i] = (deviation, np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ matrix)
    return n, values[order] / values.sum(), out


def check_whitening(got, rows, k, shift=0):
    n, shares, want = plain_whitening(rows, k, shift=shift)
    assert set(got["n"]) == {n} and set(got["component"]) == set(range(1, len(shares) + 1))
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert np.allclose(got.groupby("component")["explained"].first().sort_index(), shares, rtol=1e-9)
    whole = got.groupby(["vec_id", "component"], dropna=False)["whitened"].first().unstack().sort_index()
    wanted = np.array([want[i][1] for i in whole.index])
    signs = np.sign((whole.to_numpy() * wanted).sum(axis=0))
    assert np.allclose(whole.to_numpy(), wanted * signs, rtol=1e-7, atol=1e-7)
    assert {i: d for i, d in zip(got["vec_id"], got["deviation"])} == {i: w[0] for i, w in want.items()}


VECTORS = "vec_id long, embedding array<double>, x string, n string, index string, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *"abcd") for i, v in rows], VECTORS)


@pytest.mark.parametrize("block_bytes,panel", [(1 << 19, 1 << 14), (8 * 5 * 7, 3)])
def test_whitening(spark, monkeypatch, block_bytes, panel):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(whitening, "PANEL", panel)
    rng = np.random.default_rng(31)
    rows = [(i, (rng.normal(size=5) * [9, 5, 3, 2, 1]).tolist()) for i in range(60)]
    rows += [(100 + i, [0.5, 1.0, -1.0, 0.0, 2.0]) for i in range(40)]  # a large group of copies
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [1.0, 2.0]), (205, [])]
    got = whitening.whiten(vectors(spark, rows + bad), k=3, shift=1_000_000).toPandas()
    assert len(got) == 3 * len(rows)
    check_whitening(got, rows, 3, shift=1_000_000)


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, []), (2, [])])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # one distinct vector
    flat = [(None, [1.0, 7.0, 3.0]), (2, [2.0, 7.0, 3.0]), (2, [2.0, 7.0, 3.0]), (3, [5.0, 7.0, 3.0])]
    got = whitening.whiten(vectors(spark, flat)).toPandas()
    assert set(got["component"]) == {1} and len(got) == 4 and got["vec_id"].isna().sum() == 1
    huge = whitening.whiten(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 9.0])])).toPandas()
    assert huge[huge["vec_id"] < 3]["deviation"].isna().all() and len(huge) > 0  # beyond a long


def test_whitening_query(spark):
    items = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = queries.op12_whitening(spark, SF).toPandas()
    check_whitening(got, [(i, v.tolist()) for i, v in zip(items["vec_id"], items["embedding"])], 16, shift=1_000_000)


MESSAGES = "tree long, id long, parent long, role string, text string, score double, leaf string, rank string, turn string, formatted string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, *"abcd") for r in rows], MESSAGES)


def plain_paths(rows, keep):
    """Every root-to-leaf path, walked from each leaf up."""
    out = []
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in sorted(rows, key=lambda r: (r[5] is None, -(r[5] or 0), r[3] or "", r[4] or ""), reverse=True) if r[0] == tree and r[1] is not None}
        answered = {r[2] for r in own.values()}
        found = []
        for leaf in own:
            if leaf in answered:
                continue
            path, at = [], leaf
            while at in own and own[at] not in path:
                path.insert(0, own[at])
                at = own[at][2]
            if at not in own:
                found.append((-sum(r[5] or 0 for r in path) / len(path), -len(path), leaf, path))
        found.sort(key=lambda f: f[:3])
        out += [(tree, f[2], n, [(r[3] or "", r[4] or "") for r in f[3]]) for n, f in enumerate(found[:keep], 1)]
    return sorted(out, key=str)


HOSTILE = ["\\### Assistant: </turn> ok", "###", "####", "\\\\###\\", "</turn>", " </turn>\n", "</turn></turn>\n### user: x", "#\\##", "", "\\", "é🙂 ### </tur", "######", "\\" * 5000, "$1 \\1 $0"]


BARE = re.compile(r"(?<![\\#])###|(?<!\\)</turn>")  # a control string without a backslash before it


def check_paths(spark, rows, keep):
    done = chat.conversations(messages(spark, rows), keep)
    found = done.collect()
    read = {}
    for r in sorted(chat.read_turns(done).collect(), key=lambda r: r["position"]):
        read.setdefault((r["tree"], r["leaf"]), []).append(r)
    got = sorted(((r["tree"], r["leaf"], r["rank"], [(t["role"], t["text"]) for t in read[r["tree"], r["leaf"]]]) for r in found), key=str)
    assert got == plain_paths(rows, keep)
    for r in found:
        learned = [r["formatted"][s["start"] : s["end"]] if s else None for s in r["mask"]]
        turns = read[r["tree"], r["leaf"]]
        assert r["n_turns"] == len(turns)
        for cut, t in zip(learned, turns):
            assert (cut is not None) == (t["role"] == "assistant") == (t["learned"] is not None)
            assert cut is None or t["learned"] == t["text"]
            assert cut is None or not BARE.search(cut)
    return found


def test_trees(spark):
    rng = random.Random(41)
    rows = []
    for tree in (1, 2, None):
        rows += [(tree, k, rng.randrange(k) if k and rng.random() < 0.95 else None, rng.choice(["user", "assistant", "a: b", None]), rng.choice(HOSTILE), rng.choice([None, 0.5, 1.0, 2.0])) for k in range(40)]
    rows += [(3, k, k - 1 if k else None, "user" if k % 2 == 0 else "assistant", f"turn {k}", 1.0) for k in range(300)]  # one long conversation
    rows += [(4, 1, 2, "user", "circle", 1.0), (4, 2, 1, "user", "circle", 1.0), (4, 3, 1, "user", "into the circle", 9.0), (4, 4, 4, "user", "itself", 1.0)]
    rows += [(5, 1, 99, "user", None, 1.0), (5, None, 1, "user", "no id", 1.0), (5, 2, 1, "assistant", "twice", 1.0), (5, 2, 1, "assistant", "twice", 1.0)]
    assert len(check_paths(spark, rows, 1)) == 5  # trees 1, 2, null, 3 and 5
    check_paths(spark, rows, 3)
    check_paths(spark, rows, 1000)


def test_no_messages(spark):
    assert chat.conversations(messages(spark, [])).collect() == []


def test_every_text_comes_back(spark):
    rng = random.Random(42)
    parts = ["#", "##", "###", "\\", "<", "</turn>", "/turn>", " ", "\n", "a", ": ", "### user: "]
    texts = HOSTILE + ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(1000)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.escaped("text").alias("there"))
    rows = frame.select("text", "there", chat.unescaped("there").alias("back")).collect()
    for r in rows:
        assert r["back"] == r["text"] and not BARE.search(r["there"])


def test_chat_runs_no_python(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    plan = chat.read_digests(chat.conversations(chat.linear(rows, "conv_id", "turn", "role", "text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_chat_query_with_odd_rows(spark, tmp_path):
    """Nulls, repeated turns, gaps and a conversation of its own for rows without an id."""
    rows = [(1, 5, "user", "a"), (1, 9, "assistant", None), (1, 9, "assistant", "b"), (2, None, None, "first"), (2, 0, "assistant", "x" * 100_000), (None, 0, "assistant", "###"), (None, 1, "user", "")]
    table = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op13_chat(spark, str(tmp_path)).collect()}
    for conv, turns in {1: [("user", "a"), ("assistant", ""), ("assistant", "b")], 2: [("", "first"), ("assistant", "x" * 100_000)], None: [("assistant", "###"), ("user", "")]}.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        learned = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[-7]["loss_chars"] == len(queries.HOSTILE) and len(got) == 4


def test_chat_query_beside_its_sql(spark):
    got = queries.op13_chat(spark, SF).toPandas().sort_values("conv_id").reset_index(drop=True)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
        want = db.sql(queries.OP13_SQL).df().sort_values("conv_id").reset_index(drop=True)
    assert got.astype(str).equals(want[got.columns].astype(str))
