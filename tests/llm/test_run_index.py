"""Suffix dedup against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from matchlight.llm import run_index


def brute(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, n_bytes int, __z string").repartition(4)


def corpus(seed, alphabet="abcdefgh \né"):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    pool = [prose(rng.choice((60, 99, 100, 101, 150, 400))) for _ in range(12)]
    texts = {}
    for i in range(90):
        parts = [prose(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(pool)
            a = rng.randint(0, len(x) // 3)
            parts += [x[a : len(x) - rng.randint(0, len(x) // 3)] if rng.random() < 0.6 else x, prose(rng.randint(0, 30))]
        texts[i * 3 - 20] = "".join(parts)
    base = prose(700)
    for j in range(12):
        w = list(base)
        for _ in range(j % 4):
            w[rng.randrange(len(w))] = "Z"
        texts[1000 + j] = "".join(w)
    texts |= {2000: None, 2001: "", 2002: "a" * 99, 2003: "a" * 900, 2004: "ab" * 300 + "a" * 150, 2005: "x" * 100, 2006: base[50:149], 2007: base[50:150], 2008: "\0" * 250}
    return texts


@pytest.mark.parametrize("seed, alphabet", [(1, "abcdefgh \né"), (2, "ab"), (3, "abcdefghijklmnopqrstuvwxyz東")])
def test_removal_equals_brute_force(spark, seed, alphabet):
    texts = corpus(seed, alphabet)
    assert got(run_index.report(table(spark, texts))) == brute(texts)


def test_repeated_rows_and_empty_table(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    docs = table(spark, {1: t, 2: t[:150]})
    want = brute({1: t, 2: t[:150]})
    assert got(run_index.report(docs.union(docs))) == want
    assert run_index.report(docs.limit(0)).count() == 0
    kept = {r["doc_id"]: bytes(r["kept"]) for r in run_index.dedup(docs).collect()}
    assert kept == {1: t.encode(), 2: b""}


def test_index_lengths_equal_direct_comparison():
    rng = random.Random(5)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))).encode() for _ in range(40)] + [b"aaaa", b"aaaa", b"aa"]
    index = run_index.RunIndex(strings)
    suffixes = [(tuple(index.text[i : index.first[o] + len(strings[o])].tolist()), o) for i, o in enumerate(index.owner)]
    order = sorted(range(len(suffixes)), key=lambda i: (suffixes[i][0] + (0,), suffixes[i][1]))
    assert order == index.suffixes.tolist()
    shared = index.matching()
    for a, b in zip(order, order[1:]):
        x, y = suffixes[a][0], suffixes[b][0]
        n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert shared[b] == n
    assert len(index.heads) <= len(index.text)


def test_a_long_text_of_one_character(spark, monkeypatch):
    texts = {1: "a" * 30_000, 2: "b" * 99 + "a" * 150, 3: "ab" * 9_000}
    assert got(run_index.report(table(spark, texts))) == brute(texts)


def test_slices_of_long_texts(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000, dtype=np.uint8).tobytes()
    whole = run_index.anchors(data)
    monkeypatch.setattr(run_index, "_SLICE", 300)
    parts = run_index.anchors(data)
    every = lambda x: [(int(g), s) for g, a, b, _ in zip(*x) for s in range(a, b + 1)]
    assert every(whole) == every(parts) and len(every(whole)) == 4901


@pytest.mark.parametrize("limit", [0, 300, 5_000, 1 << 21])
def test_a_gram_with_many_contexts_is_indexed_in_parts(monkeypatch, limit):
    """One gram in the middle of contexts that share windows at unlike offsets; and the mark of each equals that of all windows."""
    rng = random.Random(limit)
    gram = "".join(rng.choice("abcd") for _ in range(run_index.GRAM))
    sides = ["".join(rng.choice("abcd") for _ in range(90)) for _ in range(4)]
    rows = []
    for i in range(400):
        left, right = rng.choice(sides), rng.choice(sides)
        if rng.random() < 0.5:
            left = left[: rng.randint(0, 80)] + "x" + left[-rng.randint(20, 90) :]
        low = rng.randint(0, 68)
        lead = min(len(left), rng.randint(low, 68))
        text = (left[len(left) - lead :] + gram + right)[: rng.randint(run_index.LENGTH, run_index.LENGTH + lead)]
        if len(text) >= run_index.LENGTH:
            rows.append((i % 90, 1000 * i, lead, text.encode()))
    monkeypatch.setattr(run_index, "INDEX_SYMBOLS", limit)
    g = np.full(len(rows), 7, np.uint64)
    o, s, lead = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    marks = np.concatenate(run_index.mark_contexts(g, o, s, lead, [r[3] for r in rows]))
    got = {(d, p) for d, a, z in marks.tolist() for p in range(a, z)}
    seen, want = set(), set()
    for d, at, _, text in sorted(rows):
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                want |= {(d, at + q) for q in range(p, p + 100)}
            seen.add(text[p : p + 100])
    assert got == want and want


def test_a_hot_gram_stays_in_bounds():
    """200,000 distinct contexts of one gram."""
    import time

    n = 200_000
    noise = np.random.default_rng(3).integers(97, 123, (n, 136), dtype=np.uint8)
    noise[:, 40 : 40 + run_index.GRAM] = 120
    began = time.time()
    marks = run_index.mark_contexts(np.full(n, 9, np.uint64), np.arange(n), np.zeros(n, np.int64), np.full(n, 40), [r.tobytes() for r in noise])
    assert sum(map(len, marks)) == 0 and time.time() - began < 120


def test_buckets_are_even():
    data = np.random.default_rng(1).integers(97, 123, 3_000_000, dtype=np.uint8).tobytes()
    g = run_index.anchors(data)[0]
    n = np.bincount(run_index.bucket_of(g, 5_000), minlength=5_000)
    assert n.max() < 3 * n.mean()
