"""Periodic runs against every period tried at every place."""

import hashlib
import zlib

import numpy as np

from colmeta.llm import periodic_runs
from colmeta.llm.periodic_runs import found_runs


def _runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - start
            if n >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(start, start + n - p)) for p in range(1, q)):
                out.append((start, n, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = _runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(spark, odd_docs, no_docs):
    want = sorted((brute(r.doc_id, r.text) for r in odd_docs.collect()), key=str)
    got = periodic_runs.periodic_runs(odd_docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert _got(got) == want
    assert periodic_runs.periodic_runs(no_docs).count() == 0


def test_repeats_of_every_kind(spark):
    """Words over and over, periods in periods, runs that touch and overlap, the trial's own periods."""
    rng = np.random.default_rng(2)
    texts = ["a " * 5, "a " * 6, "a b " * 3, "a b " * 4, "x " + "a b " * 4 + "a y", "a a b " * 6, ("a a a a a a b " * 4 + "c ") * 4, "a b c " * 4 + "b c " * 4, "é e " * 9]
    for _ in range(300):
        x = rng.integers(0, rng.integers(1, 6), rng.integers(1, 90))
        if rng.random() < 0.5:
            a = rng.integers(len(x))
            x[a:] = x[a + np.arange(len(x) - a) % min(rng.integers(1, 9), len(x) - a)]
        texts.append(" ".join(f"w{i}" for i in x))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = [brute(i, t) for i, t in enumerate(texts)]
    assert _got(periodic_runs.periodic_runs(docs)) == sorted(want, key=str)
    assert sum(w[1] > 1 for w in want) > 10


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    short = {r.doc_id for r in rows if len((r.text or "").split()) < 700}
    got = [r for r in _got(periodic_runs.periodic_runs(docs)) if r[0] in short]
    assert got == sorted((brute(r.doc_id, r.text) for r in rows if r.doc_id in short), key=str)


def test_long_texts_in_linear_memory_of_blocks():
    """Sets of many positions: one word, one period and a Fibonacci word, which has no fourth power."""
    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a
    texts = [np.zeros(60_000), np.arange(60_000) % 700, np.array(b[:60_000])]
    words = np.concatenate(texts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5)
    assert found_runs(words, np.arange(4) * 60_000) == [[(0, 60_000, 1)], [(0, 60_000, 700)], []]
