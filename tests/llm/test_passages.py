"""Removal of repeated passages against plain counting of windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from colmeta.llm import passages
from colmeta.llm.fm_index import FMIndex, repeated_intervals


def brute(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute(rows, 35)
    assert _got(passages.without_repeats(odd_docs)) == want
    assert any(0 < w[2] < w[1] for w in want)
    assert passages.without_repeats(no_docs).count() == 0


@pytest.fixture(scope="module")
def shared_passages(spark):
    """Passages about a window long within other words, near copies, copies, and texts that repeat themselves."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]

    def prose(n):
        return list(rng.choice(words, n))

    common = [prose(n) for n in (33, 34, 35, 36, 60, 200)]
    texts = []
    for i in range(240):
        c = common[i % 6]
        texts.append(prose(rng.integers(0, 60)) + c + prose(rng.integers(0, 60)) + (common[rng.integers(6)] if i % 5 == 0 else []))
    near = prose(300)
    for _ in range(60):
        t = list(near)
        for j in rng.integers(0, 300, rng.integers(0, 8)):
            t[j] = f"n{rng.integers(10**9)}"
        texts.append(t)
    texts += [prose(50) for _ in range(50)] + [near] * 20 + [["a"] * 100, ["a", "b"] * 40, prose(40) * 3, ["a"] * 35, ["b"] * 34, ["b"] * 34]
    rows = [(int(i), "\n ".join(texts[j])) for i, j in enumerate(rng.permutation(len(texts)))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize(("shard_words", "anchor_segments"), [(1 << 20, 1 << 13), (500, 1 << 13), (500, 15), (1 << 20, 1)])
def test_shared_passages(shared_passages, shard_words, anchor_segments):
    """Whatever the size of shards and whichever anchors are frequent."""
    rows, docs = shared_passages
    assert _got(passages.without_repeats(docs, shard_words=shard_words, anchor_segments=anchor_segments)) == brute(rows, 35)


def test_other_windows(shared_passages):
    rows, docs = shared_passages
    assert _got(passages.without_repeats(docs, window=10)) == brute(rows, 10)


def test_index_against_counting():
    rng = np.random.default_rng(1)
    for _ in range(150):
        least, symbols = int(rng.integers(1, 6)), int(rng.integers(1, 5))
        segments = [rng.integers(1, symbols + 1, rng.integers(0, 25)) for _ in range(rng.integers(1, 8))]
        at, text = np.r_[0, np.cumsum([len(s) for s in segments])], np.r_[np.zeros(0, np.int64), *segments].astype(np.int64)
        if not len(text):
            continue
        index = FMIndex(text, at)
        got = {(w, s) for w, a, b in zip(*repeated_intervals(index, text, at[:-1], at[1:], least), strict=True) for s in range(a, b - least + 1)}
        count = Counter(tuple(s[i : i + least]) for s in segments for i in range(len(s) - least + 1))
        assert got == {(w, at[w] + i) for w, s in enumerate(segments) for i in range(len(s) - least + 1) if count[tuple(s[i : i + least])] > 1}
