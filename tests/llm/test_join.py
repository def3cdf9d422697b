"""The n-gram join against brute force."""

from collections import Counter, defaultdict

import numpy as np

from colmeta.llm import ngram_join
from colmeta.llm.components import components


def _shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def _brute(rows):
    """Class of each row of (doc_id, text), by all pairs that share a shingle."""
    sets = [_shingles(t) for _, t in rows]
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in held[x] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), k if not s else least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def _got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert _got(ngram_join.near_duplicates(odd_docs)) == _brute(rows)
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_large_groups(spark):
    """Groups of near copies about the threshold, passages that many texts share, copies by the hundred."""
    rng = np.random.default_rng(1)
    words = [f"v{i}" for i in range(3000)]
    bases = [list(rng.choice(words, n)) for n in (30, 80, 150, 150, 400)]
    passage = list(rng.choice(words, 60))
    texts = []
    for b in bases:
        for _ in range(70):
            t = list(b)
            for i in rng.choice(len(t), rng.integers(0, max(2, len(t) // 18)), replace=False):
                t[i] = f"n{rng.integers(10**9)}"
            texts.append(" ".join(t))
        texts += [" ".join(b)] * 40
    texts += [" ".join([*rng.choice(words, rng.integers(20, 200)), *passage]) for _ in range(120)]
    texts += [" ".join(passage[i:]) for i in range(12)]
    rows = [(int(i), texts[j]) for i, j in enumerate(rng.permutation(len(texts)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _got(ngram_join.near_duplicates(df)) == _brute(rows)


def test_levels_follow_the_cost():
    flat = np.ones(100)
    steep = np.r_[np.ones(24), np.full(76, 1e6)]
    assert ngram_join._level(flat, 100, 20) == 8
    assert ngram_join._level(steep, 100, 20) < 8
    assert ngram_join._level(np.ones(1), 1, 0) == 1


def test_one_per_class_of_odd_rows(spark, odd_docs, no_docs):
    kept = ngram_join.one_per_class(odd_docs)
    assert kept.columns == odd_docs.columns
    classes = {r.component_id for r in ngram_join.near_duplicates(odd_docs).where("n_shingles > 0").collect()}
    rows = kept.collect()
    worded = [r for r in rows if r.text and r.text.strip()]
    assert sorted(r.doc_id for r in worded) == sorted([*classes, 3])  # two unrelated texts bear the key 3
    assert all(any(r.text == t for r in rows) for t in (None, "", " \n\t "))
    assert ngram_join.one_per_class(no_docs).count() == 0


def test_one_per_class(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, 1), (1, b, 2), (2, a + " end", 3), (3, b, 4), (None, c, 5), (None, c + " end", 6), (4, "", 7), (None, "", 8), (None, None, 9), (5, c, 10), (5, c, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kept = ngram_join.one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r.n_chars for r in kept.collect()) == [1, 2, 7, 8, 9, 10]
    nameless = ngram_join.one_per_class(docs.where("n_chars in (5, 6)")).collect()
    assert len(nameless) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (160, 159)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(1, 41)} == {0}
    assert {got[i] for i in range(101, 161)} == {100}
    assert got[201] == 200
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
