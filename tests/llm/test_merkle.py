"""The Merkle manifest against trees built by plain lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from colmeta.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, low=False):
    values = [row[f] for f in FIELDS]
    if low and values[-1] is not None:
        values[-1] = values[-1].encode().lower().decode()
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def _way(levels, i):
    for level in levels[:-1]:
        first = i // 16 * 16
        yield level[first:i], level[i + 1 : first + 16]
        i //= 16


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
    trees = {s: _levels([_leaf(r) for r in by[s]]) for s in names}
    top = _levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps = [*_way(trees[s], i), *_way(top, k)]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            now = _leaf(r, tampered)
            for a, b in steps:
                now = _h(*a, now, *b)
            root = top[-1][0]
            out.append((r["doc_id"], _leaf(r), trees[s][-1][0], root, _h(*(x for a, b in steps for x in a + b)), now, now == root))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=str)


def test_odd_rows(spark, odd_docs, no_docs):
    want = brute([r.asDict() for r in odd_docs.select(*FIELDS).collect()])
    assert _got(merkle.manifest(odd_docs)) == want
    assert merkle.manifest(no_docs).count() == 0


@pytest.mark.parametrize("height", [1, 3])
def test_many_tiers(spark, height):
    """A source with most rows, sources of every small size, several tiers of builders."""
    rows = [(i, f"Text {i}", f"s{i % 40}" if i % 3 else "hot", "en", i) for i in range(1500)]
    rows += [(10_000 + i, "Same", f"k{n}", None, None) for n in range(1, 20) for i in range(n)] + [(i, None, None, None, 1) for i in range(17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").orderBy(F.rand(5))
    want = brute([r.asDict() for r in docs.collect()])
    assert _got(merkle.manifest(docs.repartition(5), block=height)) == want
    assert {w[-1] for w in want} == {True, False}


def test_one_row(spark):
    docs = spark.createDataFrame([(5, "A", "s", "en", 1)], "doc_id long, text string, source string, lang string, n_chars long")
    assert _got(merkle.manifest(docs)) == brute([docs.first().asDict()])


@pytest.mark.parametrize("leaves", [1, 2, 15, 16, 17, 255, 256, 257, 272, 4096, 4097, 5000])
def test_places_are_those_of_a_postorder_walk(leaves):
    depth, n = 0, leaves
    while n > 1:
        n, depth = -(-n // 16), depth + 1
    walk = []

    def visit(level, number):
        if level:
            for c in range(number * 16, min(number * 16 + 16, -(-leaves // 16 ** (level - 1)))):
                visit(level - 1, c)
        walk.append((level, number))

    visit(depth, 0)
    assert [merkle.place(level, number, leaves) for level, number in walk] == list(range(len(walk)))
