"""Periodic runs of words by Kruskal's order over descending longest common prefixes.

A text's suffixes are sorted by prefix doubling. Neighbours in that order are edges with their common prefix's length as
weight. Edges are taken from the longest down: union-find unites the classes of their suffixes, and each class holds its
positions in order. When two classes unite, the smaller one's positions are put into the larger one's. Two positions that
thereby become neighbours, at a distance q of at most a third of the common prefix l, have period q over l + q words: they
seed a run if the words before them differ, so each run is seeded once, by its first word.

That finds every run: if a run with smallest period q starts at s, then s and s + q share a prefix of 3q words at least. A
position of their class between them would give the run a second period below q, and, as the run is longer than both
together, a smaller period than its smallest.

No row meets another, so there is no shuffle. Most texts have no word five-gram twice near by and are done after one sort.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of
from .suffixes import suffix_order
from .words import chunks, exact_hashes, grams, kept_sha256, mixed, raw_texts, word_spans

#: A run has LEAST words at least, and TIMES times its period.
LEAST, TIMES = 6, 4
#: Words of the shortest prefix that two positions of a run share: a run of LEAST words with period 1 shares one less.
_GRAM = LEAST - 1
#: Positions in one block of an ordered set.
_BLOCK = 512


class _Ordered:
    """An ordered set of positions in blocks, so that no insertion moves more than a block."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, x: int) -> None:
        self.blocks, self.firsts, self.size = [[x]], [x], 1

    def around(self, x: int) -> tuple[int, int]:
        """The neighbours below and above x, or -1."""
        k = max(bisect_left(self.firsts, x + 1) - 1, 0)
        b = self.blocks[k]
        i = bisect_left(b, x)
        low = b[i - 1] if i else self.blocks[k - 1][-1] if k else -1
        if i < len(b) and b[i] == x:
            i += 1
        high = b[i] if i < len(b) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        return low, high

    def add(self, x: int) -> tuple[int, int]:
        found = self.around(x)
        k = max(bisect_left(self.firsts, x) - 1, 0)
        b = self.blocks[k]
        insort(b, x)
        self.firsts[k] = b[0]
        self.size += 1
        if len(b) > _BLOCK:
            half = len(b) // 2
            self.blocks[k : k + 1] = [b[:half], b[half:]]
            self.firsts[k : k + 1] = [b[0], b[half]]
        return found

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b


def _kruskal(where: list[int], edges: list[tuple[int, int, int]], words: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period). where: positions; edges: (common prefix, node, node), the longest prefix first."""
    root = list(range(len(where)))
    sets = [_Ordered(p) for p in where]
    node = {p: i for i, p in enumerate(where)}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found, near, level = [], [], 0

    def settle() -> None:
        """What is still adjacent when all edges of a level are taken."""
        for u, v in near:
            if sets[find(node[u])].around(u)[1] == v:
                found.append((u, level + v - u, v - u))
        near.clear()

    for common, a, b in edges:
        if common != level:
            settle()
            level = common
        a, b = find(a), find(b)
        if sets[a].size < sets[b].size:
            a, b = b, a
        root[b] = a
        large, last, reach = sets[a], -1, (TIMES - 1)
        for x in sets[b]:
            low, high = large.add(x)
            if low >= 0 and low != last and reach * (x - low) <= common and (low == 0 or words[low - 1] != words[x - 1]):
                near.append((low, x))
            if high >= 0 and reach * (high - x) <= common and (x == 0 or words[x - 1] != words[high - 1]):
                near.append((x, high))
            last = x
        sets[b] = None
    settle()
    return found


def _common(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words that the suffixes at x and y (different positions) share."""
    n = len(levels[0])
    out = np.zeros(len(x), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        a, b = x + out, y + out
        same = (a < n) & (b < n)
        same[same] = levels[j][a[same]] == levels[j][b[same]]
        out += same.astype(np.int64) << j
    return out


def _found(words: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of an array of words: start, length, smallest period, by start and period."""
    if len(words) < LEAST:
        return []
    order, levels = suffix_order(words)
    lcp = _common(levels, order[:-1], order[1:])
    del levels
    most = np.maximum(np.r_[lcp, 0], np.r_[0, lcp])
    group = np.cumsum(np.r_[True, lcp < _GRAM])
    # by class of equal grams and position: only positions that recur within a third of their longest prefix can seed
    by = np.lexsort((order, group))
    at, kind = order[by], group[by]
    gap = np.where(kind[1:] == kind[:-1], at[1:] - at[:-1], len(words)) * (TIMES - 1)
    some = np.zeros(len(words), bool)
    some[by[:-1][gap <= most[by[:-1]]]] = True
    some[by[1:][gap <= most[by[1:]]]] = True
    picked = np.flatnonzero(some)
    if len(picked) < 2:
        return []
    least = np.minimum.reduceat(np.r_[lcp, 0], picked)[:-1]
    edge = np.flatnonzero(least >= _GRAM)
    edge = edge[np.argsort(-least[edge], kind="stable")]
    return sorted(_kruskal(order[picked].tolist(), list(zip(least[edge].tolist(), edge.tolist(), (edge + 1).tolist(), strict=True)), words), key=lambda r: (r[0], r[2]))


def found_runs(words: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs of several texts. words: their hashes one after another; at: where each starts, and the end."""
    texts = np.repeat(np.arange(len(at) - 1), np.diff(at))
    own = mixed(words ^ mixed((texts.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))  # no word is in two texts
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
    g = grams(own, _GRAM)
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    u, v = order[:-1][same], order[1:][same]
    maybe = (texts[u] == texts[np.minimum(v + _GRAM - 1, len(own) - 1)]) & ((TIMES - 1) * (v - u) <= at[texts[u] + 1] - v)
    docs = np.unique(texts[u[maybe]])
    if not len(docs):
        return out
    inside = np.flatnonzero(np.isin(texts, docs))
    starts = {int(d): int(i) for d, i in zip(docs, np.searchsorted(inside, at[docs]), strict=True)}
    for start, length, period in _found(own[inside]):
        d = int(texts[inside[start]])
        out[d].append((start - starts[d], length, period))
    return out


def _repeated(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word each word becomes, for a text of the trial's tenth; else null."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return out


_OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _collapsed(text: bytes, n: int, moved: np.ndarray | None, runs: list[tuple[int, int, int]]) -> str:
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    if moved is None:
        return kept_sha256(text, keep if runs else None)
    first, last = word_spans(text)
    out, some = hashlib.sha256(), moved[keep]
    for k in range(0, len(some), 100_000):
        part = some[k : k + 100_000]
        out.update((b" " if k else b"") + b" ".join([text[a:b] for a, b in zip(first[part].tolist(), last[part].tolist(), strict=True)]))
    return out.hexdigest()


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", trial: bool = True) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 for every row of docs.

    A run is a longest stretch of words with a smallest period q, of 6 and 4q words at least. start, length, period and
    exponent_milli (1000 times length / period) are of the longest run, the first of equal ones; without runs they are
    null. runs_sha256 is of every run as `start,length,period` and a line feed; collapsed_sha256 of the words that are left
    when each run keeps its first period, joined by one space. trial: in texts whose key's crc32 is divisible by 10, words
    from some place on are first made periodic, as the contract of the query says; a null key's text is left as it is.

    A null, empty or wordless text has no run and gives the digests of nothing. Repeated rows and keys are rows of their
    own, ties among runs are as said, other columns are not read, no rows give none. A text takes memory of its size and,
    where it has something periodic, some hundred bytes a word.
    """
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), raw_texts(batch.column(1))
            for a, b in chunks(texts):
                rows = []
                hashes, moves = [], []
                for i in range(a, b):
                    words = exact_hashes(texts[i])
                    moved = _repeated(ids[i], len(words)) if trial else None
                    moves.append((len(words), moved))
                    hashes.append(words if moved is None else words[moved])
                at = np.r_[0, np.cumsum([len(h) for h in hashes])]
                for i, (n, moved), runs in zip(range(a, b), moves, found_runs(np.concatenate(hashes), at), strict=True):
                    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    listed = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
                    rows.append((len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), listed, _collapsed(texts[i], n, moved, runs)))
                columns = [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["doc_id", *(c.split()[0] for c in _OUT.split(", "))])

    return docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).mapInArrow(scan, f"doc_id {kind}, {_OUT}")
