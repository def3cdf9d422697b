"""Near vocabulary terms by an inverted file: terms in lists around centres, queries to a few lists, exact distances there.

The centres are fitted in one task on a bounded sample of terms, and so is the number of lists that a query has to probe:
the least with which the sample's own terms find the wanted share of their true neighbours. Every term is then written to
its nearest centre's list, in blocks; a list of any size is many blocks, in many tasks. Queries go to their nearest lists
by an equi-join and are compared there block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmeta.operators.match import NEAREST, QUERIES, TERMS, _fine, _ranked, block_rows, met, nearest
from colmeta.sources import store

#: Terms that the centres and the number of probes are fitted on, at most; lists, at most; rounds of fitting; share of
#: true neighbours that the probes have to find in the sample.
SAMPLE, LISTS, ROUNDS, RECALL = 20_000, 4096, 12, 0.95
#: Rows whose nearest lists are told at once.
ROWS = 1024


@dataclass
class Index:
    """An inverted file. blocks: list, dim, ids, xs (float64) of packed terms; centres: one row a list."""

    blocks: DataFrame
    terms: DataFrame
    centres: np.ndarray
    probes: int
    k: int
    metric: str


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)


def _order(x: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the nearest centres of each row, the nearest first."""
    d = (centres * centres).sum(axis=1)[None] - 2 * (x @ centres.T)
    if most == 1:
        return d.argmin(axis=1)[:, None]
    near = np.argpartition(d, most - 1, axis=1)[:, :most] if most < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)


def _centres(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from rows drawn by seed. A centre without rows goes to the row farthest from its own."""
    distinct = np.unique(x, axis=0)
    lists = min(lists, len(distinct))
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), lists, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _order(x, centres, 1)[:, 0]
        count = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = np.argsort(-((x - centres[own]) ** 2).sum(axis=1), kind="stable")[: len(empty)]
            centres[empty[: len(far)]] = x[far]
    return centres


def _probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Lists to probe so that this share of the k nearest other rows of each row of x is found."""
    own, place = _order(x, centres, 1)[:, 0], np.empty((len(x), len(centres)), np.int32)
    for i in range(0, len(x), 1024):
        order = _order(x[i : i + 1024], centres, len(centres))
        np.put_along_axis(place[i : i + 1024], order, np.arange(len(centres), dtype=np.int32)[None].repeat(len(order), 0), axis=1)
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    needed = []
    length = (x * x).sum(axis=1)
    for i in range(0, len(x), 1024):
        d = length[None] - 2 * (x[i : i + 1024] @ x.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        needed.append(np.take_along_axis(place[i : i + 1024], own[near], axis=1).ravel())
    return int(np.quantile(np.concatenate(needed), recall, method="inverted_cdf")) + 1


def _fitted(sample: DataFrame, lists: int, k: int, recall: float, metric: str, seed: int) -> tuple[np.ndarray, int]:
    """Centres and probes, from one task over the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [v for b in batches for v in b.column(0).to_pylist()]
        if rows:
            x = np.array(rows, np.float64)
            x = _unit(x) if metric == "cosine" else x
            centres = _centres(x, lists, seed)
            yield pa.RecordBatch.from_arrays([pa.array([centres.tobytes()]), pa.array([centres.shape[1]], pa.int32()), pa.array([_probes(x, centres, k, recall)], pa.int32())], names=["centres", "dim", "probes"])

    found = sample.coalesce(1).mapInArrow(run, "centres binary, dim int, probes int").first()
    if found is None:
        return np.zeros((0, 1)), 1
    return np.frombuffer(found["centres"]).reshape(-1, found["dim"]), found["probes"]


def _assigned(key: str, centres: np.ndarray, probes: int, metric: str):
    """Rows (key, vector) with each of their nearest lists: list, key, x (float64 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                order = _order(_unit(x) if metric == "cosine" else x, centres, min(probes, len(centres)))
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), order.shape[1])
                raw = pa.array([r.tobytes() for r in x], pa.binary()).take(pa.array(np.repeat(np.arange(len(x)), order.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), pa.array(ids, pa.int64()), raw], names=["list", key, "x"])

    return run, f"list int, {key} long, x binary"


def _blocks(dim: int, rows: int, ids: str, xs: str):
    """Packs sorted (list, id, x) rows of a task into blocks of one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([dim], pa.int32()), pa.array([np.array(held[0], np.int64).tobytes()], pa.binary()), pa.array([b"".join(held[1])], pa.binary())], names=["list", "dim", ids, xs])

        for b in batches:
            for one, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held[0] and (one != at or len(held[0]) == rows):
                    yield out()
                    held = ([], [])
                at = one
                held[0].append(i)
                held[1].append(x)
        if held[0]:
            yield out()

    return run, f"list int, dim int, {ids} binary, {xs} binary"


def inverted_file(terms: DataFrame, k: int = NEAREST, metric: str = "l2sq", lists: int | None = None, recall: float = RECALL, sample: int = SAMPLE, seed: int = 7, path: str | None = None) -> Index:
    """Index of terms (id, vector), written to path (a new folder of the shared one, if not given).

    lists: the root of the number of terms, LISTS at most, if not given. sample: terms that the centres and the probes are
    fitted on, at most, chosen by a hash of the id. Every term whose vector can be compared is in a list.
    Vectors of another than the terms' largest number of components take no part.
    """
    if metric not in ("l2sq", "cosine"):
        raise ValueError(f"metric {metric!r} is not l2sq or cosine")
    fine = _fine(terms, "id").select(F.col("id"), "vector")
    n, dim = fine.agg(F.count("*"), F.max(F.size("vector"))).first()
    dim = dim or 1
    whole = fine.where(F.size("vector") == dim)
    some = whole.orderBy(F.xxhash64(F.col("id")), "id").limit(sample).select("vector")
    centres, probes = _fitted(some, lists or max(1, min(LISTS, int(n**0.5))), k, recall, metric, seed)
    assign, row = _assigned("id", centres, 1, metric)
    pack, block = _blocks(dim, block_rows(dim, TERMS), "ids", "xs")
    placed = whole.select(F.col("id").cast("long"), "vector").mapInArrow(assign, row) if len(centres) else terms.sparkSession.createDataFrame([], row)
    ranged = placed.repartitionByRange("list", "id").sortWithinPartitions("list", "id")  # a large list is cut by id
    return Index(store.written(ranged.mapInArrow(pack, block), path), whole, centres, probes, k, metric)


def near_by_lists(queries: DataFrame, index: Index, k: int | None = None, probes: int | None = None, exclude_same_id: bool = False) -> DataFrame:
    """query, id, distance, rank of near terms from the lists that each query probes; a share of neighbours may be missed.

    queries: query, vector, with numbers as ids. A query whose lists hold fewer than k terms is answered exactly. Ids of
    queries and terms are apart, unless exclude_same_id says that they are one space. Distances are exact; ties go to the
    smaller id. Vectors that can't be compared, or not with the index's terms, take no part.
    """
    k, dim = k or index.k, index.centres.shape[1]
    whole = _fine(queries, "query").where(F.size("vector") == dim).select(F.col("query").cast("long"), "vector")
    empty = "query long, id long, distance double, rank int"
    if not len(index.centres):
        return queries.sparkSession.createDataFrame([], empty)
    assign, row = _assigned("query", index.centres, probes or index.probes, index.metric)
    pack, block = _blocks(dim, block_rows(dim, QUERIES), "q_ids", "q_xs")
    asked = whole.mapInArrow(assign, row).repartitionByRange("list", "query").sortWithinPartitions("list", "query").mapInArrow(pack, block)
    pairs = asked.drop("dim").join(index.blocks, "list").select("q_ids", "q_xs", "dim", "ids", "xs")
    near = store.written(_ranked(met(pairs, k, index.metric, exclude_same_id), k))
    served = near.where(F.col("rank") == k).select("query")
    rest = whole.join(served, "query", "left_anti")
    return near.join(served, "query", "left_semi").unionByName(nearest(rest, index.terms, k, index.metric, exclude_same_id=exclude_same_id))
