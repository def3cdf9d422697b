"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums and Cauchy-Schwarz bounds.

Candidates are ranged by descending length and packed into blocks; queries are packed into blocks as well. The longest
candidates give each query a first k-th best score. A pair of blocks is met only if the lengths allow that score, and
inside, candidates go by in slabs of descending length: after the leading coordinates of the rotated vectors, what is
left of a score is at most the product of the two remaining lengths. Pairs that survive get their exact product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Rows of a candidate block, of a slab in it, of a query block; candidate blocks that give the first scores; bytes that a
#: block may have: blocks of long vectors have fewer rows, so what goes to the tasks as a whole is bounded.
BLOCK, SLAB, QUERIES, HEAD, BLOCK_BYTES = 1024, 256, 512, 4, 1 << 22
#: Most components of vectors that are rotated; longer ones are met as they are, by the same bounds.
ROTATED = 1024
SCALE = 256.0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """floor(256 x) of a list column as a matrix; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(column) and (sizes == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _gram(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column(1), dim)
            total += x.T @ x
        i, j = np.indices((dim, dim)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    return run


def _with_length(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.sqrt((x * x).sum(axis=1))), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "length", "x"])

    return run


def _blocks(rows: int):
    """Packs rows (vec_id, length, x) in their order: block (its number), stripe (the task), top (the largest length), ids, xs, lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe = TaskContext.get().partitionId()
        ids, xs, lengths, made = [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(stripe << 32) + made]), pa.array([stripe], pa.int32()), pa.array([max(lengths)]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(xs)], pa.binary()), pa.array([np.array(lengths).tobytes()], pa.binary())], names=["block", "stripe", "top", "ids", "xs", "lengths"])

        for b in batches:
            for i, length, x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(i)
                xs.append(x)
                lengths.append(length)
                if len(ids) == rows:
                    yield out()
                    ids, xs, lengths, made = [], [], [], made + 1
        if ids:
            yield out()

    return run


class _Best:
    """The k best (score, smaller id first) of each query of a block, and the scores below which nothing counts."""

    def __init__(self, n: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.q, self.s, self.i = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.n = n

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        keep = s >= self.least[q]
        q, s, i = (np.concatenate(x) for x in ((self.q, q[keep]), (self.s, s[keep]), (self.i, i[keep])))
        by = np.lexsort((i, -s, q))
        q, s, i = q[by], s[by], i[by]
        first = np.searchsorted(q, np.arange(self.n))
        rank = np.arange(len(q)) - first[q]
        keep = rank < self.k
        self.q, self.s, self.i = q[keep], s[keep], i[keep]
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])


def _meet(best: _Best, q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, turn: np.ndarray | None) -> None:
    """Hold all queries of a block against candidates in descending length."""
    qr, cr = (q, c) if turn is None else (q @ turn, c @ turn)
    dim = q.shape[1]
    cuts = [d for d in (dim // 8, dim // 4, dim // 2) if d]
    tails = {d: (np.sqrt((qr[:, d:] ** 2).sum(axis=1)), np.sqrt((cr[:, d:] ** 2).sum(axis=1))) for d in [0, *cuts]}
    for a in range(0, len(c), SLAB):
        own = slice(a, a + SLAB)
        slack = 1e-9 * (tails[0][0][:, None] * tails[0][1][None, own] + 1)
        alive = tails[0][0][:, None] * tails[0][1][None, own] + slack >= best.least[:, None]
        alive &= q_ids[:, None] != c_ids[None, own]
        if not alive.any():
            continue
        part, at = np.zeros(alive.shape), 0
        for d in cuts:
            part += qr[:, at:d] @ cr[own, at:d].T
            at = d
            alive &= part + tails[d][0][:, None] * tails[d][1][None, own] + slack >= best.least[:, None]
            if alive.mean() < 0.05:
                break
        qi, ci = np.nonzero(alive)
        for s in range(0, len(qi), 1 << 16):
            x, y = qi[s : s + (1 << 16)], ci[s : s + (1 << 16)] + a
            best.add(x, np.einsum("ij,ij->i", q[x], c[y]), c_ids[y])


def _first_scores(head: list[tuple[bytes, bytes]], turn: np.ndarray | None, dim: int, k: int):
    """Adds to query blocks each query's k-th best score among the longest candidates (-inf if there are fewer), and reach: the least length of a candidate that can matter to one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, xs, lengths in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                q_ids, q, length = np.frombuffer(ids, np.int64), np.frombuffer(xs).reshape(-1, dim), np.frombuffer(lengths)
                best = _Best(len(q), k, np.full(len(q), -np.inf))
                for c_ids, c in head:
                    _meet(best, q_ids, q, np.frombuffer(c_ids, np.int64), np.frombuffer(c).reshape(-1, dim), turn)
                need = np.where(length > 0, (best.least * (1 - 1e-9) - 1e-6) / np.maximum(length, 1e-300), np.where(best.least <= 0, -np.inf, np.inf))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([float(need.min())]), pa.array([ids], pa.binary()), pa.array([xs], pa.binary()), pa.array([best.least.tobytes()], pa.binary())], names=["q_block", "reach", "q_ids", "q_xs", "least"])

    return run


def _products(turn: np.ndarray | None, dim: int, k: int):
    """Best candidates of each pair of blocks (q_ids, q_xs, least, ids, xs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, q_xs, least, ids, xs in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                q_ids = np.frombuffer(q_ids, np.int64)
                best = _Best(len(q_ids), k, np.frombuffer(least))
                _meet(best, q_ids, np.frombuffer(q_xs).reshape(-1, dim), np.frombuffer(ids, np.int64), np.frombuffer(xs).reshape(-1, dim), turn)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[best.q]), pa.array(best.i), pa.array(best.s.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank (from 1), vec_id, score; ties to the smaller id.

    Components are floor(256 x). Queries are the rows whose key is divisible by `every`; candidates are all rows but those
    of the query's own key. A row takes no part if its key or vector is null or the vector holds a null or non-finite
    component. Rows that repeat a key are candidates each; as queries they are one, which has the best of all of them. A
    vector shorter than the longest ends in zeros; a query with fewer than k candidates gets what there is. No rows give
    none; other columns are not read. Products are exact up to 2**53.

    Blocks meet by their heads (number, largest length) first; vectors are fetched for pairs within the bound only.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = stored(vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")))
    n, dim, asked = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if(F.col("vec_id") % every == 0)).first()
    dim, turn = max(dim, 1), None
    if dim <= ROTATED:
        gram = np.zeros((dim, dim))
        for i, j, v in rows.mapInArrow(_gram(dim), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
            gram[i, j] = v
        turn = np.linalg.eigh(gram)[1][:, ::-1].copy()

    own = rows.mapInArrow(_with_length(dim), "vec_id long, length double, x binary")
    block = "block long, stripe int, top double, ids binary, xs binary, lengths binary"
    order = [F.col("length").desc(), F.col("vec_id")]
    per_block, per_query = (max(16, min(most, BLOCK_BYTES // (8 * dim))) for most in (BLOCK, QUERIES))
    candidates = stored(own.repartitionByRange(max(1, -(-n // per_block)), *order).sortWithinPartitions(*order).mapInArrow(_blocks(per_block), block))
    head = [(bytes(r[0]), bytes(r[1])) for r in candidates.orderBy(F.col("top").desc()).limit(HEAD).select("ids", "xs").collect()]
    queries = own.where(F.col("vec_id") % every == 0).repartition(max(1, -(-asked // per_query))).mapInArrow(_blocks(per_query), block)
    queries = stored(queries.mapInArrow(_first_scores(head, turn, dim, k), "q_block long, reach double, q_ids binary, q_xs binary, least binary"))

    last = candidates.agg(F.coalesce(F.max("stripe"), F.lit(0))).first()[0]
    spread = queries.select("q_block", "reach", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("stripe"))
    pairs = candidates.select("block", "stripe", "top").join(spread, "stripe").where(F.col("top") >= F.col("reach")).select("block", "q_block")
    met = pairs.join(candidates.select("block", "ids", "xs"), "block").join(queries.drop("reach"), "q_block")
    found = met.select("q_ids", "q_xs", "least", "ids", "xs").mapInArrow(_products(turn, dim, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
