"""Near-duplicate classes by an n-gram Jaccard join with adaptive multi-match prefixes.

Every text is the set of its distinct word shingles. All sets are ordered by one global order, rare shingles first. If
two sets share t shingles, then their first (size - t + l) shingles share at least l, for every l. Each document picks
its own l, the cheapest by the estimated cost of its candidates: a longer prefix reads more lists, but asks more shared
shingles of a candidate before it is verified. Every candidate is verified on the whole sets.

The steps:

1. One pass counts shingles in a sketch of fixed size. The counts only order shingles and estimate costs; any order is exact.
2. One pass finds each text's set, as a digest of 128 bits, its prefix and level l. Texts with equal sets are one node from
   here on, and nodes are numbered: no two sets share a number.
3. Groups of near copies would make a candidate of each pair of them. So first each node is held against two others that
   share one of its few smallest shingle hashes: the most central one and the next in size (of its part of the group, as
   large groups are cut). Links that hold join nodes into components.
4. The prefix join makes candidates only of nodes that still are in different components, with the length and position
   bounds of each pair: they meet at an entry of their shortest prefixes and must share l entries of the lengthened ones.
   With the links of step 3 this finds all components, whatever step 3 missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import dropped, marked, marks, scratch, sketch, stored, text_of
from .words import chunks, raw_texts, shingles

#: Bits of the counting sketch that orders shingles; least and most bits of the filter that tells which texts a verification
#: needs: eight for each text, up to 8 MB. Above, more sets are shuffled than needed, all at most.
ORDER_BITS, NEED_BITS = 20, (16, 26)
#: The levels l that a document chooses from.
LEVELS = (1, 2, 4, 8)
#: Smallest shingle hashes by which near copies first meet, and how many of them two must share to be verified in that step.
HUBS, SHARED = 4, 2
#: Nodes of a part of a group that share a hash; larger groups are cut into parts of about so many.
PART = 4096
#: A candidate's verification costs about this share of its set's size in list entries.
VERIFY_COST = 0.25

_SIG = "doc_id {id}, key binary, th binary, n int, ell int, central int, hubs array<long>, prefix binary"
_SET = "th binary, items binary"
_POST = "token long, k long, lab long, pos int, n int"


def _sorted_set(s: np.ndarray) -> np.ndarray:
    """Distinct shingles; 56 bits of the hash are their identity, which leaves a byte for the order."""
    s = np.sort(s >> np.uint64(8))
    return s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def _digest(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text.cast("binary")))


def _heads(digests: pa.Array, bits: int) -> np.ndarray:
    """Bucket number of each digest."""
    return (np.frombuffer(b"".join(digests.to_pylist()), ">u8")[::2] >> np.uint64(64 - bits)).astype(np.int64)


def _bucket(ids: np.ndarray, bits: int) -> np.ndarray:
    return (ids >> np.uint64(56 - bits)).astype(np.int64)


def _least_overlap(n: Column | int, m: Column | int, num: int, den: int):
    """Smallest overlap of sets of n and m items that makes num/den of their union."""
    return -((-num * (n + m)) // (num + den))


def _level(df: np.ndarray, n: int, room: int) -> int:
    """The l of the least estimated cost: list entries read, and a verification for each set that can hold l of them."""
    best, chosen = None, 1
    for level in LEVELS:
        if level > max(n - room, 1):
            break
        read = float(df[: room + level].sum())
        cost = read + read / level * VERIFY_COST * n
        if best is None or cost < best:
            best, chosen = cost, level
    return chosen


def _signatures(order: np.ndarray, words: int, num: int, den: int):
    """Function over batches of (id, th, text) that yields rows of _SIG; prefix and hubs come once for each set and task."""
    typical = np.exp2(np.arange(256) / 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        seen: set[bytes] = set()
        for batch in batches:
            texts, ids, ths = raw_texts(batch.column(2)), batch.column(0), batch.column(1)
            for a, b in chunks(texts):
                out: dict[str, list] = {c: [] for c in ("key", "n", "ell", "central", "hubs", "prefix")}
                for s in shingles(texts[a:b], words):
                    items = _sorted_set(s)
                    n, key, row = len(items), None, (0, 0, None, None)
                    if n:
                        key = xxh3_128_digest(items.tobytes())
                        if key not in seen:
                            seen.add(key)
                            q = order[_bucket(items, ORDER_BITS)]
                            keys = np.sort((q.astype(np.uint64) << np.uint64(56)) | items)
                            room = n + (-num * n // den)
                            ell = _level(typical[(keys >> np.uint64(56)).astype(np.int64)], n, room)
                            room_low = n - _least_overlap(n, n, num, den)
                            keep = min(n, max(room + ell, room_low + LEVELS[-1]))
                            row = (ell, int(1000 * q.mean()), items[:HUBS].astype(np.int64), keys[:keep].tobytes())
                    for c, v in zip(out, (key, n, *row), strict=True):
                        out[c].append(v)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(out["key"], pa.binary()), ths.slice(a, b - a), *(pa.array(out[c], pa.int32()) for c in ("n", "ell", "central")), pa.array(out["hubs"], pa.list_(pa.int64())), pa.array(out["prefix"], pa.binary())],
                    names=["doc_id", "key", "th", "n", "ell", "central", "hubs", "prefix"],
                )

    return run


def _sets_of(needed: np.ndarray, bits: int, words: int):
    """Function over batches of (th, text) that yields the sets of texts that may be needed, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            take = []
            for i in np.flatnonzero(marked(needed, _heads(batch.column(0), bits))).tolist():
                th = batch.column(0)[i].as_py()
                if th not in seen:
                    seen.add(th)
                    take.append(i)
            if not take:
                continue
            ths, raw = (batch.column(i).take(pa.array(take)) for i in range(2))
            texts = raw_texts(raw)
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([ths.slice(a, b - a), pa.array([_sorted_set(s).tobytes() for s in shingles(texts[a:b], words)], pa.binary())], names=["th", "items"])

    return run


def _linked(num: int, den: int):
    """Function over batches of (ka, kb, items a, items b) that yields the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                m = np.sort(np.concatenate((p, q)), kind="stable")
                both = int(np.count_nonzero(m[1:] == m[:-1]))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links u, v among pairs (ka, ta, kb, tb): numbers of the nodes and the digest of a text of each. texts: th, text."""
    pairs = stored(pairs)
    n = pairs.count()
    if not n:
        return pairs.select(F.col("ka").alias("u"), F.col("kb").alias("v"))
    bits = min(max((16 * n).bit_length(), NEED_BITS[0]), NEED_BITS[1])

    def at(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield _heads(batch.column(0), bits)

    needed = marks(pairs.select(F.explode(F.array("ta", "tb")).alias("th")), at, bits)
    sets = texts.mapInArrow(_sets_of(needed, bits, words), _SET)
    left, right = sets.toDF("ta", "items_a"), sets.toDF("tb", "items_b")
    met = pairs.join(left, "ta").join(right, "tb").select("ka", "kb", "items_a", "items_b")
    return stored(met.mapInArrow(_linked(num, den), "u long, v long").distinct())


def _hub_pairs(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Nodes that share one of their smallest hashes: each with the most central of them, and with the next in size of its part.

    Pairs that share fewer than SHARED of them are hardly similar and left to the prefix join, which misses none.
    """
    posts = stored(nodes.select("k", "n", "central", "hubs", F.explode("hubs").alias("token")))
    me = F.struct("k", "n", "hubs")
    middle = stored(posts.groupBy("token").agg(F.max_by(me, F.struct("central", "n", "k")).alias("hub"), F.count("*").alias("many")).where("many > 1"))
    star = posts.join(middle, "token").select("token", me.alias("a"), "hub", F.pmod(F.col("k"), F.ceil(F.col("many") / PART)).alias("part"))
    by_size = Window.partitionBy("spot").orderBy("a.n", "a.k")
    both = star.withColumn("spot", F.xxhash64("token", "part")).withColumn("near", F.lag("a").over(by_size)).select("a", F.explode(F.array("hub", "near")).alias("b")).where("b is not null and a.k <> b.k")
    lo, hi = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    a, b = F.least("a", "b"), F.greatest("a", "b")
    shared = F.size(F.array_intersect("a.hubs", "b.hubs")) >= F.least(F.lit(SHARED), lo)
    met = both.where((den * lo >= num * hi) & shared).select(a["k"].alias("ka"), b["k"].alias("kb")).distinct()
    text = nodes.select("k", "me.th")
    return met.join(text.toDF("ka", "ta"), "ka").join(text.toDF("kb", "tb"), "kb")


def _postings(num: int, den: int):
    """Function over rows (k, lab, n, prefix) that yields _POST: the entries of each node's shortest prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, lab, n = (batch.column(i).to_numpy() for i in range(3))
            short = n + (-num * n.astype(np.int64) // den) + 1
            raw = batch.column(3).to_pylist()
            for i in range(0, len(raw), 256):
                part = [np.frombuffer(x, np.int64)[:m] for x, m in zip(raw[i : i + 256], short[i : i + 256].tolist(), strict=True)]
                sizes = [len(x) for x in part]
                pos = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])
                rep = [pa.array(np.repeat(x[i : i + 256], sizes)) for x in (k, lab, n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)), rep[0], rep[1], pa.array(pos), rep[2]], names=["token", "k", "lab", "pos", "n"])

    return run


def _matched(num: int, den: int):
    """Function over pairs (ka, ta, na, ell, prefix a, kb, tb, nb, prefix b) that keeps those whose lengthened prefixes share l entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, ell, nb = (batch.column(i).to_pylist() for i in (2, 3, 7))
            keep = []
            for n, most, x, m, y in zip(na, ell, batch.column(4).to_pylist(), nb, batch.column(8).to_pylist(), strict=True):
                t = _least_overlap(n, m, num, den)
                level = min(most, t)
                both = np.sort(np.concatenate((np.frombuffer(x, np.uint64)[: n - t + level], np.frombuffer(y, np.uint64)[: m - t + level])), kind="stable")
                keep.append(int(np.count_nonzero(both[1:] == both[:-1])) >= level)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1, 5, 6)], names=["ka", "ta", "kb", "tb"])

    return run


def _prefix_pairs(nodes: DataFrame, lab: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates of the prefix join among nodes of different components: ka, ta, kb, tb.

    A pair meets at an entry of both shortest prefixes (l = 1), within the bounds of its own sizes; it stays if the
    prefixes lengthened to the larger set's l share l entries.
    """
    own = nodes.select("k", "n", "prefix").join(lab.toDF("k", "lab"), "k", "left").select("k", F.coalesce("lab", "k").alias("lab"), "n", "prefix")
    every = own.mapInArrow(_postings(num, den), _POST)
    # lists of one component make no candidate: of the others' tokens there is a table, so that no list is in one task's memory
    across = stored(every.groupBy("token").agg(F.min("lab").alias("least"), F.max("lab").alias("most")).where("least < most").select("token"))
    posts = stored(every.join(across, "token", "left_semi"))
    r, s = posts.alias("r"), posts.alias("s")
    rn, sn = F.col("r.n").cast("long"), F.col("s.n").cast("long")
    t = F.floor((num * (rn + sn) + num + den - 1) / (num + den))
    rule = (
        (F.col("r.token") == F.col("s.token"))
        & (F.col("r.lab") != F.col("s.lab"))
        & ((rn > sn) | ((rn == sn) & (F.col("r.k") > F.col("s.k"))))
        & (den * sn >= num * rn)
        & (F.col("r.pos") <= rn - t)
        & (F.col("s.pos") <= sn - t)
    )
    met = stored(r.join(s, rule).select(F.col("r.k").alias("ka"), F.col("s.k").alias("kb")).distinct())
    dropped(across, posts)
    a = nodes.select(F.col("k").alias("ka"), F.col("me.th").alias("ta"), F.col("n").alias("na"), "ell", F.col("prefix").alias("pa"))
    b = nodes.select(F.col("k").alias("kb"), F.col("me.th").alias("tb"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
    both = met.join(a, "ka").join(b, "kb").select("ka", "ta", "na", "ell", "pa", "kb", "tb", "nb", "pb")
    return both.mapInArrow(_matched(num, den), "ka long, ta binary, kb long, tb binary")


def _labelled(docs: DataFrame, key: str, text: str, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of the rows of docs (_SIG), and a row for each set: key, lab (the number of its class), me.

    me has the least doc_id of the set's rows, null where none has one, and the digest of that row's text.
    """
    src = docs.select(F.col(key).alias("doc_id"), _digest(text_of(text)).alias("th"), text_of(text).alias("text"))
    texts = src.select("th", "text")

    def at(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        raw = raw_texts(batch.column(0))
        for a, b in chunks(raw):
            found = shingles(raw[a:b], words)
            if found:
                yield _bucket(np.concatenate(found) >> np.uint64(8), ORDER_BITS)

    counts = sketch(src.select("text"), at, ORDER_BITS)
    order = np.minimum(np.round(8 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)
    kind = docs.schema[key].dataType.simpleString()
    sig = stored(src.mapInArrow(_signatures(order, words, num, den), _SIG.format(id=kind)))
    me = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")
    sets = sig.where("key is not null").groupBy("key").agg(F.min(me).alias("me"), *(F.max(c).alias(c) for c in ("n", "ell", "central", "hubs", "prefix")))
    nodes = stored(sets.select(F.monotonically_increasing_id().alias("k"), "*"))

    first = _verified(_hub_pairs(nodes, num, den), texts, words, num, den)
    lab = components(first)
    more = _verified(_prefix_pairs(nodes, lab, num, den), texts, words, num, den)
    label = components(lab.toDF("u", "v").unionByName(more)).toDF("k", "lab")
    return sig, nodes.select("k", "key", "me").join(label, "k", "left").select("key", F.coalesce("lab", "k").alias("lab"), "me")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Class of each document under links of Jaccard similarity num/den or more over sets of word shingles.

    Returns a row per row of docs: doc_id (the key), n_shingles, component_id. Words are runs without ASCII white
    space, A-Z lower-cased; a text of fewer than `words` words is one shingle; a null, empty or wordless text has the
    empty set and links with nothing. component_id is the smallest key reachable by links, the row's own where it links
    with nothing. Rows that share a key share nothing but what their texts link; a null key is never a component_id
    unless all keys of the component are null. Other columns of docs are not read. An empty table gives no rows.

    A set's and a text's identity are digests of 128 bits, a shingle's is 56 bits of a hash.
    """
    with scratch():
        sig, sets = _labelled(docs, key, text, words, num, den)
        least = stored(sets.select("key", "lab", F.col("me.doc_id").alias("first")))
        top = stored(least.groupBy("lab").agg(F.min("first").alias("component_id")))
        by_set = stored(least.join(top, "lab").select("key", "component_id"))  # of stored sides, so that a class of many sets can be split
        out = sig.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles")).join(by_set, "key", "left")
        return stored(out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), keep=True)


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay when one document of each class of near copies does: the one of the smallest key.

    Classes come from texts alone, so unrelated texts under one key all stay, and near copies without a key are one
    document. Rows that repeat a key and text are one document. A text without words is no copy of another; of those
    under a null key all rows stay.
    """
    with scratch():
        sig, sets = _labelled(docs, key, text, 5, 80, 100)
        best = sets.groupBy("lab").agg(F.min("me").alias("me")).select("me.doc_id", "me.th", F.lit(False).alias("bare"))
        bare = sig.where("key is null").select("doc_id", "th", F.lit(True).alias("bare")).distinct()
        keep = stored(best.unionByName(bare), keep=True)
    ids = keep.where("not bare or doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    th = _digest(text_of(text))
    kept = docs.join(ids, F.col(key).eqNullSafe(F.col("__id")) & (th == F.col("__th")), "left_semi")
    others = [c for c in docs.columns if c != key]
    one = kept.groupBy(key, th.alias("__th")).agg(F.first(F.struct(*others)).alias("_row")).select(key, "_row.*").select(docs.columns)
    loose = docs.where(F.col(key).isNull()).join(keep.where("bare and doc_id is null").select(F.col("th").alias("__th")), th == F.col("__th"), "left_semi")
    return one.unionByName(loose)
