"""A Merkle manifest of a dataset: one tree a source, one tree over their roots, and a proof for every row.

The trees are logs in postorder. A node is written when its subtree is complete, so its place follows from sizes alone: if
the last leaf below it has number e, then e leaves and e // 16 + e // 256 + ... inner nodes were complete before that leaf,
and the node stands as many places behind it as it is levels high. Nobody has to count or to wait: aligned builders take
4,096 consecutive nodes each, a subtree of three levels, and write it in completion order at the right places. Their tops
are the leaves of the next tier of builders. A proof then addresses siblings by their places.

Going down again, a builder's block gets the path from its top to the root, of some kilobytes, and its rows their proofs.
A source of any size is cut into blocks, and a block is all that a task holds.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch, stored, text_of

#: Children of a node are 2**BITS; a builder's block is HEIGHT levels high, unless said.
BITS, HEIGHT = 4, 3


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def place(level: int, number: int, leaves: int) -> int:
    """Where a node stands in its tree's log. level: 0 for leaves; number: among the nodes of its level."""
    last = min((number + 1) << BITS * level, leaves) - 1
    out, more = last + level, last >> BITS
    while more:
        out, more = out + more, more >> BITS
    return out


def _levels(nodes: int, most: int) -> int:
    """Levels that a builder makes of a tree's nodes: the most that a block has, or as many as leave one node."""
    out = 0
    while nodes > 1 and out < most:
        nodes, out = -(-nodes >> BITS), out + 1
    return out


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Hex sha256 of values, each as its UTF-8 byte count, a colon and itself, or as a hyphen."""
    return F.sha2(F.concat(*(_part(v) for v in values)), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with i, their place from 0 in their tree, and leaves, the tree's rows. order: columns, without nulls at the front.

    Rows are ranged, so that a tree of any size is cut among tasks; a place is that in the range and the counts before.
    """
    by = ["tree", *(F.col(c).asc_nulls_first() for c in order), "_at"]
    ranged = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_at")
    ranged = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = ranged.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    tree = Window.partitionBy("tree")
    starts = counts.select("tree", "_part", (F.sum("_n").over(tree.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_start"), F.sum("_n").over(tree).alias("leaves"))
    return ranged.join(starts, ["tree", "_part"]).withColumn("i", F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def _builder(tier: int, kind: str, block: int):
    """Function and schema: a block's nodes in completion order, its leaves with what they carry."""
    schema = f"tree string, block long, position long, digest binary, i long, leaves long, top boolean, doc_id {kind}, changed binary"
    low = tier * block

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        leaves, first = table["leaves"][0].as_py(), table["i"][0].as_py()
        height = _levels(-(-leaves >> BITS * low), block)
        made = [first >> BITS * k for k in range(height + 1)]  # number of each level's next node
        waiting: list[list[str]] = [[] for _ in range(height + 1)]
        places, digests, items = [], [], []

        def append(level: int, digest: str, item: int | None) -> None:
            places.append(place(low + level, made[level], leaves))
            digests.append(bytes.fromhex(digest))
            items.append(item)
            made[level] += 1
            waiting[level].append(digest)
            if level < height and len(waiting[level]) == 1 << BITS:
                close(level)

        def close(level: int) -> None:
            digest = _digest("".join(waiting[level]))
            waiting[level].clear()
            append(level + 1, digest, None)

        for k, d in enumerate(table["digest"].to_pylist()):
            append(0, d.hex(), k)
        for level in range(height):
            if waiting[level]:
                close(level)
        n, take = len(places), pa.array(items, pa.int64())
        top = [False] * (n - 1) + [True]
        columns = [[table["tree"][0].as_py()] * n, [first >> BITS * block] * n, places, digests, table["i"].take(take), [leaves] * n, top, table["doc_id"].take(take), table["changed"].take(take)]
        return pa.table({name: c if isinstance(c, pa.ChunkedArray) else pa.array(c) for name, c in zip(("tree", "block", "position", "digest", "i", "leaves", "top", "doc_id", "changed"), columns, strict=True)})

    return build, schema


def _prover(tier: int, kind: str, block: int, root: str | None):
    """Function and schema: from a block's log and the path above it, each of its items' path, or with root each row's result."""
    low = tier * block
    path_type = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def prove(table: pa.Table) -> pa.Table:
        above = table.filter(pa.compute.is_valid(table["path"]))
        rest, subroot = above["path"][0].as_py(), above["subroot"][0].as_py()
        log = table.filter(pa.compute.is_valid(table["position"]))
        leaves = log["leaves"][0].as_py()
        at = dict(zip(log["position"].to_pylist(), (d.hex() for d in log["digest"].to_pylist()), strict=True))
        items = log.filter(pa.compute.is_valid(log["i"])).sort_by("i")
        numbers = items["i"].to_pylist()
        height = _levels(-(-leaves >> BITS * low), block)
        sizes = [-(-leaves >> BITS * (low + k)) for k in range(height + 1)]
        subroot = subroot or at[place(low + height, numbers[0] >> BITS * height, leaves)]

        def siblings(level: int, number: int) -> dict[str, str]:
            first = number >> BITS << BITS
            run = [at[place(low + level, k, leaves)] for k in range(first, min(first + (1 << BITS), sizes[level]))]
            return {"left": "".join(run[: number - first]), "right": "".join(run[number - first + 1 :])}

        higher: dict[int, list[dict[str, str]]] = {}

        def path(number: int) -> list[dict[str, str]]:
            if not height:
                return rest
            run = number >> BITS
            if run not in higher:
                higher[run] = [siblings(k, number >> BITS * k) for k in range(1, height)] + rest
            return [siblings(0, number), *higher[run]]

        if root is None:
            n = len(numbers)
            return pa.table({"tree": items["tree"], "i": items["i"], "path": pa.array([path(k) for k in numbers], path_type), "subroot": [subroot] * n})
        proofs, folded, digests = [], [], [d.hex() for d in items["digest"].to_pylist()]
        for number, digest, changed in zip(numbers, digests, items["changed"].to_pylist(), strict=True):
            steps, now = path(number), changed.hex() if changed is not None else digest
            proofs.append(_digest("".join(s["left"] + s["right"] for s in steps)))
            for s in steps:
                now = _digest(s["left"] + now + s["right"])
            folded.append(now)
        n = len(numbers)
        return pa.table({"doc_id": items["doc_id"], "leaf": digests, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    if root is None:
        return prove, "tree string, i long, path array<struct<left: string, right: string>>, subroot string"
    return prove, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _logged(nodes: DataFrame, most: int, kind: str, block: int) -> list[DataFrame]:
    """The logs of all trees, one table a tier of builders. most: leaves of the largest tree."""
    tiers: list[DataFrame] = []
    while True:
        build, schema = _builder(len(tiers), kind, block)
        tiers.append(stored(nodes.groupBy("tree", F.shiftright("i", BITS * block).alias("_block")).applyInArrow(build, schema)))
        if most <= 1 << BITS * block * len(tiers):
            return tiers
        open_ = tiers[-1].where(F.col("top") & (F.col("leaves") > 1 << BITS * block * len(tiers)))
        nodes = open_.select("tree", F.col("block").alias("i"), "leaves", "digest", "doc_id", "changed")


def _tops(tiers: list[DataFrame], block: int) -> list[DataFrame]:
    """Of each tier, the roots of the trees that end there."""
    return [t.where(F.col("top") & (F.col("leaves") <= 1 << BITS * block * (k + 1))) for k, t in enumerate(tiers)]


def _proved(tiers: list[DataFrame], paths: DataFrame, kind: str, block: int, root: str | None) -> DataFrame:
    """Walk the tiers down. paths: tree, path, subroot: the way up from each tree's root."""
    none = F.lit(None)
    below = None
    for k in range(len(tiers) - 1, -1, -1):
        ends = _tops(tiers, block)[k].select("tree", "block").join(paths, "tree")
        suffix = ends if below is None else ends.unionByName(below.select("tree", F.col("i").alias("block"), "path", "subroot"))
        log = tiers[k].withColumns({"path": none.cast(paths.schema["path"].dataType), "subroot": none.cast("string")})
        prove, schema = _prover(k, kind, block, root if k == 0 else None)
        below = log.unionByName(suffix, allowMissingColumns=True).groupBy("tree", "block").applyInArrow(prove, schema)
        below = stored(below, keep=k == 0 and root is not None)
    return below


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", others: tuple[str, ...] = ("lang", "n_chars"), block: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs.

    A leaf is the digest of the row's key, source, others and text. A source's leaves, in the order of keys (null first; equal keys by their
    leaves), are joined in runs of 16 until one is left, its subroot; subroots in the order of sources (null first) give
    root alike. proof_sha256 is the digest of all siblings from leaf to root; folded_root is made from a leaf and these
    siblings, and verified says whether it is root. Where the key's crc32 is divisible by 5, the leaf to fold is that of
    the row with its text's A-Z in lower case; a null key's row is folded as it is.

    block: levels of a builder's block. Null fields differ from empty ones; repeated rows have a leaf each; other columns are not read; no rows give none. All
    logs are deleted at the end, the result stays in the shared folder.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    result = _prover(0, kind, block, "")[1]
    fields = (key, source, *others, text)
    lowered = F.translate(text_of(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = leaf(*(F.when(F.col(f).isNotNull(), lowered) if f == text else F.col(f) for f in fields))
    tampered = F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
    rows = docs.select(
        F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))).alias("tree"),
        F.col(key).alias("doc_id"),
        F.unhex(leaf(*(F.col(f) for f in fields))).alias("digest"),
        F.when(tampered, F.unhex(changed)).alias("changed"),
    )
    with scratch():
        nodes = stored(_numbered(stored(rows), ["doc_id", "digest"]))
        most = nodes.agg(F.max("leaves")).first()[0]
        if most is None:
            return spark.createDataFrame([], result)
        tiers = _logged(nodes, most, kind, block)
        tops = _tops(tiers, block)
        roots = tops[0]
        for t in tops[1:]:
            roots = roots.unionByName(t)
        roots = roots.select(F.lit("").alias("tree"), F.col("tree").alias("doc_id"), "digest", F.lit(None).cast("binary").alias("changed"))
        sources = stored(_numbered(stored(roots), ["doc_id"]))
        upper = _logged(sources, sources.count(), "string", block)
        root = _tops(upper, block)[-1].first()["digest"].hex()
        named = sources.select("i", F.col("doc_id").alias("_name"), F.lower(F.hex("digest")).alias("subroot"))
        start = spark.createDataFrame([("", [], None)], "tree string, path array<struct<left: string, right: string>>, subroot string")
        paths = _proved(upper, start, "string", block, None).drop("tree", "subroot").join(named, "i").select(F.col("_name").alias("tree"), "path", "subroot")
        return _proved(tiers, stored(paths), kind, block, root)


