"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark removes a query's shuffle files when the query ends, not at the next collection of garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


#: Tables that the scratch() blocks under way have written, the innermost last.
_SCRATCH: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that are stored inside are deleted at the end, but for those stored to keep."""
    own: list[DataFrame] = []
    _SCRATCH.append(own)
    try:
        yield
    finally:
        _SCRATCH.remove(own)
        dropped(*own)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there, for all executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with _setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote, once nothing reads them any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def bounded_labels(labels: DataFrame, target: str, key: str, most: int) -> DataFrame:
    """At most `most` labelled keys, one row each, chosen by a hash of the key. A key labelled twice takes the larger label."""
    one = labels.where(F.col(target).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(target).cast("int").alias("label"))
    return one.orderBy(F.xxhash64(F.col(key)), key).limit(most)


# -- counting sketches: one counter for each of 2**bits buckets, of a size that doesn't grow with the input --

BLOCK = 4096
_SKETCH = "block int, counts binary"


def _packed(counts: np.ndarray) -> pa.RecordBatch:
    import zlib

    blocks = counts.reshape(-1, BLOCK)
    some = np.flatnonzero(blocks.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in some], pa.binary())], names=["block", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got = np.frombuffer(zlib.decompress(raw), np.int64)
            total[k] = total[k] + got if k in total else got
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["block", "counts"])


def marks(df: DataFrame, bucketed, bits: int) -> np.ndarray:
    """Which of 2**bits bucket numbers bucketed(batch) yields anywhere in df, as packed bits. bits: 15 at least."""
    import zlib

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            for ids in bucketed(b):
                seen[ids] = True
        blocks = np.packbits(seen, bitorder="little").reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in some], pa.binary())], names=["block", "counts"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(raw), np.uint8)
                total[k] = total[k] | got if k in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in df.mapInArrow(mark, _SKETCH).repartition("block").mapInArrow(joined, _SKETCH).collect():
        out[row[0] * BLOCK : (row[0] + 1) * BLOCK] = np.frombuffer(zlib.decompress(row[1]), np.uint8)
    return out


def marked(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each bucket number is marked."""
    return (bits[ids >> 3] >> (ids & 7).astype(np.uint8)) & 1 == 1


def sketch(df: DataFrame, bucketed, bits: int) -> np.ndarray:
    """Counts of the bucket numbers that bucketed(batch) yields, over all rows of df.

    Each task sends its non-empty blocks of counters, blocks are summed where the shuffle puts them, and the driver
    gets 2**bits counters whatever the size of df.
    """
    import zlib

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for b in batches:
            for ids in bucketed(b):
                counts += np.bincount(ids, minlength=len(counts))
        yield _packed(counts)

    out = np.zeros(1 << bits, np.int64)
    for row in df.mapInArrow(count, _SKETCH).repartition("block").mapInArrow(_summed, _SKETCH).collect():
        out[row[0] * BLOCK : (row[0] + 1) * BLOCK] = np.frombuffer(zlib.decompress(row[1]), np.int64)
    return out
