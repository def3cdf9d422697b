"""Sharding by jump consistent hashing: a key and the number of shards decide, and one more shard only takes rows into itself.

DataFrame functions only. The published hash walks a key's jumps with a 64-bit linear congruential generator. Its
products wrap around; here they are made of 16- and 32-bit halves, which never overflow a long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, text_of

#: Multiplier of the generator that the published algorithm names.
MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def _times(half: Column, factor: int) -> tuple[Column, Column]:
    """A 32-bit half times a 32-bit factor, as the product by the factor's low 16 bits and that by its high 16."""
    return half * F.lit(factor & 0xFFFF), half * F.lit(factor >> 16)


def _wrapped(half: Column, factor: int) -> Column:
    """half * factor modulo 2**32, before the last masking."""
    a, b = _times(half, factor)
    return a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16)


def _next(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Halves of (hi * 2**32 + lo) * MULTIPLIER + 1 modulo 2**64."""
    low, high = MULTIPLIER & _LOW, MULTIPLIER >> 32
    a, b = _times(lo, low)
    s = a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(s, 32) + F.shiftright(b, 16)
    return s.bitwiseAND(F.lit(_LOW)), (_wrapped(hi, low) + _wrapped(lo, high) + carry).bitwiseAND(F.lit(_LOW))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a long key among `shards`."""

    def state(lo: Column, hi: Column, b: Column, j: Column) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), b.alias("b"), j.alias("j"))

    def step(s: Column, _: Column) -> Column:
        lo, hi = _next(s["lo"], s["hi"])
        far = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        return F.when(s["j"] >= shards, s).otherwise(state(lo, hi, s["j"], far))

    start = state(key.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(key, 32), F.lit(-1).cast("long"), F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def sharded(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs.

    size: UTF-8 bytes of the text and 1; the crc32 of a null text is that of an empty one. An integral key is hashed as
    it is, any other by xxhash64 of its text; a null key goes where 0 goes. slot counts from 0 within a shard, in the
    order of keys (null first), then of text_crc32 and size. Equal keys share a shard, repeated rows have a slot each, no
    rows give none, other columns are not read.

    Rows are ranged by shard, key and place, so that a shard or a key of any size is cut among tasks; a slot is a row's
    place in its range and the counts of the ranges before.
    """
    kind = docs.schema[key].dataType.simpleString()
    number = F.col(key).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col(key).cast("string"))
    number = F.when(F.col(key).isNull(), F.lit(0).cast("long")).otherwise(number)
    raw = text_of(text)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        jump_hash(number, shards).alias("shard"),
        jump_hash(number, shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_at"),
    )
    order = ["shard", F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "_at"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_at")
    ranged = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = ranged.groupBy("shard", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")
    starts = counts.select("shard", "_part", (before - F.col("_first")).alias("_start"))
    out = ranged.join(starts, ["shard", "_part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_row")).cast("long").alias("slot"), "grown_shard")
