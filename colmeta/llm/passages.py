"""Repeated passages: windows of words that start in more than one place, found by FM-indexes over shards.

Cutting documents into shards would hold every document against every shard. Instead each window is sent where equal
windows must be: a window's anchor is the gram of GRAM words with the least hash in it (the first of equal ones), so equal
windows have equal anchors. Consecutive windows with one anchor are a segment; segments are dealt to shards by anchor. An
anchor that occurs once in the corpus holds no repeated window, so its segments go nowhere; most of a corpus ends here,
with some 20 bytes for every 14 words.

A shard builds an FM-index over its segments and streams them through it: backward search over a wavelet matrix gives
the longest matches, and those of a window's length and more are reported. Equal segments are indexed once.

An anchor with very many segments has no shard: no task takes them all. Its windows are dealt to chunks, text by text, and
counted by digests of 128 bits: by chunk first, then over all chunks. Equal texts are one text; of a text that occurs twice every window is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex, repeated_intervals
from .shared import scratch, stored, text_of
from .words import chunks, exact_hashes, grams, kept_sha256, mixed, raw_texts

#: Words of a window and of an anchor; words of a shard; segments of one anchor that go to a shard.
WINDOW, GRAM = 35, 8
SHARD_WORDS = 1 << 20
ANCHOR_SEGMENTS = 1 << 13
#: Windows under frequent anchors that are counted together before they meet others, but for a text's own.
CHUNK_WINDOWS = 1 << 16


def _anchors(words: np.ndarray, at: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the anchors of its segments and their first windows. words: of all texts; at: where each starts, and the end."""
    g = grams(words, GRAM)
    spread = window - GRAM + 1
    least = np.arange(len(g))
    done = 1
    while done < spread:
        step = min(done, spread - done)
        a, b = least[: len(least) - step], least[step:]
        least = np.where(g[a] <= g[b], a, b)
        done += step
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = least[a : max(b - window + 1, a)]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
        out.append((g[own[first]], first))
    return out


def _scanned(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """doc_id, d (the text's digest), n_words, kept_sha256 of all words, anchors and firsts of segments of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(2))
            for a, b in chunks(texts):
                hashes = [exact_hashes(t) for t in texts[a:b]]
                at = np.r_[0, np.cumsum([len(h) for h in hashes])]
                found = _anchors(np.concatenate(hashes), at, window)
                ends = np.r_[0, np.cumsum([len(f) for _, f in found])].astype(np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (np.concatenate([g for g, _ in found]).view(np.int64), np.concatenate([f for _, f in found]).astype(np.int32)))
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(at)), pa.array([kept_sha256(t) for t in texts[a:b]]), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "d", "n_words", "whole", "anchors", "firsts"])

    rows = docs.select(F.col(key).alias("doc_id"), _identity(text_of(text)).alias("d"), text_of(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, d binary, n_words long, whole string, anchors array<long>, firsts array<int>")


def _identity(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _segments(affected: DataFrame, shards: int, window: int) -> DataFrame:
    """shard, tid, first, words of the segments that go to shards."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text, spans in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if spans := [s for s in spans if not s["frequent"]]:
                    words = exact_hashes(text)
                    anchors = np.array([s["anchor"] for s in spans], np.int64).view(np.uint64)
                    dealt = (mixed(anchors ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(20)) % np.uint64(shards)
                    for k in range(0, len(spans), 10_000):
                        part = spans[k : k + 10_000]
                        parts = [words[s["first"] : s["first"] + s["windows"] + window - 1].tobytes() for s in part]
                        columns = [pa.array(dealt[k : k + len(part)].astype(np.int32)), pa.array([tid] * len(part), pa.int64()), pa.array([s["first"] for s in part], pa.int64()), pa.array(parts, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["shard", "tid", "first", "words"])

    return affected.select("tid", "text", "spans").mapInArrow(cut, "shard int, tid long, first long, words binary")


def _matched(window: int):
    """Function that gives the repeated intervals of a shard's segments: tid, start, end."""

    def match(table: pa.Table) -> pa.Table:
        coded = table["words"].combine_chunks().dictionary_encode()
        codes, contents = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        lengths = np.array([len(c) // 8 for c in contents], np.int64)
        at = np.r_[0, np.cumsum(lengths)]
        symbols = np.unique(np.frombuffer(b"".join(contents), np.uint64), return_inverse=True)[1].astype(np.int64) + 1
        del contents
        once = np.bincount(codes, minlength=len(lengths)) == 1
        index = FMIndex(symbols, at)
        which = np.flatnonzero(once)
        who, start, end = repeated_intervals(index, symbols, at[which], at[which + 1], window)
        who = which[who]
        start, end = start - at[who], end - at[who]
        # a segment that occurs twice is repeated as a whole
        rows = np.argsort(codes, kind="stable")
        row_of = rows[np.searchsorted(codes[rows], who)]
        copies = np.flatnonzero(~once[codes])
        at_row = np.r_[row_of, copies]
        first = table["first"].to_numpy()[at_row]
        return pa.table({"tid": table["tid"].to_numpy()[at_row], "start": first + np.r_[start, np.zeros(len(copies), np.int64)], "end": first + np.r_[end, lengths[codes[copies]]]})

    return match


def _windows(affected: DataFrame, window: int) -> DataFrame:
    """chunk, tid, starts (8 bytes a window), digests (16 bytes) of each text's windows under frequent anchors, dealt to chunks of CHUNK_WINDOWS."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for tid, text, spans in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = exact_hashes(text)
                starts = np.concatenate([np.arange(s["first"], s["first"] + s["windows"]) for s in spans if s["frequent"]])
                digests = np.stack([grams(words, window)[starts], grams(mixed(words ^ np.uint64(0x2545F4914F6CDD1D)), window)[starts]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n // CHUNK_WINDOWS]), pa.array([tid]), pa.array([starts.tobytes()]), pa.array([digests.tobytes()])], names=["chunk", "tid", "starts", "digests"])
                n += len(starts)

    return affected.where(F.exists("spans", lambda s: s["frequent"])).select("tid", "text", "spans").mapInArrow(cut, "chunk long, tid long, starts binary, digests binary")


def _counted(table: pa.Table) -> pa.Table:
    """chunk, digest, n: a chunk's distinct windows, with how often it has each."""
    pairs = np.frombuffer(b"".join(table["digests"].to_pylist()), "V16")
    distinct, n = np.unique(pairs, return_counts=True)
    return pa.table({"chunk": np.full(len(n), table["chunk"][0].as_py()), "digest": pa.array([d.tobytes() for d in distinct], pa.binary()), "n": n})


def _marked(window: int):
    """Function that gives what a chunk's windows among the repeated digests cover of each text: tid, start, end."""

    def mark(texts: pa.Table, digests: pa.Table) -> pa.Table:
        repeated = np.frombuffer(b"".join(digests["digest"].to_pylist()), "V16")
        raw = texts["starts"].to_pylist()
        found = np.isin(np.frombuffer(b"".join(texts["digests"].to_pylist()), "V16"), repeated)
        start = np.frombuffer(b"".join(raw), np.int64)[found]
        tid = np.repeat(texts["tid"].to_numpy(), [len(r) // 8 for r in raw])[found]
        by = np.lexsort((start, tid))
        tid, start = tid[by], start[by]
        opens = np.flatnonzero(np.r_[True, (tid[1:] != tid[:-1]) | (start[1:] > start[:-1] + window)]) if len(start) else np.zeros(0, np.int64)
        closes = np.r_[opens[1:], len(start)][: len(opens)] - 1
        return pa.table({"tid": tid[opens], "start": start[opens], "end": start[closes] + window})

    return mark


def _frequent(affected: DataFrame, window: int) -> DataFrame:
    """tid, start, end of what is repeated under frequent anchors.

    A chunk's equal windows become one row before the shuffle, and only the repeated ones come back to it: as many rows as
    chunks have distinct ones, however often a window occurs.
    """
    texts = stored(_windows(affected, window))
    counted = stored(texts.groupBy("chunk").applyInArrow(_counted, "chunk long, digest binary, n long"))
    twice = counted.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    back = counted.select("chunk", "digest").join(twice.hint("rebalance"), "digest")
    return texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_marked(window), "tid long, start long, end long")


def _cleared(affected: DataFrame, found: DataFrame) -> DataFrame:
    """d, n_removed, kept of each text in which something was found."""

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, n, spans in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                edges = np.zeros(n + 1, np.int32)
                np.add.at(edges, [s["start"] for s in spans], 1)
                np.add.at(edges, [s["end"] for s in spans], -1)
                keep = np.cumsum(edges)[:-1] == 0
                removed.append(n - int(keep.sum()))
                kept.append(kept_sha256(text, keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["d", "n_removed", "kept"])

    spans = found.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    return affected.join(spans, "tid").select("d", "text", "n_words", "found").mapInArrow(clear, "d binary, n_removed long, kept string")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, anchor_segments: int = ANCHOR_SEGMENTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs.

    Words are runs without ASCII white space, unchanged. A word is removed if a window of `window` consecutive words that
    holds it also starts elsewhere, in the same text or another row's; windows are judged on the input. kept_sha256 is the
    digest of the words kept, joined by one space. A null text has no words; texts shorter than a window keep all; equal
    texts in several rows, whatever their keys, remove each other. Other columns are not read, no rows give none.

    window: GRAM words at least. A text's windows are one row of a table and so take memory in proportion to the text.
    Tables in the shared folder are deleted at the end, but for the result.
    """
    spark = docs.sparkSession
    with scratch():
        rows = stored(_scanned(docs, key, text, window))
        one = rows.groupBy("d").agg(F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("anchors").alias("anchors"), F.first("firsts").alias("firsts"))
        one = stored(one.withColumn("tid", F.monotonically_increasing_id()))

        parts = F.arrays_zip("anchors", "firsts", F.concat(F.slice("firsts", 2, F.greatest(F.size("firsts"), F.lit(1))), F.array((F.col("n_words") - (window - 1)).cast("int"))).alias("nexts"))
        segments = one.where(F.size("anchors") > 0).select("tid", F.explode(parts).alias("s"))
        segments = segments.select("tid", F.col("s")["anchors"].alias("anchor"), F.col("s")["firsts"].alias("first"), (F.col("s")["nexts"] - F.col("s")["firsts"]).alias("windows"))
        repeated = segments.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > anchor_segments).alias("frequent"))
        spans = segments.join(repeated.hint("rebalance"), "anchor").groupBy("tid").agg(F.collect_list(F.struct("anchor", "first", "windows", "frequent")).alias("spans"))
        texts = docs.select(_identity(text_of(text)).alias("d"), text_of(text).alias("text")).groupBy("d").agg(F.first("text").alias("text"))
        affected = stored(texts.join(one.select("tid", "d", "n_words").join(spans, "tid"), "d"))

        size = affected.select(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.when(s["frequent"], 0).otherwise(s["windows"] + window - 1)).alias("n"), F.exists("spans", lambda s: s["frequent"]).alias("frequent"))
        total, frequent = size.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("frequent"), F.lit(False))).first()
        dealt = _segments(affected, total // shard_words + 1, window)
        found = dealt.groupBy("shard").applyInArrow(_matched(window), "tid long, start long, end long")
        if frequent:
            found = found.unionByName(_frequent(affected, window))
        cleared = stored(_cleared(affected, found))

        result = one.select("d", "copies").join(cleared, "d", "left")
        all_ = (F.col("copies") > 1) & (F.col("n_words") >= window)
        nothing = spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]
        out = rows.select("doc_id", "d", "n_words", "whole").join(result.hint("rebalance"), "d").select(
            "doc_id",
            "n_words",
            F.when(all_, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(all_, F.lit(nothing)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
        )
        return stored(out, keep=True)
