"""Fitting a model on a bounded sample of labelled documents, and scoring all documents with it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_labels, fold, text_of
from .words import chunks, raw_texts

#: Bytes of features that a model is fitted on, at most: documents beyond it are left out of the sample.
FEATURE_BYTES = 1 << 28
#: Bytes of text whose features are made at once; they take some 35 times as much (measured in toxicity).
PIECE = 500_000


def fitted(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, most: int, features: Callable[[list[bytes]], list[bytes]], train: Callable[[list[bytes], np.ndarray], bytes], key: str = "doc_id", text: str = "text") -> bytes:
    """The model that train() makes of at most `most` labelled documents outside the held-out fold.

    The labelled keys are chosen first and sent to the scan of docs, features are made where the texts are, and one task
    sees the sample's features only, in an order of their content, and FEATURE_BYTES of them at most: what doesn't fit is
    not learnt from. A key that several rows share counts once.
    """
    chosen = bounded_labels(labels.where(fold(key, folds) != held), target, key, most).withColumnRenamed(key, "key")
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).join(F.broadcast(chosen), "key")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = raw_texts(b.column(1))
            for i, j in chunks(raw, PIECE):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(features(raw[i:j]), pa.binary())], names=["key", "label", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, room = [], [], FEATURE_BYTES
        for b in batches:
            for x, y in zip(b.column(1), b.column(0).to_pylist(), strict=True):
                size = x.as_buffer().size
                if size <= room:
                    room -= size
                    xs.append(x.as_py())
                    ys.append(y)
        b = x = None  # the batch goes before the model is made
        yield pa.RecordBatch.from_arrays([pa.array([train(xs, np.array(ys, np.int64))], pa.binary())], names=["model"])

    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(make, f"key {kind}, label int, x binary").groupBy("key").agg(F.max("label").alias("label"), F.min("x").alias("x"))
    found = made.select("label", "x").repartition(1).sortWithinPartitions(F.xxhash64("x"), "x", "label").mapInArrow(learn, "model binary").collect()
    return bytes(found[0][0]) if found else train([], np.zeros(0, np.int64))


def scored(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], folds: int, held: int, threshold: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; score() takes whole texts. A null key is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = raw_texts(b.column(2))
            for i, j in chunks(raw, PIECE):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(score(raw[i:j]), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(fold(key, folds) == held, F.lit(False)).alias("held_out"), text_of(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept_where(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], keep: Callable[[np.ndarray], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose text's score keep() accepts: one pass, no shuffle."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = raw_texts(b.column(at))
            for i, j in chunks(raw, PIECE):
                yield b.slice(i, j - i).filter(pa.array(keep(score(raw[i:j])), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
