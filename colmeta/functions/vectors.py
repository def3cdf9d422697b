"""Vector arithmetic on array columns, in doubles, and the text encoder's interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """v over its length; the zero vector stays."""
    return F.when(norm(v) > 0, F.transform(doubles(v), lambda x: x / norm(v))).otherwise(doubles(v))


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """Squared L2 distance, or 1 less the cosine; smaller is closer. A zero vector has cosine 0 with all."""
    if metric == "l2sq":
        return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "cosine":
        length = norm(a) * norm(b)
        return 1 - F.when(length > 0, dot(a, b) / length).otherwise(0.0)
    raise ValueError(f"metric {metric!r} is not l2sq or cosine")


def is_definition(text: Column) -> Column:
    """Whether a text defines something: neither blank nor the word nan."""
    return text.isNotNull() & (F.trim(text) != "") & (F.lower(F.trim(text)) != "nan")


def blended(word: Column, definition: Column, alpha: float = 0.4, normalise: bool = False) -> Column:
    """alpha parts of word and 1 - alpha of definition; word alone where there is no definition."""
    mix = F.zip_with(doubles(word), doubles(definition), lambda x, y: alpha * x + (1 - alpha) * y)
    out = F.coalesce(mix, doubles(word))
    return normalised(out) if normalise else out


def model_folder(name: str) -> str:
    """A model's name as the name of a folder."""
    return name.replace("/", "--")


def mean_vectors(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Element-wise mean of the vectors of each group, not normalised: the columns of `by` and `mean`."""
    parts = df.select(*by, F.posexplode(doubles(F.col(vector))).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return parts.groupBy(*by).agg(ordered.alias("mean"))


#: Components of hashed_vector() are multiples of one over this: their sums and products are exact in doubles, whatever the order.
STEPS = 1024


def _hashed_words(dim: int) -> Callable[[str], list[float]]:
    known: dict[str, int] = {}

    def place(word: str) -> int:
        import hashlib

        if len(known) >= 1 << 17:  # a stretch of texts shares most of its words
            known.clear()
        h = int(hashlib.md5(word.encode()).hexdigest()[:4], 16)
        return known.setdefault(word, h % dim if h < 32768 else h % dim + dim)

    def encode(words: str) -> list[float]:
        parts = words.split()
        if not parts:
            return [0.0] * dim
        both = np.bincount([known[w] if w in known else place(w) for w in parts], minlength=2 * dim)
        v = both[:dim] - both[dim:]
        size = np.sqrt(np.float64((v * v).sum()))
        x = v / (size or 1.0) * STEPS
        whole = np.trunc(x)
        return ((whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0.0) + 0.0) / STEPS).tolist()

    return encode


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """A stand-in encoder of a text column: signed hashes of lower-cased words, of about unit length, rounded to STEPS.

    It compares words, not meanings. A word is a run of letters; the first four hex digits of its md5 are its number h: it
    adds 1 to component h mod dim if h < 32768, else -1. A null text and one without words give the zero vector. Spark
    tells words, a worker counts them, one look a word; texts go to workers by a hundred, so long ones take little memory.
    """
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")
    encode = F.udf(_hashed_words(dim), "array<double>", useArrow=False).asNondeterministic()  # so that no filter on the vector makes it again
    return encode(words)


def hashing_encoder(dim: int = 64) -> Callable[[pd.Series], list[np.ndarray]]:
    """A stand-in encoder: signed hashes of lower-cased words, of unit length. It compares words, not meanings."""

    known: dict[str, int] = {}
    slot = known.get

    def encode(texts: pd.Series) -> list[np.ndarray]:
        import re
        import zlib

        out = []
        for text in texts:
            tokens = re.findall(r"[^\W\d_]+", (text or "").lower())
            slots = np.fromiter((slot(t) if t in known else known.setdefault(t, zlib.crc32(t.encode())) for t in tokens), np.int64, len(tokens))
            v = np.bincount(slots % dim, weights=np.where(slots & 0x80000000, 1.0, -1.0), minlength=dim).astype(np.float32)
            size = np.linalg.norm(v)
            out.append(v / size if size else v)
            if len(known) > 1 << 16:  # a stretch of texts shares most of its words
                known.clear()
        return out

    return encode


def encoded(df: DataFrame, text: str, encoder: Callable[[pd.Series], list[np.ndarray]], to: str = "embedding") -> DataFrame:
    """df with a vector for each text. The encoder gets batches of texts; it goes to a worker once, with what it holds."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encoder(texts)))

    return df.withColumn(to, run(F.col(text)))
