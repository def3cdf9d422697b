"""Words of whole texts as arrays of 64-bit hashes, a batch of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of text that are worked on at once.
CHUNK = 2_000_000


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: Lower-cases A-Z and makes ASCII punctuation a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else c for c in range(256))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (runs without ASCII white space, A-Z lower-cased), and each text's first position (one more at the end)."""
    from xxhash import xxh3_64_intdigest

    parts = [t.lower().split() for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(parts)), np.uint64, at[-1]), at


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _M2
    x ^= x >> np.uint64(29)
    return x


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; the last n-1 of a text run into the next and are for the caller to leave out."""
    m = max(len(words) - n + 1, 0)
    out = words[:m].copy()
    for k in range(1, n):
        out *= _M1
        out ^= out >> np.uint64(31)
        out += words[k : k + m]
    return mixed(out)


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text its n-word shingles with repeats; a text of fewer words is one shingle; without words none."""
    words, at = word_hashes(texts)
    all_ = grams(words, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(all_[a : b - n + 1])
        elif b > a:
            short = words[a:b]
            out.append(mixed(np.array([int(short[0]) ^ (len(short) << 60)], np.uint64)) if len(short) == 1 else grams(short, len(short)) ^ np.uint64(len(short)))
        else:
            out.append(words[:0])
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def pieces(text: bytes, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of about `size` bytes that cut a text between words only."""
    start = 0
    while start < len(text):
        end = start + size
        while end < len(text):  # a word may be longer than a piece
            step = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, min(size, len(text) - end), end)])
            end += int(step[0]) if len(step) else size
            if len(step):
                break
        yield start, min(end, len(text))
        start = end


def exact_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's words as they are, in memory of a few bytes a word besides the text."""
    from xxhash import xxh3_64_intdigest

    parts = []
    for a, b in pieces(text):
        words = text[a:b].split()
        parts.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends, in bytes."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(text, np.uint8)]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def kept_sha256(text: bytes, keep: np.ndarray | None = None) -> str:
    """Hex sha256 of a text's words joined by one space: all words, or those where keep is true."""
    import hashlib

    out, at, first = hashlib.sha256(), 0, True
    for a, b in pieces(text):
        words = text[a:b].split()
        if keep is not None:
            words, at = list(compress(words, keep[at : at + len(words)].tolist())), at + len(words)
        if words:
            out.update((b"" if first else b" ") + b" ".join(words))
            first = False
    return out.hexdigest()
