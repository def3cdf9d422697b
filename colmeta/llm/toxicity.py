"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct slots (32-bit hashes) of its words, of their stems (first bytes, which
inflected forms share), of its pairs of neighbours and its pairs around one word. FTRL keeps a learning rate for each slot, and its L1 term leaves most slots at exactly zero: the model is a
short list of slots and weights, whatever the number of slots.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame

from .fitting import fitted, kept_where, scored
from .words import PLAIN, grams, mixed

FOLDS, HELD, THRESHOLD = 4, 2, 0.3
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 12_000
#: Bytes of the stems; a stem may end inside a letter of more bytes.
STEMS = (4, 5)
#: FTRL: rate, its smoothing, L1, L2, passes over the sample; slots of fewer documents are left out.
ALPHA, BETA, L1, L2, PASSES, LEAST_DOCS = 1.0, 1.0, 6.0, 0.0, 6, 4


def _slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text number of every feature of texts, with repeats."""
    from xxhash import xxh3_64_intdigest

    parts = [t.translate(PLAIN).split() for t in texts]
    flat = [w for p in parts for w in p]
    words = np.fromiter(map(xxh3_64_intdigest, flat), np.uint64, len(flat))
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    shift = np.uint64(32)
    slots, docs = [mixed(words.copy()) >> shift], [doc]
    if STEMS and len(words):  # each distinct word is cut and hashed once
        _, spot, which = np.unique(words, return_index=True, return_inverse=True)
        own = [flat[i] for i in spot.tolist()]
    for n in STEMS if len(words) else ():
        stems = np.fromiter((xxh3_64_intdigest(w[:n]) for w in own), np.uint64, len(own))
        slots.append((mixed(stems ^ np.uint64(n)) >> shift)[which])
        docs.append(doc)
    near = doc[1:] == doc[:-1]
    slots.append((grams(words, 2) >> shift)[near])
    docs.append(doc[1:][near])
    if len(words) > 2:
        around = doc[2:] == doc[:-2]
        skip = grams(np.stack((words[:-2], words[2:]), axis=1).ravel(), 2)[::2] * np.uint64(3) >> shift
        slots.append(skip[around])
        docs.append(doc[2:][around])
    return np.concatenate(slots), np.concatenate(docs)


def _features(texts: list[bytes]) -> list[bytes]:
    slots, doc = _slots(texts)
    both = np.unique((doc.astype(np.uint64) << np.uint64(32)) | slots)
    cut = np.searchsorted(both >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))
    low = both.astype(np.uint32)
    return [low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _known(xs: list[np.ndarray], low: int, high: int) -> np.ndarray:
    """Slots from low to high that LEAST_DOCS documents or more have; xs are sorted."""
    part = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in xs]
    slots, docs = np.unique(np.concatenate([*part, np.zeros(0, np.uint32)]), return_counts=True)
    return slots[docs >= LEAST_DOCS]


def _train(rows: list[bytes], labels: np.ndarray) -> bytes:
    """FTRL-proximal over the sample, whose rows are used up; returns slots, weights and bias."""
    own = [np.frombuffer(x, np.uint32) for x in rows]
    rows.clear()
    every = np.concatenate([_known(own, a << 28, (a + 1) << 28) for a in range(16)])
    for i, x in enumerate(own):  # a row's places take the place of its slots
        at = np.minimum(np.searchsorted(every, x), max(len(every) - 1, 0))
        own[i] = (at[every[at] == x] if len(every) else at[:0]).astype(np.int32)
    z, n, bias_z, bias_n = np.zeros(len(every)), np.zeros(len(every)), 0.0, 0.0

    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for turn in range(PASSES):
        for i in np.random.default_rng(turn).permutation(len(own)):
            at = own[i]
            w, b = weight(z[at], n[at], L1), float(weight(np.float64(bias_z), np.float64(bias_n), 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - labels[i]
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w
            n[at] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * b
            bias_n += g * g
    w = weight(z, n, L1)
    out = io.BytesIO()
    np.savez(out, slots=every[w != 0].astype(np.uint64), weights=w[w != 0], bias=float(weight(np.float64(bias_z), np.float64(bias_n), 0.0)))
    return out.getvalue()


def _scorer(model: bytes):
    got = np.load(io.BytesIO(model))
    slots, weights, bias = got["slots"], got["weights"], float(got["bias"])
    known = np.zeros(1 << 20, bool)
    known[(slots >> np.uint64(12)).astype(np.int64)] = True

    def score(texts: list[bytes]) -> np.ndarray:
        total = np.full(len(texts), bias)
        if len(slots):
            x, doc = _slots(texts)
            some = known[(x >> np.uint64(12)).astype(np.int64)]
            x, doc = x[some], doc[some]
            at = np.minimum(np.searchsorted(slots, x), len(slots) - 1)
            hit = slots[at] == x
            both = np.unique(doc[hit].astype(np.int64) * len(slots) + at[hit])
            total += np.bincount(both // len(slots), weights=weights[both % len(slots)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    return score


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, key: str = "doc_id", text: str = "text") -> bytes:
    """The model, fitted on at most `most` labelled documents outside the held-out fold. Without labels it is empty."""
    return fitted(docs, labels, "toxic", FOLDS, HELD, most, _features, _train, key, text)


def toxicity(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Whole texts are scored; a null or empty text has no features and gets the score of the bias. Equal texts get equal
    scores, repeated rows are repeated, a null key is not held out, other columns are not read, no rows give none.
    """
    return scored(docs, _scorer(model), FOLDS, HELD, THRESHOLD, key, text)


def without_toxic(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """The rows of docs whose score is under the threshold, all columns as they are."""
    return kept_where(docs, _scorer(model), lambda s: s < THRESHOLD, text)
