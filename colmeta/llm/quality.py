"""Quality by attention-based multiple-instance learning over passages.

A document is a bag of passages of WORDS words. Each passage is encoded by one tanh layer over its hashed words, the
hashed ends of their shapes and a few counts (kinds of characters, length of words, repetitions); gated attention weighs the passages, and the label of the
document judges the weighted sum. Every sum over a passage or a document goes over its own parts only, in their order: a
document's score doesn't depend on what stands beside it.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame

from .fitting import fitted, kept_where, scored
from .words import grams, mixed, word_hashes

FOLDS, HELD, THRESHOLD = 5, 0, 0.3
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 8_000
#: Words of a passage; slots of hashed words; lags at which a repeated word counts; sizes of the encoding and of the attention.
WORDS, SLOT_BITS, LAGS, HIDDEN, ATTENTION = 48, 12, (1, 2, 3, 4), 16, 8
#: Characters of the end of a word's shape that are hashed.
END = 2
#: Passes over the sample, documents of a step, Adam's rate, decay of the hashed rows at each step (times the rate).
PASSES, STEP, RATE, DECAY = 8, 64, 0.01, 1.0
#: Bytes, and passages, that are worked on at once.
BYTES, PASSAGES = 1 << 22, 2048


def _classes() -> np.ndarray:
    """Kinds of bytes: small letters, capitals, digits, white space, other ASCII, bytes of other characters."""
    table = np.full(256, 4, np.uint8)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r")):
        table[list(chars)] = k
    table[128:] = 5
    return table


CLASSES, N_CLASSES, WHITE = _classes(), 6, 3
FEATURES = N_CLASSES + 2 + len(LAGS) + 1
#: Shapes of words: small letters (and those of other scripts) a, capitals A, digits 0, all else as it is.
SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
#: A document's passages: hashed words, their number, counts of each passage.
Bag = tuple[np.ndarray, np.ndarray]


def _kinds(texts: list[bytes], at: np.ndarray, first: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    """Bytes of each kind in each passage; what stands before a text's first word counts to its first passage."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = np.r_[0, ends[:-1]]
    hist, words, after_space = np.zeros(int(first[-1]) * N_CLASSES, np.int64), 0, True
    for s in range(0, len(raw), BYTES):
        part = CLASSES[raw[s : s + BYTES]]
        space = part == WHITE
        begin = ~space & np.r_[after_space, space[:-1]]
        number = words + np.cumsum(begin) - 1
        words, after_space = int(number[-1]) + 1, bool(space[-1])
        i, j = np.searchsorted(ends, s, "right"), np.searchsorted(starts, s + len(part))
        sizes = np.minimum(ends[i:j], s + len(part)) - np.maximum(starts[i:j], s)
        of_byte = np.repeat(first[i:j], sizes)
        led = number >= np.repeat(at[i:j], sizes)
        of_byte[led] = of_word[number[led]]
        hist += np.bincount(of_byte * N_CLASSES + part, minlength=len(hist))
    return hist.reshape(-1, N_CLASSES)


def _slots(texts: list[bytes], words: np.ndarray) -> np.ndarray:
    """Two slots of each word: of its hash and of the end of its shape."""
    from xxhash import xxh3_64_intdigest

    known: dict[bytes, int] = {}
    ends = [w[-END:] for t in texts for w in t.translate(SHAPE).split()]
    shapes = np.fromiter((known[e] if e in known else known.setdefault(e, xxh3_64_intdigest(e, 1)) for e in ends), np.uint64, len(ends))
    both = np.stack((words, shapes), axis=1)
    return (mixed(both) >> np.uint64(64 - SLOT_BITS)).astype(np.uint16)


def _passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all words, each text's first word, counts of each passage, each text's first passage (one more at the end of both).

    A text without words is one passage without any.
    """
    words, at = word_hashes(texts)
    n_words = np.diff(at)
    first = np.r_[0, np.cumsum(np.maximum((n_words + WORDS - 1) // WORDS, 1))]
    total = int(first[-1])
    doc = np.repeat(np.arange(len(texts)), n_words)
    of_word = first[doc] + (np.arange(len(words)) - at[doc]) // WORDS
    x = np.zeros((total, FEATURES), np.float32)
    count = np.maximum(np.bincount(of_word, minlength=total), 1)
    hist = _kinds(texts, at, first, of_word)
    size = np.maximum(hist.sum(axis=1), 1)
    x[:, :N_CLASSES] = np.sqrt(hist / size[:, None])
    x[:, N_CLASSES] = np.log1p(size / count) / 3
    x[:, N_CLASSES + 1] = np.minimum(count, WORDS) / WORDS
    for k, lag in enumerate(LAGS):
        same = (words[lag:] == words[:-lag]) & (doc[lag:] == doc[:-lag])
        x[:, N_CLASSES + 2 + k] = np.bincount(of_word[lag:][same], minlength=total) / count
    if len(words) > 2:
        g = grams(words, 3) ^ (doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        by = np.argsort(g, kind="stable")
        again = np.zeros(len(g), bool)
        again[by[1:]] = g[by][1:] == g[by][:-1]
        again &= doc[:-2] == doc[2:]
        x[:, -1] = np.bincount(of_word[:-2][again], minlength=total) / count
    return _slots(texts, words), at, x, first


def _features(texts: list[bytes]) -> list[bytes]:
    """A text's bag: its number of words, their slots, its passages' counts."""
    slots, at, x, first = _passages(texts)
    return [np.int64(b - a).tobytes() + slots[a:b].tobytes() + x[c:d].tobytes() for a, b, c, d in zip(at[:-1], at[1:], first[:-1], first[1:], strict=True)]


def _bag(raw: bytes) -> Bag:
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    return np.frombuffer(raw[8 : 8 + 4 * n], np.uint16).reshape(-1, 2), np.frombuffer(raw[8 + 4 * n :], np.float32).reshape(-1, FEATURES)


def _batch(bags: list[Bag]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bags side by side, as _passages() gives them."""
    return np.concatenate([s for s, _ in bags]), np.r_[0, np.cumsum([len(s) for s, _ in bags])], np.concatenate([x for _, x in bags]), np.r_[0, np.cumsum([len(x) for _, x in bags])]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, column by column: each row alone decides its product, to the last bit."""
    out = x[:, :1] * w[0]
    for k in range(1, len(w)):
        out += x[:, k : k + 1] * w[k]
    return out


def _words_of(at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each passage's first word and number of words."""
    n_pass = np.diff(first)
    doc = np.repeat(np.arange(len(n_pass)), n_pass)
    begin = at[doc] + (np.arange(first[-1]) - first[doc]) * WORDS
    return begin, np.minimum(at[doc + 1] - begin, WORDS)


def _encoded(p: dict[str, np.ndarray], slots: np.ndarray, at: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Encodings of passages: tanh of the mean of their words' rows of E (scaled by the root of their number), and of their counts by W."""
    begin, size = _words_of(at, first)
    h = np.empty((len(x), p["W"].shape[1]))
    for i in range(0, len(x), PASSAGES):
        z = _times(x[i : i + PASSAGES].astype(np.float64), p["W"]) + p["b"]
        some = np.flatnonzero(size[i : i + PASSAGES])
        if len(some):
            a = begin[i : i + PASSAGES][some]
            own = slots[a[0] : a[-1] + size[i + some[-1]]]
            z[some] += np.add.reduceat(p["E"][own[:, 0]] + p["E"][own[:, 1]], a - a[0]) / np.sqrt(size[i : i + PASSAGES][some])[:, None]
        h[i : i + PASSAGES] = np.tanh(z)
    return h


def _forward(p: dict[str, np.ndarray], slots: np.ndarray, at: np.ndarray, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Encoding, gated attention and score of bags whose passages start at first."""
    h = _encoded(p, slots, at, x, first)
    v, u = np.tanh(_times(h, p["V"])), _sigmoid(_times(h, p["U"]))
    e = _times(v * u, p["w"][:, None])[:, 0]
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    a = e / np.add.reduceat(e, first[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, first[:-1])
    return {"h": h, "v": v, "u": u, "a": a, "bag": bag, "z": z, "y": _sigmoid(_times(z, p["c"][:, None])[:, 0] + p["d"])}


def _gradients(p: dict[str, np.ndarray], slots: np.ndarray, at: np.ndarray, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(p, slots, at, x, first)
    dy = (f["y"] - labels) / len(labels)
    dz = (dy[:, None] * p["c"])[f["bag"]]
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[f["bag"]])
    dvu = de[:, None] * p["w"]
    dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
    dh = (f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
    size = _words_of(at, first)[1]
    of_word = np.repeat(np.repeat(dh / np.sqrt(np.maximum(size, 1))[:, None], size, axis=0), 2, axis=0)
    flat = slots.ravel()
    by = np.argsort(flat, kind="stable")
    ids, start = np.unique(flat[by], return_index=True)
    de_ = np.zeros_like(p["E"])
    if len(ids):
        de_[ids] = np.add.reduceat(of_word[by], start)
    return {"E": de_, "W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum()}


def _train(rows: list[bytes], labels: np.ndarray) -> bytes:
    """Adam over shuffled steps of whole bags."""
    rng = np.random.default_rng(0)
    p = {"E": np.zeros((1 << SLOT_BITS, HIDDEN)), "W": rng.normal(0, 0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.3, ATTENTION), "c": np.zeros(HIDDEN), "d": np.zeros(())}
    bags = [_bag(x) for x in rows]
    m, s, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(PASSES):
        turn = rng.permutation(len(bags))
        for i in range(0, len(turn), STEP):
            own = turn[i : i + STEP]
            t += 1
            for k, g in _gradients(p, *_batch([bags[j] for j in own]), labels[own]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                if k == "E":
                    p[k] = p[k] * (1 - RATE * DECAY)
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def _scorer(model: bytes):
    p = dict(np.load(io.BytesIO(model)))

    def score(texts: list[bytes]) -> np.ndarray:
        return _forward(p, *_passages(texts))["y"]

    return score


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, key: str = "doc_id", text: str = "text") -> bytes:
    """The model, fitted on at most `most` labelled documents outside the held-out fold. Without labels every score is 0.5."""
    return fitted(docs, labels, "quality", FOLDS, HELD, most, _features, _train, key, text)


def quality(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Every passage of a whole text counts; a null or empty text is one passage without words. Equal texts get equal
    scores to the last bit, repeated rows are repeated, a null key is not held out, other columns are not read, no rows give none.
    """
    return scored(docs, _scorer(model), FOLDS, HELD, THRESHOLD, key, text)


def without_poor(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns as they are."""
    return kept_where(docs, _scorer(model), lambda s: s >= THRESHOLD, text)
