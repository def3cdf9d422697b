"""Toxicity and quality: held-out accuracy and odd rows."""

import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from colmeta.llm import fitting, quality, toxicity
from colmeta.llm.words import PLAIN, grams, mixed

BAD = [f"bad{i}" for i in range(12)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(800)]
    docs, labels = [], []
    for i in range(1600):
        t = list(rng.choice(words, rng.integers(20, 150)))
        toxic, good = i % 6 == 0, i % 5 != 0
        if toxic:
            for _ in range(3):
                t.insert(rng.integers(len(t)), f"{rng.choice(BAD)},")
        if not good:
            t = [w.upper() + "!!" for w in t] if i % 2 else [w + "***" for w in t]
        docs.append((i, " ".join(t), "en", "s", 1))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "run", "target", "folds", "held"), [(toxicity, toxicity.toxicity, "toxic", 4, 2), (quality, quality.quality, "quality", 5, 0)])
def test_held_out(labelled, odd_docs, no_docs, module, run, target, folds, held):
    docs, labels = labelled
    model = module.fit(docs, labels)
    got = {r.doc_id: r for r in run(docs, model).collect()}
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % folds == held)
        assert r.predicted == int(r.score >= 0.3)
        assert 0 <= r.score <= 1
    own = [(got[r.doc_id].predicted, r[target]) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(own) > 200
    assert np.mean([a == b for a, b in own]) > 0.97
    assert module.fit(docs, labels) == model
    odd = run(odd_docs, model).collect()
    assert len(odd) == odd_docs.count()
    assert len({r.score for r in odd if r.doc_id in (0, 1)}) == 1
    assert run(no_docs, model).count() == 0
    empty = module.fit(docs, labels.where("false"))
    assert {r.score for r in run(odd_docs, empty).collect()} == {0.5}
    assert module.fit(docs, labels, most=50) != model


def test_the_model_sees_only_its_folds(labelled):
    docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_scores_do_not_depend_on_neighbours():
    texts = [b"", b" \n", b"one two", b"", b"  lead and trail  ", b"x " * 500, b""]
    for f in (quality._features, toxicity._features):
        assert f(texts) == [f([t])[0] for t in texts]


def _model(rng, hidden=4, attention=3):
    return {"E": rng.normal(0, 0.5, (1 << quality.SLOT_BITS, hidden)), "W": rng.normal(0, 0.5, (quality.FEATURES, hidden)), "b": rng.normal(0, 1, hidden), "V": rng.normal(0, 1, (hidden, attention)), "U": rng.normal(0, 1, (hidden, attention)), "w": rng.normal(0, 1, attention), "c": rng.normal(0, 1, hidden), "d": np.array(0.1)}


TEXTS = [b"", b" \n", b"one two", b"ONE, two %% 3 two two two " * 30, "größer als é".encode() * 20, b"x " * 500, b"  lead and trail  ", b"a b c a b c a b c " * 9]


def _plain_quality(p, text):
    """A document's score by loops over its passages, words and bytes."""
    from xxhash import xxh3_64_intdigest

    words = text.split()
    parts = [words[i : i + quality.WORDS] for i in range(0, len(words), quality.WORDS)] or [[]]
    slot = lambda h: int(mixed(np.array([h], np.uint64))[0]) >> (64 - quality.SLOT_BITS)
    lower = [w.lower() for w in words]
    spans = [m.span() for m in re.finditer(rb"[^ \t\n\v\f\r]+", text)]
    h = []
    for i, part in enumerate(parts):
        a, n = i * quality.WORDS, len(part)
        begin = spans[a][0] if i else 0
        end = spans[a + n][0] if a + n < len(spans) else len(text) + 1
        raw = (text + b"\n")[begin:end]
        kinds = [len(re.findall(c, raw)) for c in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[ \t\n\v\f\r]", rb"[!-/:-@[-`{-~\x00-\x08\x0e-\x1f\x7f]", rb"[\x80-\xff]")]
        size, count = max(sum(kinds), 1), max(n, 1)
        x = [np.sqrt(k / size) for k in kinds] + [np.log1p(size / count) / 3, min(count, quality.WORDS) / quality.WORDS]
        x += [sum(j >= lag and lower[j] == lower[j - lag] for j in range(a, a + n)) / count for lag in quality.LAGS]
        x += [sum(lower[j : j + 3] in [lower[k : k + 3] for k in range(j)] for j in range(a, a + n) if j + 3 <= len(lower)) / count]
        z = sum(v * w for v, w in zip(np.float32(x).astype(float), p["W"], strict=True)) + p["b"]
        for w in part:
            shape = re.sub(rb"[0-9]", b"0", re.sub(rb"[A-Z]", b"A", re.sub(rb"[a-z\x80-\xff]", b"a", w)))
            z = z + (p["E"][slot(xxh3_64_intdigest(w.lower()))] + p["E"][slot(xxh3_64_intdigest(shape[-quality.END :], 1))]) / np.sqrt(n)
        h.append(np.tanh(z))
    gate = [np.dot(np.tanh(x @ p["V"]) / (1 + np.exp(-(x @ p["U"]))), p["w"]) for x in h]
    weigh = np.exp(gate) / np.exp(gate).sum()
    return 1 / (1 + np.exp(-(sum(a * x for a, x in zip(weigh, h, strict=True)) @ p["c"] + p["d"])))


def test_quality_by_plain_loops():
    p = _model(np.random.default_rng(3))
    got = quality._forward(p, *quality._passages(TEXTS))["y"]
    assert got == pytest.approx([_plain_quality(p, t) for t in TEXTS], abs=1e-6)


def test_quality_does_not_depend_on_neighbours(monkeypatch):
    rng = np.random.default_rng(4)
    p, texts = _model(rng), TEXTS + [b" ".join(rng.choice(TEXTS[3].split(), n)) for n in (1, 47, 48, 49, 700, 5000)]
    together = quality._forward(p, *quality._passages(texts))["y"]
    for size, most in ((1 << 22, 2048), (50, 3)):
        monkeypatch.setattr(quality, "BYTES", size)
        monkeypatch.setattr(quality, "PASSAGES", most)
        alone = [float(quality._forward(p, *quality._passages([t]))["y"][0]) for t in texts]
        assert alone == together.tolist()


def test_gradients():
    p = _model(np.random.default_rng(0))
    bags, y = quality._passages(TEXTS), np.array([1, 0, 0, 1, 1, 0, 1, 0])

    def loss():
        s = quality._forward(p, *bags)["y"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, g in quality._gradients(p, *bags, y).items():
        at = tuple(0 for _ in p[k].shape) if k != "E" else (int(bags[0][0, 1]), 0)
        was = p[k][at].copy()
        p[k][at] = was + 1e-6
        up = loss()
        p[k][at] = was - 1e-6
        down = loss()
        p[k][at] = was
        assert (up - down) / 2e-6 == pytest.approx(float(np.asarray(g)[at]), abs=1e-5)


def _plain_ftrl(rows, labels):
    """FTRL-proximal, one feature at a time, over the same order of rows."""
    import math

    docs = Counter(s for x in rows for s in set(x))
    z, n, bias = {}, {}, [0.0, 0.0]

    def weight(z, n, l1):
        return 0.0 if abs(z) <= l1 else (math.copysign(l1, z) - z) / ((toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA + toxicity.L2)

    for turn in range(toxicity.PASSES):
        for i in np.random.default_rng(turn).permutation(len(rows)).tolist():
            own = sorted(s for s in rows[i] if docs[s] >= toxicity.LEAST_DOCS)
            w = {s: weight(z.get(s, 0.0), n.get(s, 0.0), toxicity.L1) for s in own}
            b = weight(*bias, 0.0)
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()) + b)))) - labels[i]
            for s in own:
                was = n.get(s, 0.0)
                z[s] = z.get(s, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / toxicity.ALPHA * w[s]
                n[s] = was + g * g
            bias = [bias[0] + g - (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / toxicity.ALPHA * b, bias[1] + g * g]
    return {s: w for s in z if (w := weight(z[s], n[s], toxicity.L1))}, weight(*bias, 0.0)


def _plain_slots(text):
    """Slots of a text's words, stems, pairs and pairs around a word."""
    from xxhash import xxh3_64_intdigest

    words = text.translate(PLAIN).split()
    one = lambda h: int(mixed(np.array([h], np.uint64))[0]) >> 32
    h = [xxh3_64_intdigest(w) for w in words]
    pair = lambda a, b: int(grams(np.array([a, b], np.uint64), 2)[0])
    out = {one(x) for x in h} | {one(xxh3_64_intdigest(w[:n]) ^ n) for w in words for n in toxicity.STEMS}
    out |= {pair(a, b) >> 32 for a, b in zip(h, h[1:], strict=False)}
    return out | {(pair(a, b) * 3 % 2**64) >> 32 for a, b in zip(h, h[2:], strict=False)}


def test_toxicity_by_plain_loops():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(160):
        own = list(rng.choice(words, rng.integers(0, 30))) + (["vile", "Vilest,"] if i % 4 == 0 else [])
        rng.shuffle(own)
        texts.append(" ".join(own).encode())
        labels.append(int(i % 4 == 0))
    rows = [_plain_slots(t) for t in texts]
    assert [set(np.frombuffer(x, np.uint32).tolist()) for x in toxicity._features(texts)] == rows
    weights, bias = _plain_ftrl(rows, labels)
    model = toxicity._train(toxicity._features(texts), np.array(labels))
    got = np.load(io.BytesIO(model))
    assert len(weights) > 3
    assert dict(zip(got["slots"].tolist(), got["weights"].tolist(), strict=True)) == pytest.approx(weights)
    want = [1 / (1 + np.exp(-(sum(weights.get(s, 0.0) for s in x) + bias))) for x in rows]
    assert toxicity._scorer(model)(texts) == pytest.approx(want)


def test_features_have_a_bound(labelled, monkeypatch):
    docs, labels = labelled
    whole = toxicity.fit(docs, labels)
    monkeypatch.setattr(fitting, "FEATURE_BYTES", 100_000)
    assert toxicity.fit(docs, labels) != whole


def test_stages_keep_columns(labelled, odd_docs):
    docs, labels = labelled
    for kept, run in ((toxicity.without_toxic, toxicity), (quality.without_poor, quality)):
        model = run.fit(docs, labels)
        assert kept(odd_docs, model).columns == odd_docs.columns
        assert kept(docs, model).count() < docs.count()
