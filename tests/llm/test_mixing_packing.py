"""Budgets against a plain water-filling, packing against the tokenizer."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colmeta.llm import mixing, packing
from colmeta.llm.queries import tokenizer_path


def _fill(total, caps, weights):
    """Budgets by weight with caps: what full nodes leave goes to the others."""
    out, open_ = {}, {k for k in caps if weights[k] > 0}
    out = dict.fromkeys(caps, 0.0)
    while open_:
        left = total - sum(out[k] for k in caps if k not in open_)
        w = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] <= left * weights[k] / w + 1e-12}
        if not full:
            for k in open_:
                out[k] = left * weights[k] / w
            break
        for k in full:
            out[k] = caps[k]
        open_ -= full
    return out


def _budgets(leaves, share, epochs, weights):
    """leaves: (domain, lang, source) to tokens."""
    out = {}

    def down(path, budget):
        kids = sorted({k[: len(path) + 1] for k in leaves if k[: len(path)] == path})
        caps = {k: epochs * sum(v for l, v in leaves.items() if l[: len(k)] == k) for k in kids}
        got = _fill(budget, caps, {k: weights(k) for k in kids})
        for k in kids:
            if len(k) == 3:
                out[k] = int(np.floor(got[k] + 1e-6))
            else:
                down(k, got[k])

    down((), share * sum(leaves.values()))
    return out


def test_budgets(spark):
    rng = np.random.default_rng(2)
    leaves = {(f"d{a}", l, f"s{b}"): int(rng.integers(1, 10 ** rng.integers(1, 5))) for a in range(3) for l in ("en", "de", "xx") for b in range(4)}
    base = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    by_lang = {"en": 3.0, "de": 2.0, "xx": 1.0}
    for share, epochs in ((1.0, 1), (0.5, 1), (1.0, 3), (2.5, 2), (0.01, 4)):
        got = mixing.leaf_budgets(base, share, epochs, mixing.node_weights())
        want = _budgets(leaves, share, epochs, lambda k: by_lang[k[1]] if len(k) == 2 else 1.0)
        for r in got.collect():
            assert abs(r.budget - want[(r.domain, r.lang, r.source)]) <= 1


def test_mixture(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id is not null")
    got = mixing.mixture(docs, share=1.2, max_epochs=3)
    base, plan = mixing.mixing_plan(docs, 1.2, 3)
    taken = {(r.domain, r.lang, r.source): r.t for r in got.groupBy("domain", "lang", "source").agg(F.sum("taken").alias("t")).collect()}
    for r in plan.collect():
        assert taken.get((r.domain, r.lang, r.source), 0) == r.budget
    by_leaf = defaultdict(list)
    for r in got.collect():
        assert 0 < r.taken <= r.tokens
        by_leaf[(r.domain, r.lang, r.source, r.epoch)].append(r.taken < r.tokens)
    assert all(sum(v) <= 1 for v in by_leaf.values())
    assert sorted(map(tuple, mixing.mixture(docs, 1.2, 3).collect())) == sorted(map(tuple, got.collect()))
    assert {(r.doc_id, r.epoch) for r in mixing.mixture(docs, 1.2, 3, seed=18).collect()} != {(r.doc_id, r.epoch) for r in got.collect()}
    assert mixing.mixture(no_docs).count() == 0
    assert mixing.mixture(odd_docs).count() > 0


def test_mixed_documents(spark, odd_docs):
    kept = mixing.mixed_documents(odd_docs, 0.5)
    assert kept.columns == odd_docs.columns
    assert 0 < kept.count() < odd_docs.count()
    plan = "".join(kept._jdf.queryExecution().executedPlan().toString())
    assert "Python" not in plan


@pytest.mark.parametrize("same_text", [True, False])
def test_rows_that_share_a_key_fill_the_budget_exactly(spark, same_text):
    """Most rows have no key: of those as many go as the budget holds, and no task has to take them all."""
    ten = lambda i: " ".join(f"w{0 if same_text else i}x{k}" for k in range(10))
    rows = [(None if i % 4 else i, ten(i), "en", "src1", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for share in (0.5, 0.503):
        want = int(4000 * share)
        assert mixing.mixture(docs, share, 1).agg(F.sum("taken")).first()[0] == want
        kept = mixing.mixed_documents(docs, share)
        assert want <= 10 * kept.count() < want + 10
    assert mixing.mixture(docs, 2.5, 3).agg(F.sum("taken")).first()[0] == 10_000


def test_domain(spark):
    got = spark.createDataFrame([("src7",), ("x",), ("",)], "s string").select(mixing.domain_of(F.col("s")).alias("d"))
    assert [r.d for r in got.collect()] == ["d3", "other", "other"]


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_tokenizers(hf):
    rng = np.random.default_rng(0)
    encode = packing.token_bytes(tokenizer_path())
    alphabet = list("ab Zé1.,'\n\t   　日😀<|>") + ["<|endoftext|>", "'s", "don't", "  "]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 14)))
        assert np.frombuffer(encode(text), "<u4").tolist() == hf.encode(text, add_special_tokens=False).ids, repr(text)


def _check(docs, hf, out):
    want = sorted((str(r.doc_id), np.array([*hf.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in docs)
    left = defaultdict(list)
    for k, ids in want:
        left[k].append(ids)
    pieces = defaultdict(list)
    for r in out:
        pieces[str(r.doc_id)].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for k, texts in left.items():
        expect = defaultdict(int)
        for ids in texts:
            expect[len(ids) // 4] += len(ids) // 4
        seen = defaultdict(int)
        for start, length, crc, n in pieces[k]:
            assert any(len(i) // 4 == n and zlib.crc32(i[4 * start : 4 * (start + length)]) == crc for i in texts)
            seen[n] += length
        assert seen == expect
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length, r.tier))
    for s in seqs.values():
        at = 0
        for offset, length, tier in sorted(s):
            assert offset == at
            at += length
        assert at == tier
        assert at & (at - 1) == 0
        assert at <= 1024
    return seqs


def test_packing(spark, hf, odd_docs, no_docs, monkeypatch):
    rows = odd_docs.collect()
    _check(rows, hf, packing.packed(odd_docs, tokenizer_path()).collect())
    monkeypatch.setattr(packing, "BUFFER", 700)
    _check(rows, hf, packing.packed(odd_docs, tokenizer_path()).collect())
    assert packing.packed(no_docs, tokenizer_path()).count() == 0
    named = odd_docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert packing.packed(named.where("false"), tokenizer_path()).count() == 0


def test_steps_are_even(spark, sf_dir):
    out = packing.packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
    loads = sorted(r["sum(length)"] for r in out.groupBy("step_id").agg(F.sum("length")).collect())
    assert loads[-1] <= packing.STEP_TOKENS + 1024
    assert loads[-1] - loads[0] <= 2048
