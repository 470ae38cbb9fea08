"""LM scoring: the base score by brute force, the model's sums, and its gain over each predictor alone."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

DOCS = "doc_id long, text string, lang string"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute_base(rows):
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return [(i, held[i], len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]


def check(got, want):
    got, want = sorted(got, key=lambda r: (str(r[0]), r[2], r[5])), sorted(want, key=lambda r: (str(r[0]), r[2], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert tuple(g[:5]) == w[:5] and abs(g.base_score - w[5]) <= 1e-9 * max(1, abs(w[5]))
        assert g.score <= 0 and math.isfinite(g.score) and g.bits_per_byte > 0


def test_table(spark):
    from skein.llm.queries import documents, op1_lm_score

    sf = "/root/testdata/sf0.01"
    got = op1_lm_score(spark, sf).collect()
    check(got, brute_base([(r.doc_id, r.text) for r in documents(spark, sf).select("doc_id", "text").collect()]))
    held = [r for r in got if r.held_out]
    bits = -sum(r.score for r in held) * math.log2(10) / sum(r.n_bytes for r in held)
    assert bits < 3.2  # eight would be no model; byte frequencies alone take over four


def test_edges(spark, monkeypatch):
    from skein.llm import context_mixing as lm

    rows = [(1, "The cat. the CAT sat"), (1, "The cat. the CAT sat"), (2, None), (3, ""), (None, "the end"), (4, "x" * 200_000), (5, "é " * 3000), (6, "only here" * 3), (12, "the"), (7, "\t\n "), (17, "cat sat"), (20, "the é")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS).repartition(4)
    check(lm.score_documents(df).collect(), brute_base(rows))
    monkeypatch.setattr(lm, "TOP", 2)  # most tokens take the way through the buckets
    check(lm.score_documents(df).collect(), brute_base(rows))
    assert lm.score_documents(df.limit(0)).count() == 0
    none = df.where("doc_id = 12") if zlib.crc32(b"12") % 7 == 2 else df.where("doc_id = 17")
    assert none.count() == 1


def test_probabilities_add_up():
    """Over all symbols of a decision tree, in any context, the model's probabilities add up to one."""
    from skein.llm import context_mixing as lm

    rng = np.random.default_rng(0)
    code = lm.huffman(rng.integers(0, 1000, 256), 0)
    mixer = lm.Mixer(rng.normal(size=(lm.GATES, 1 + len(lm.TABLE_BITS))), None, None, None)
    refined = np.sort(rng.normal(size=(lm.GATES, lm.MAP_BUCKETS)), 1).astype(np.float32).ravel()
    st = {n: [float(x) for x in rng.normal(size=len(lm.TABLE_BITS))] for n in range(256)}
    total = 0.0
    for symbol in range(256):
        p = 1.0
        for k in range(code.offset[symbol], code.offset[symbol] + code.length[symbol]):
            node = int(code.node[k])
            gate = np.array([node * 4])
            x = mixer.mixed(gate, [np.array([s]) for s in st[node]])
            low, part = lm.Mixer.place(x)
            at = gate * lm.MAP_BUCKETS + low
            x = 0.5 * (x + refined[at] * (1 - part) + refined[at + 1] * part)
            p *= float(1 / (1 + np.exp(-x if code.bit[k] else x))[0])
        total += p
    assert abs(total - 1) < 1e-9


def test_whole_token_sequences_score_alike_anywhere():
    """A document's score does not depend on what shares its run."""
    from skein.llm import context_mixing as lm
    from skein.llm.common import text_arrays

    codes = lm.Codes(np.sort(np.array([lm.END], np.uint64)), lm.huffman(np.array([5, 5]), 256), np.empty(0, np.uint64), lm.huffman(np.ones(256), 0))
    rng = np.random.default_rng(1)
    tables = [rng.integers(0, 256, 1 << b).astype(np.uint8) for b in lm.TABLE_BITS]
    fresh = lm.Mixer.new()
    fresh.all, fresh.ones = np.zeros(lm.GATES * lm.MAP_BUCKETS), np.zeros(lm.GATES * lm.MAP_BUCKETS)
    m = lm.Model(codes, tables, fresh.weights, fresh.refined(), 0, 0)
    texts = ["a few words", "", "other words, a few", "x", None, "a few words"]
    both = m.score(lm.tokens_of(*text_arrays(pa.array(texts))))[0]
    alone = [m.score(lm.tokens_of(*text_arrays(pa.array([t], pa.string()))))[0][0] for t in texts]
    assert np.allclose(both, alone) and both[0] == both[5]


def test_tail_tokens_have_contexts(spark, monkeypatch):
    """Beyond the TOP most frequent tokens, held-out words in an order that training has seen are likelier than the same words in another."""
    from skein.llm import context_mixing as lm

    monkeypatch.setattr(lm, "TOP", 300)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 60)) for _ in range(300)]
    held = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    free = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [*zip(free, texts + texts[:150], strict=False), *((i, t) for i, t in zip(held, texts[:40], strict=False)), *((i, " ".join(rng.permutation(t.split()))) for i, t in zip(held[40:], texts[:40], strict=False))]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS).repartition(4)
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score_documents(df).collect()}
    same, other = (sum(got[i] for i in ids) / 40 for ids in (held[:40], held[40:80]))
    assert same > other + 1
