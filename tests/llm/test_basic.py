"""Exact dedup, mixing and packing against brute force, with the edge cases of their docstrings."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, "a b  c", "en", "s1", 6), (2, None, "en", None, None), (3, "", None, "s1", 0), (4, "a b  c", "en", "s2", 6), (4, "a b  c", "en", "s2", 6),
    (5, "a b c", "en", "s2", 5), (6, "x" * 5000, "en", "s3", 5000), (7, "w\tw\n" * 4000, "en", "s3", 16000), (None, "nil", "en", "s1", 3), (8, "é è", "fr", "", 3),
]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, edge, keep):
    from skein.llm.exact_dedup import exact_groups

    got = sorted(map(tuple, exact_groups(edge, keep, fan_in=2).collect()), key=str)
    groups = defaultdict(list)
    for r in EDGE:
        groups[r[1] or ""].append(r[0])
    want = []
    for r in EDGE:
        ids = [i for i in groups[r[1] or ""] if i is not None]
        k = (min(ids) if keep == "smallest" else max(ids)) if ids else None
        want.append((r[0], k, len(groups[r[1] or ""]), r[0] == k, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_plan_merges_in_rounds(spark, edge):
    from skein.llm.exact_dedup import digests, tree_merge

    plan = tree_merge(digests(edge), fan_in=2)._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") >= 4  # the first run and three rounds for 8 places


def test_empty_tables(spark):
    from skein.llm.exact_dedup import exact_groups
    from skein.llm.mixing import mix
    from skein.llm.packing import pack

    none = spark.createDataFrame([], DOCS)
    assert exact_groups(none).count() == 0 and mix(none).count() == 0
    import public_tokenizers

    assert pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def brute_targets(sizes, cycle=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    cap, target = {s: most * sizes[s] for s in names}, {}
    free, budget = list(names), share * sum(sizes.values())
    while free:
        level = budget / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > cap[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = cap[s]
            budget -= cap[s]
        free = [s for s in free if s not in over]
    return target


def test_mix_edge(spark, edge):
    from skein.llm.mixing import mix

    rows = mix(edge).collect()
    sizes = defaultdict(int)
    for r in EDGE:
        sizes[r[3]] += len(words(r[1]))
    target, taken = brute_targets(sizes), defaultdict(int)
    assert len(rows) == len(EDGE)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mix(edge.repartition(5)).collect()))


def test_water_fill_random(spark):
    """Closed form against clamping step by step, for many shapes of sizes; sizes of 0 among them."""
    import random

    from skein.llm.mixing import water_fill

    rng = random.Random(2)
    for k in range(6):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 100, 1000, 100_000]) * rng.randint(1, 9) for i in range(rng.randint(1, 14))} | {None: 7, "Z": 3, "é": 50}
        share = rng.choice([0.3, 1.5, 1.9, 2.0])
        got = {r.source: r.target for r in water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), share=share).collect()}
        want = brute_targets(sizes, share=share)
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in sizes)
        assert abs(sum(got.values()) - share * sum(sizes.values())) <= 1e-6 * sum(sizes.values())


def test_mix_table(spark):
    from skein.llm.queries import op7_source_mix

    rows = op7_source_mix(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in docs.values():
        sizes[r.source] += len(words(r.text))
    target = brute_targets(sizes)
    for r in rows:
        s = docs[r.doc_id].source
        taken[s] += r.taken
        assert r.size == len(words(docs[r.doc_id].text)) and r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
    assert len(rows) == len(docs) and all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


def test_mix_plan_is_native(spark, sf):
    from skein.llm.queries import op7_source_mix

    plan = op7_source_mix(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = brute_ids.t = getattr(brute_ids, "t", None) or Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(rows, texts):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = brute_ids(texts[d]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


def test_pack(spark, sf, edge):
    import public_tokenizers

    from skein.llm.packing import pack
    from skein.llm.queries import documents, op9_pack

    check_pieces(op9_pack(spark, sf).collect(), {r.doc_id: r.text for r in documents(spark, sf).collect()})
    once = edge.where("doc_id <> 4 or doc_id is null").unionByName(edge.where("doc_id = 4").limit(1))
    check_pieces(pack(once, public_tokenizers.path("word_bpe_49k.json")).collect(), {r[0]: r[1] for r in EDGE})


def test_sum_of_squares_levels():
    """The level array counts the open windows, and every step takes a cheapest place."""
    from skein.llm.packing import SumOfSquares

    rng, p = np.random.default_rng(1), SumOfSquares(16)
    for k in range(500):
        s = int(rng.integers(1, 16))
        before = p.level.copy()
        options = []
        for h in range(17 - s):
            if h and not before[h]:
                continue
            x = before.copy()
            x[h] -= h > 0
            if h + s < 16:
                x[h + s] += 1
            options.append(int((x**2).sum()))
        p.place((k, 0, s))
        assert int((p.level**2).sum()) == min(options)
        assert all(len(v) == p.level[h] for h, v in p.open.items())


def test_without_copies_drops_rows_not_ids(spark):
    """An id given with two texts, one of them a copy of another document, keeps the other text; null is the empty text."""
    from skein.llm.exact_dedup import without_copies

    rows = [(1, "a"), (2, "a"), (2, "b"), (2, "b"), (3, ""), (3, None), (None, "a"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text or "") for r in without_copies(docs).collect()), key=str)
    assert got == sorted([(1, "a"), (2, "b"), (3, ""), (None, "c")], key=str)


def test_quality_votes_equal_a_plain_vote():
    """Neighbours by cosine one at a time, their labels weighted by similarity."""
    import numpy as np
    import pyarrow as pa

    from skein.llm import quality
    from skein.llm.common import text_arrays

    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words[:40] if k % 2 else words[20:], rng.integers(1, 40))) for k in range(260)]
    x = quality.features(*text_arrays(pa.array(texts)))
    m = quality.fit(x[:200], np.arange(200) % 2)
    got = m.scores(quality.features(*text_arrays(pa.array([*texts[200:], "", None]))))
    latent = m.latent(x[200:])
    for z, score in zip(latent, got, strict=False):
        cos = sorted(((float(z @ v), n) for n, v in enumerate(m.vectors)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(c, 1e-6) ** quality.SHARPNESS for c, _ in cos]
        assert abs(score - sum(w * m.labels[n] for w, (_, n) in zip(weight, cos, strict=True)) / sum(weight)) < 1e-4
    assert got[-1] == got[-2] == m.prior
