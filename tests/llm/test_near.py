"""Near-dedup against all pairs by brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent=80):
    sets = [(i, shingles(t, width)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    where = {}
    for i, s in sets:
        for x in s:
            where.setdefault(x, []).append(i)
    by_id = dict(sets)
    for i, s in sets:
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & by_id[j])
            if 100 * both >= percent * (len(s) + len(by_id[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(s), root(i)) for i, s in sets}


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id), r


def test_documents(spark):
    from skein.llm.queries import documents, op3_near_dedup

    sf = "/root/testdata/sf0.01"
    want = brute([(r.doc_id, r.text) for r in documents(spark, sf).select("doc_id", "text").collect()], 4)
    check(op3_near_dedup(spark, sf).collect(), want)
    assert len({c for _, c in want.values()}) < len(want)


def test_large_groups_and_edges(spark):
    """A group larger than any node limit, chains at the threshold, shared passages, short and blank texts."""
    from skein.llm.chosen_path import near_groups

    rng = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    base, passage = rng.choices(words, k=120), rng.choices(words, k=40)
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    for i in range(120, 220):
        rows.append((i, " ".join(rng.choices(words, k=60) + passage)))
    chain = rng.choices(words, k=100)
    for i in range(220, 250):
        chain = chain[3:] + rng.choices(words, k=3)
        rows.append((i, " ".join(chain)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One two"), (304, "one  TWO"), (305, "one"), (306, "é\xa0b c d e f g"), (307, "x y " * 9000), (308, "x y " * 9001)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(6)
    check(near_groups(docs, width=5).collect(), brute(rows, 5))


def test_null_ids_repeats_and_empty(spark):
    from skein.llm.chosen_path import near_groups

    t = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(5, t, None, None, None), (5, t, None, None, None), (None, t, None, None, None), (None, None, None, None, None)], DOCS)
    got = sorted((tuple(r) for r in near_groups(docs).collect()), key=str)
    assert got == sorted([(5, 5, 5, True), (5, 5, 5, True), (None, 5, 5, False), (None, 0, None, True)], key=str)
    assert near_groups(spark.createDataFrame([], DOCS)).count() == 0


def meetings(pairs, depth, shared=0.0, worst=False):
    """How many of some pairs at the threshold meet in a node of the deep trees at that depth, where all nodes above stay large.

    shared: the share of its tokens that every document has in common with the first members of its nodes; worst: the pair differs in the other tokens only.
    """
    from skein.llm import chosen_path as cp

    similarity = 0.8
    rng = np.random.default_rng(5)
    a, other, *hubs = rng.integers(0, 1 << 32, (2 + cp.HUBS, pairs, cp.TOKENS), dtype=np.uint32)
    common = rng.random(a.shape) < shared
    hub = np.stack([np.where(common, a, h) for h in hubs], 1)
    differ = rng.random(a.shape) < (1 - similarity) / ((1 - shared) if worst else 1)
    b = np.where(differ & ~common if worst else differ, other, a)
    sig = [x.tobytes() for x in np.concatenate([a, b])]

    def rows(doc, **more):
        c = {"doc": pa.array(doc), "comp": pa.array(doc), "sig": pa.array([sig[d] for d in doc], pa.binary())} | {k: pa.array(v) for k, v in more.items()}
        return iter([pa.RecordBatch.from_arrays(list(c.values()), names=list(c))])

    met = set()
    for tree in range(cp.FIRST_TREES, cp.FIRST_TREES + cp.TREES):
        doc = np.array([d for d in range(2 * pairs) if d % pairs not in met], int)
        if not len(doc):
            break
        out = pa.Table.from_batches(list(cp._branches(similarity, range(tree, tree + 1), 2)(rows(doc))))
        for level in range(2, depth + 1):
            node, doc, used = (out.column(c).to_numpy() for c in ("node", "doc", "used"))
            # Only nodes with both of a pair matter.
            _, at, n = np.unique(np.stack([node, doc % pairs]), axis=1, return_inverse=True, return_counts=True)
            both = n[at.ravel()] > 1
            node, doc, used = node[both], doc[both], used[both]
            if level == depth or not len(doc):
                break
            hubs = pa.array([hub[d % pairs].tobytes() for d in doc], pa.binary())
            out = pa.Table.from_batches(list(cp._deeper(similarity, 1 if level == 2 else cp.REPEATS)(rows(doc, node=node, used=used, hub_comps=pa.array([np.full(cp.HUBS, -1).tobytes()] * len(doc), pa.binary()), hub_sigs=hubs))))
            # Guests of one first member are compared with each other.
            guests = out.filter(pa.compute.is_valid(out.column("guest_of"))).column("doc").to_numpy()
            own, times = np.unique(np.unique(guests) % pairs, return_counts=True)
            met |= set(own[times > 1].tolist())
            out = out.filter(pa.compute.is_null(out.column("guest_of")))
        met |= set((doc % pairs).tolist())
    return len(met)


def test_deep_trees_find_pairs_without_the_first():
    assert meetings(6000, 2) == 6000


def test_deep_trees_find_pairs_whose_nodes_stay_large():
    """Nodes of documents that share nothing else with the hubs, or up to 0.6 of their tokens, down to depth 3, and down to 5 and 8 although hubs still share as much: 0.999 there."""
    assert meetings(3000, 3) == meetings(3000, 5) == meetings(3000, 8) == 3000
    for shared in (0.33, 0.6):
        assert meetings(3000, 3, shared) == 3000 and meetings(3000, 5, shared) >= 2997
    assert meetings(3000, 3, 0.6, worst=True) >= 2997


def test_short_copies_of_a_passage_in_many_longer_texts(spark):
    """Short near copies made mostly of a passage that many longer documents also carry, beside brute force."""
    from skein.llm.chosen_path import near_groups

    rng = random.Random(11)
    words = [f"w{i}" for i in range(20_000)]
    rows = []
    for _ in range(12):
        passage = rng.choices(words, k=60)
        rows += [" ".join(rng.choices(words, k=60) + passage + rng.choices(words, k=40)) for _ in range(150)]
        for _ in range(4):
            own = rng.choices(words, k=6)
            rows += [" ".join([*own, *passage, *rng.choices(words, k=n)]) for n in (2, 6)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(6)
    check(near_groups(docs, width=4).collect(), brute(rows, 4))
