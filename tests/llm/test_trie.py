"""The prefix trie against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            own.setdefault(c, []).append((t is not None, t or 0, digest, (r, x)))
    own = {c: [v[-1] for v in sorted(s)] for c, s in own.items()}
    seqs = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seqs[c] = tuple(own.get(base, [])[:h] + s[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, m in members.items():
        cost = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += cost
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **kw):
    from skein.llm.prefix_trie import conversation_trie

    out = conversation_trie(df, **kw)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, n int, gid string, digests string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("group_turns", [1_000_000, 40, 1])
def test_shared_prefixes(spark, group_turns):
    """A hot first turn, long shared chains, one conversation a third are copies of, and one being the start of others."""
    rng, rows = random.Random(3), []
    for c in range(0, 3000, 5):
        kind = rng.random()
        if kind < 0.35:
            turns = ["hello", "same", "copy"]
        elif kind < 0.7:
            turns = ["hello"] * 1 + ["long"] * 12 + [f"t{rng.randint(0, 4)}" for _ in range(rng.randint(0, 6))]
        else:
            turns = [f"s{rng.randint(0, 9)}{'é' * rng.randint(0, 2)}" for _ in range(rng.randint(1, 8))]
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(turns)]
    assert got(frame(spark, rows), group_turns=group_turns) == brute(rows)


def test_edges(spark):
    rows = [
        (0, 0, "user", "a"), (0, None, "system", None), (0, 1, None, "b"), (1, 0, None, None), (1, 0, None, None), (2, 5, "user", "x" * 200_000), (2, 6, "user", ""), (-3, 0, "user", "a"), (-100, 0, "u", "z"), (-101, 0, "user", "😀é"),
        (None, 0, "user", "lost"), (205, 0, "ab", "c"), (305, 0, "a", "bc"), (7, 0, "user", "tie"), (7, 0, "user", "other"), (9223372036854775807, 0, "user", "a"), (450, 3, "u", "1"), (450, 2, "u", "1"),
    ]
    assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, rows), group_turns=1) == brute(rows)
    assert got(frame(spark, [])) == []


def test_a_conversation_without_turns_is_at_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "only")]  # its head is to come from conversation 100, which is not there
    want = brute(rows)
    assert len(want) == 1 and want[0][1] == 0 and got(frame(spark, rows)) == want


def test_no_task_reads_all_of_a_hot_first_turn(spark):
    """2,000 different conversations below one first turn: each part built in one place stays small."""
    from skein.llm import prefix_trie

    seen = spark.sparkContext.accumulator(0)
    rows = [(c, t, "user", "hello" if t == 0 else f"{c * t % 97}-{t}") for c in range(2000) for t in range(4)]
    old = prefix_trie._tries

    def counted(pdf):
        seen.add(1 if len(pdf) > 200 else 0)
        return old(pdf)

    prefix_trie._tries = counted
    try:
        assert got(frame(spark, rows), group_turns=100) == brute(rows)
    finally:
        prefix_trie._tries = old
    assert seen.value <= 8
