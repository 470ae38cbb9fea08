"""Repeated passages against brute force over all strings of 50 bytes."""

from __future__ import annotations

import hashlib
import random

import numpy as np


def brute(rows, span=50):
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for p in range(len(b) - span + 1):
            first.setdefault(b[p : p + span], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for p in range(len(b) - span + 1):
                if first[b[p : p + span]] < i:
                    gone[p : p + span] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_table(spark):
    from skein.llm.queries import documents, op10_suffix_dedup

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        want = brute([(r.doc_id, r.text) for r in documents(spark, sf).select("doc_id", "text").collect()])
        assert sorted((tuple(r) for r in op10_suffix_dedup(spark, sf).collect()), key=str) == want
        assert sum(r[2] > 0 for r in want) > 10


def test_planted(spark):
    from skein.llm.suffix_dedup import repeated_passages

    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "é", "ö", "zeta ", "eta\n", "θ", "0123"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(n))
    passage, period = text(40), "Shti " * 400
    rows = [(i, text(rng.randint(0, 30)) + (passage if i % 3 else passage[3:30]) + text(rng.randint(0, 30))) for i in range(60)]
    rows += [(100 + i, period[: 300 + 17 * i]) for i in range(8)] + [(200, "x" * 49), (201, "x" * 49), (202, "x" * 50), (203, "x" * 50), (204, "x" * 500)]
    rows += [(300, None), (301, ""), (None, passage), (302, passage), (302, passage), (50_000_000_000, text(20) + passage), (-5, "neg " + passage)]
    # Ids with several texts: each text is a document of its own, and none takes from another of its id.
    rows += [(400, text(25) + passage), (400, text(60)), (401, rows[0][1] + passage), (401, text(5) + passage + text(5)), (402, p2 := text(50)), (402, "x" + p2), (403, "yy" + p2), (403, text(44))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, starts string").repartition(5)
    got = sorted((tuple(r) for r in repeated_passages(df).collect()), key=str)
    assert got == brute(rows)
    assert repeated_passages(df.limit(0)).count() == 0


def test_kept_texts(spark):
    from skein.llm.suffix_dedup import repeated_passages

    p = "the same passage of more than fifty bytes in both of them, surely"
    got = {r.doc_id: r.kept for r in repeated_passages(spark.createDataFrame([(1, "a " + p), (2, "b" + p + "!")], "doc_id long, text string"), texts=True).collect()}
    assert got[1] is None and bytes(got[2]) == b"b!"


def test_loser_tree_and_front_coding():
    from skein.llm.suffix_dedup import front_code, front_decode, merge

    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 7, 16):
        runs, plain = [], []
        for _ in range(k):
            n = int(rng.integers(0, 40))
            rows = rng.integers(0, 3, (n, 6)).astype(np.uint8)
            rows = rows[np.lexsort(rows.T[::-1])] if n else rows
            shared, rest = front_code(rows)
            assert (front_decode(shared, rest, 6) == rows).all()
            runs.append(([int.from_bytes(r.tobytes()) for r in rows], shared.tolist()))
            plain += [r.tobytes() for r in rows]
        got = list(merge(runs, 6))
        strings = [runs[r][0][i].to_bytes(6) for r, i, _ in got]
        assert strings == sorted(plain)
        for (_, _, s), a, b in zip(got[1:], strings, strings[1:], strict=False):
            assert s == next((n for n in range(6) if a[n] != b[n]), 6)


def test_anchors_in_pieces(monkeypatch):
    """Texts longer than a piece, a periodic one among them: every string has the same anchor as when looked at whole."""
    from skein.llm import suffix_dedup as sd

    rng = np.random.default_rng(8)
    data = np.concatenate([rng.integers(97, 123, 3000), np.tile([1, 2, 3, 4, 5], 900), rng.integers(97, 100, 2000)]).astype(np.uint8)
    off = np.array([0, 40, 2900, 2900, 9400, len(data)])

    def places():
        return sorted((int(r), int(s), int(p), int(g)) for r, p, a, b, g in zip(*sd.anchors(data, off), strict=True) for s in range(a, b + 1))

    whole = places()
    monkeypatch.setattr(sd, "PIECE", 700)
    assert places() == whole and len(whole) == sum(max(0, b - a - sd.SPAN + 1) for a, b in zip(off[:-1], off[1:], strict=True))
