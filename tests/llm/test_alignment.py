"""Token alignment against both tokenizers used plainly."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Ids and bytes of both tokenizers, by their own libraries and whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    with open(A, encoding="utf-8") as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in printable} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in printable)}

    def encode(text):
        i, j = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        x = [bytes(chars[c] for c in names[t]) for t in i]
        y = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in j]
        whole = (" " + text).encode()
        return ((i, x), (j, y)) if b"".join(x) == whole == b"".join(y) else (([], []), ([], []))

    return encode


def brute(encode, texts):
    found, held = [], Counter()
    for text in texts:
        (i, x), (j, y) = encode(text) if text else (([], []), ([], []))
        ends = [0], [0]
        for side, parts in zip(ends, (x, y), strict=True):
            for p in parts:
                side.append(side[-1] + len(p))
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([t for t, e in zip(i, ends[0][1:], strict=True) if lo < e <= hi], [t for t, e in zip(j, ends[1][1:], strict=True) if lo < e <= hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        links = [(a, b) for u, v in groups for a in u for b in v]
        held.update(set(links))
        found.append((len(i), len(j), groups, links))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for n_a, n_b, groups, links in found:
        text = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def got(df, **kw):
    from skein.llm.token_alignment import alignment_counts

    out = alignment_counts(df, A, B, **kw)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(((r.doc_id, tuple(r)[1:]) for r in out.collect()), key=str)


def test_table(spark, plain):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6)
    rows = df.select("doc_id", "text").collect()
    want = sorted(zip((r.doc_id for r in rows), brute(plain, [r.text for r in rows]), strict=True), key=str)
    assert got(df, run_bytes=60_000) == want


def test_odd_texts(spark, plain):
    """White space of all kinds, runs of it, marks, scripts, names of special tokens, and texts that B cannot give back."""
    pieces = ["a", "b ", "  ", " the", "\n", " \n", "é", "é ", "'s", " 12", "\t", " ", "　", "  ", "漢字", "😀", " <|endoftext|>", "<s>", "...", "\u0085 ", "​", "ﬁ", "\r\n", "\x00", "\x1c ", "x" * 30, " " * 9, "▁"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(pieces[: 28 if n % 9 == 0 else 27]) for _ in range(rng.randint(1, 40))) for n in range(400)]
    texts += [None, "", " ", "  ", "a ", "▁", "x" * 5000, "\n", *["same text"] * 50, "a" * 3001 + " " * 777 + "b"]
    df = spark.createDataFrame([(None if n == 7 else n // 2, t, n, "r", [n]) for n, t in enumerate(texts)], "doc_id long, text string, run int, n_a string, pairs array<int>").repartition(4)
    want = sorted(((None if n == 7 else n // 2, w) for n, w in enumerate(brute(plain, texts))), key=str)
    assert got(df, run_bytes=3000) == want
    assert got(df.limit(0)) == []


def test_wide_groups(plain, monkeypatch):
    """Groups whose pairs are counted by distinct ids give what all pairs give."""
    import numpy as np

    from skein.llm import token_alignment as ta

    segments = ta.Segments(ta.Tokenizers(A, B))
    data = np.frombuffer(" abracadabra漢字漢字 0123".encode(), np.uint8)
    whole = lambda: (segments.clear(), segments.of(data, np.array([0]), np.array([len(data)])), segments.pair, segments.times)[2:]
    one = whole()
    monkeypatch.setattr(ta, "WIDE", 0)
    two = whole()
    assert all((x == y).all() for x, y in zip(one, two, strict=True)) and len(one[0])


def test_owner_arrays():
    import numpy as np

    from skein.llm.token_alignment import groups, overlaps, owners

    a, b = owners(np.array([2, 1, 3]), np.array([1, 2, 1, 2]))
    assert a.tolist() == [0, 0, 1, 2, 2, 2] and b.tolist() == [0, 1, 1, 2, 3, 3]
    assert [x.tolist() for x in overlaps(a, b)] == [[0, 0, 1, 2, 2], [0, 1, 1, 2, 3]]
    assert [x.tolist() for x in groups(a, b)] == [[0, 0, 1], [0, 0, 1, 1]]
    assert [len(x) for x in groups(*owners(np.array([], int), np.array([], int)))] == [0, 0]


def test_alignments(spark, plain):
    from skein.llm.token_alignment import alignments

    texts = ["The quick brown fox", None, "", "naïve café — 漢字", "▁"]
    for r in alignments(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).collect():
        (i, x), (j, y) = plain(texts[r.doc_id]) if texts[r.doc_id] else (([], []), ([], []))
        assert r.a_ids == i and r.b_ids == j and len(r.a_groups) == len(i) and len(r.b_groups) == len(j)
        at = {}
        for side, parts in ((0, x), (1, y)):
            n = 0
            for k, p in enumerate(parts):
                for _ in p:
                    at.setdefault(n, [None, None])[side] = k
                    n += 1
        assert list(zip(r.overlap_a, r.overlap_b, strict=True)) == list(dict.fromkeys(map(tuple, at.values())))
