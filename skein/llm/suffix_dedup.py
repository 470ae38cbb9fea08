"""Suffix-array dedup: repeated passages across documents by a common-prefix-aware distributed merge sort.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller id. Not every suffix needs to be sorted for that: a string of SPAN bytes
has one anchor, the place in it where its least hashed run of GRAM bytes starts (the first of equals). Two equal strings have their anchors at the same
offset, so it is enough to sort the suffixes that start at anchors, about one position in 18, and compare what stands before them.

1. Copies of whole texts are settled by digest: all but the one with the smallest id go whole.
2. Each run of documents sends the hashes of its anchors, sorted, one entry a hash; where a hash comes from one document only, its anchors drop out.
   What is left is in documents that share something.
3. Those documents form sorted runs of the suffixes at their shared anchors. A run is front-coded: each suffix is the length that it shares with the one
   before, and the rest. In a run, a suffix that several documents have in the same surroundings is sent once, by its smallest id; the others are known to be repeats.
4. Runs meet by anchor hash and are merged by a loser tree that keeps, with every loser, its common prefix with the winner that beat it. A contest is
   decided by those lengths; only suffixes with equal lengths are compared, from there on. The merge yields the order and the common prefixes of neighbours: strings with a suffix part of n bytes
   are equal where no prefix between them is shorter than n and the bytes before the anchor are equal. The smallest id of each such group owns the string.
5. Documents get the byte ranges that others own and drop them.

A passage that a third of all documents share is one entry of a run in steps 2 and 3, however often it occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Workspace, mix64, slices, text_arrays

SPAN, GRAM = 50, 16
REACH = SPAN - GRAM  # an anchor is at most so many bytes into its string
#: A run has so many bytes of text, and documents, at most (one longer document is a run).
RUN_BYTES, RUN_DOCS = 16 << 20, 60_000
#: Anchors that a task meets, about.
BUCKET_ANCHORS = 1 << 20
#: String starts that are looked at together; a longer text has its strings in several pieces, which changes no result. Places in a piece fit into the low 24 bits of a hash.
PIECE = 1 << 23
_SEVERAL = 0xFFFF
_KEY_BITS = 48


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position, first and last string start, and hash of each anchor of the rows of a byte string."""
    if len(data) <= PIECE + SPAN:
        return _anchors(data, off)
    found = []
    for k in range(0, len(data), PIECE):
        part = data[k : k + PIECE + SPAN - 1]
        row, place, first, last, grams = _anchors(part, np.clip(off - k, 0, len(part)))
        found.append((row, place + k, first + k, last + k, grams))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.empty(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none, np.empty(0, np.uint64)
    at = np.arange(len(data) - GRAM + 1)
    grams = Rolling(data).of(at, at + GRAM)
    low = np.uint64((1 << 24) - 1)
    value = (grams & ~low) | (at.astype(np.uint64) & low)
    width = 1
    while width * 2 <= REACH + 1:
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        value = np.minimum(value[:-rest], value[rest:])
    start = np.arange(len(value))
    inside = np.zeros(len(value), bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= SPAN:
            inside[a : b - SPAN + 1] = True
    start = start[inside]
    if not len(start):
        return none, none, none, none, np.empty(0, np.uint64)
    place = start + ((value[inside] - start.astype(np.uint64)) & low).astype(np.int64)
    row = np.searchsorted(off, start, "right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return row[first], place[first], start[first], start[last], grams[place[first]]


def _key(grams: np.ndarray) -> np.ndarray:
    """Mixed anew: anchors are least hashes, so their own hashes crowd at the low end."""
    return mix64(grams ^ np.uint64(0xA5A5A5A5)) >> np.uint64(64 - _KEY_BITS)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key.astype(np.float64) / float(1 << _KEY_BITS) * buckets).astype(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Numbered runs of documents, each a list of slices."""
    from pyspark import TaskContext

    number, held, size, docs = TaskContext.get().partitionId() << 24, [], 0, 0
    for batch in batches:
        for part in slices(batch.select(columns)):
            n = len(text_arrays(part.column("text"))[0])
            if held and (size + n > RUN_BYTES or docs + part.num_rows > RUN_DOCS):
                yield number, held
                number, held, size, docs = number + 1, [], 0, 0
            for at in range(0, part.num_rows, RUN_DOCS):
                held.append(part.slice(at, RUN_DOCS))
            size, docs = size + n, docs + part.num_rows
    if held:
        yield number, held


# ------------------------------------------------- step 2: anchors that several documents have

#: A document is its id and a 64-bit hash of its text (version): an id may be given with several texts.
_ENTRIES = "bucket long, run long, keys binary, docs binary, ids binary"


def _send_keys(buckets: int):
    """Entries of a run by bucket; what the run itself knows to be shared, and its ids, as rows of a bucket chosen by the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in _runs(batches, ["doc_id", "version", "text"]):
            ids = np.stack([np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("doc_id", "version")], 1)
            keys, docs, base = [], [], 0
            for p in parts:
                row, _, _, _, grams = anchors(*text_arrays(p.column("text")))
                keys.append(_key(grams))
                docs.append(row + base)
                base += p.num_rows
            key, doc = np.concatenate(keys), np.concatenate(docs)
            pair = np.unique((key << np.uint64(16)) | doc.astype(np.uint64))
            key, doc = pair >> np.uint64(16), (pair & np.uint64(_SEVERAL)).astype(np.uint16)
            distinct, at, count = np.unique(key, return_index=True, return_counts=True)
            local = np.repeat(count > 1, count)
            one = doc[at].copy()
            one[count > 1] = _SEVERAL
            cut = np.searchsorted(_bucket(distinct, buckets), np.arange(buckets + 1))
            rows = [(b, number, distinct[cut[b] : cut[b + 1]].tobytes(), one[cut[b] : cut[b + 1]].tobytes(), None) for b in range(buckets) if cut[b] < cut[b + 1]]
            rows.append((int(mix64(np.array([number], np.uint64))[0] % np.uint64(buckets)), number, key[local].tobytes(), doc[local].tobytes(), ids.tobytes()))
            yield _packed(rows)

    def _packed(rows):
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.binary()) for x in c[2:])], names=["bucket", "run", "keys", "docs", "ids"])

    return run


def _meet_keys(table: pa.Table) -> pa.Table:
    """Of the entries of a bucket, those whose key another run has too. Rows with ids pass as they are."""
    own = [v is not None for v in table.column("ids").to_pylist()]
    pass_on = table.filter(pa.array(own)).drop_columns(["bucket"])
    table = table.filter(pa.array([not x for x in own]))
    runs = table.column("run").to_pylist()
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    docs = [np.frombuffer(x, np.uint16) for x in table.column("docs").to_pylist()]
    rows = []
    if keys:
        flat = np.sort(np.concatenate(keys))
        twice = np.unique(flat[1:][flat[1:] == flat[:-1]])
        for r, k, d in zip(runs, keys, docs, strict=True):
            at = np.minimum(np.searchsorted(twice, k), max(0, len(twice) - 1))
            hit = (d != _SEVERAL) & (twice[at] == k) if len(twice) else np.zeros(len(k), bool)
            if hit.any():
                rows.append((r, k[hit].tobytes(), d[hit].tobytes(), None))
    c = list(zip(*rows, strict=True)) if rows else [[]] * 4
    found = pa.table([pa.array(c[0], pa.int64()), *(pa.array(x, pa.binary()) for x in c[1:])], names=["run", "keys", "docs", "ids"])
    return pa.concat_tables([pass_on.cast(found.schema), found])


def _by_document(table: pa.Table) -> pa.Table:
    """The shared keys of each document of a run."""
    ids = next(np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist() if x is not None).reshape(-1, 2)
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
    doc = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("docs").to_pylist()]).astype(np.int64)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    at = np.flatnonzero(np.diff(doc, prepend=-1))
    return pa.table({"doc_id": pa.array(ids[doc[at], 0]), "version": pa.array(ids[doc[at], 1]), "keys": pa.array([k.tobytes() for k in np.split(key, at[1:])] if len(at) else [], pa.binary())})


# ------------------------------------------------- steps 3 and 4: sorted suffix runs

_RUN = "bucket long, run long, n long, shared binary, rest binary, before binary, ranges binary, doc binary, places binary, known binary"
_OWNED = "doc_id long, version long, starts binary, ends binary"


def _suffixes(data: np.ndarray, off: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SPAN bytes from each anchor on, and REACH bytes before it, nearest first; zeros where the document ends."""
    right = place[:, None] + np.arange(SPAN)[None, :]
    left = place[:, None] - 1 - np.arange(REACH)[None, :]
    r = np.where(right < off[row + 1][:, None], data[np.minimum(right, len(data) - 1)], 0)
    return r, np.where(left >= off[row][:, None], data[np.maximum(left, 0)], 0)


def front_code(sorted_rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of sorted rows of bytes: how much each shares with the one before, and the rests."""
    if not len(sorted_rows):
        return np.empty(0, np.uint8), b""
    shared = np.zeros(len(sorted_rows), np.uint8)
    differ = sorted_rows[1:] != sorted_rows[:-1]
    shared[1:] = np.where(differ.any(1), differ.argmax(1), sorted_rows.shape[1])
    keep = np.arange(sorted_rows.shape[1])[None, :] >= shared[:, None]
    return shared, sorted_rows[keep].tobytes()


def front_decode(shared: np.ndarray, rest: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(shared), width), np.uint8)
    keep = np.arange(width)[None, :] >= shared[:, None]
    out[keep] = np.frombuffer(rest, np.uint8)
    # Column by column, a row that shares it has the value of the last row that does not.
    for c in range(width):
        source = np.where(keep[:, c], np.arange(len(shared)), 0)
        out[:, c] = out[np.maximum.accumulate(source), c]
    return out


def merge(runs: list[tuple[list[int], list[int]]], width: int) -> Iterator[tuple[int, int, int]]:
    """Merges sorted runs by a loser tree: yields run, index in it, and the bytes shared with the one before.

    A run is its strings as big-endian numbers of width bytes, and what each shares with the one before in its run. tree[i] holds the loser of a contest and what it
    shares with the winner; so does whoever climbs. More shared with the last winner means smaller; only a tie looks at bytes, past those shared.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    runs = [*runs, *[([], [])] * (k - len(runs))]
    bits, end = width * 8, 1 << (width * 8)  # end: greater than any string
    at, now = [0] * k, [r[0][0] if r[0] else end for r in runs]
    tree: list[tuple[int, int]] = [(0, 0)] * k

    def contest(a: int, b: int) -> tuple[int, int, int]:
        """Winner, loser and what they share, by all bytes."""
        x, y = now[a], now[b]
        if x == end or y == end:
            return (b, a, 0) if x == end else (a, b, 0)
        shared = (bits - (x ^ y).bit_length()) // 8
        return (a, b, shared) if x <= y else (b, a, shared)

    def build(i: int) -> int:
        if i >= k:
            return i - k
        w, loser, shared = contest(build(2 * i), build(2 * i + 1))
        tree[i] = (loser, shared)
        return w

    winner, shared = build(1) if k > 1 else 0, 0
    while now[winner] != end:
        yield winner, at[winner], shared
        strings, lengths = runs[winner]
        i = at[winner] = at[winner] + 1
        if i < len(strings):
            now[winner], shared = strings[i], lengths[i]
        else:
            now[winner], shared = end, -1
        node = (winner + k) >> 1
        while node:
            loser, s = tree[node]
            if now[loser] == end:
                pass
            elif s > shared:
                tree[node] = (winner, shared)
                winner, shared = loser, s
            elif s == shared:
                w, lost, both = contest(winner, loser)
                tree[node] = (lost, both)
                winner = w
            node >>= 1


def _send_suffixes(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in _runs(batches, ["doc_id", "version", "text", "keys"]):
            cols = [[] for _ in range(8)]
            for p in parts:
                data, off = text_arrays(p.column("text"))
                row, place, first, last, grams = anchors(data, off)
                shared = [np.frombuffer(k, np.uint64) for k in p.column("keys").to_pylist()]
                wanted = np.concatenate([np.empty(0, np.uint64), *shared]) ^ mix64(np.repeat(np.arange(len(shared), dtype=np.uint64), [len(k) for k in shared]))
                hit = np.isin(_key(grams) ^ mix64(row.astype(np.uint64)), wanted)
                row, place, first, last, grams = (x[hit] for x in (row, place, first, last, grams))
                if len(row):
                    right, left = _suffixes(data, off, row, place)
                    lo, hi = place - last, place - first
                    # Bytes that no string of the anchor covers do not count.
                    right[np.arange(SPAN)[None, :] >= (SPAN - lo)[:, None]] = 0
                    left[np.arange(REACH)[None, :] >= hi[:, None]] = 0
                    for c, x in zip(cols, (right, left, lo, hi, p.column("doc_id").to_numpy()[row], p.column("version").to_numpy()[row], place - off[row], _key(grams)), strict=True):
                        c.append(x)
            if cols[0]:
                yield from _run_rows(number, [np.concatenate(c) for c in cols], buckets)

    return run


def _run_rows(number: int, cols: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    right, left, lo, hi, doc, version, place, key = cols
    bucket = _bucket(key, buckets)
    whole = _ranks(np.concatenate([right, left, lo[:, None].astype(np.uint8), hi[:, None].astype(np.uint8)], 1))
    order = np.lexsort((place, version, doc, whole, bucket))
    right, left, lo, hi, doc, version, place, bucket, whole = (x[order] for x in (right, left, lo, hi, doc, version, place, bucket, whole))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (whole[1:] != whole[:-1]) | (bucket[1:] != bucket[:-1])
    group = np.cumsum(fresh) - 1
    mine = doc == doc[np.flatnonzero(fresh)][group]
    # Others than the owner: repeats for sure, all strings of the anchor.
    known = np.stack([doc[~mine], version[~mine], place[~mine] - hi[~mine], place[~mine] - lo[~mine] + SPAN], 1)
    # The owner's, one entry for each of its texts (hardly ever more than one).
    own = np.flatnonzero(mine)
    new = np.ones(len(own), bool)
    new[1:] = (group[own][1:] != group[own][:-1]) | (version[own][1:] != version[own][:-1])
    head = own[new]
    count = np.bincount(np.cumsum(new) - 1, minlength=len(head)).astype(np.uint32)
    owner = np.stack([doc[head], version[head]], 1)
    cut = np.searchsorted(bucket[head], np.arange(buckets + 1))
    places = place[own].astype(np.int64)
    before = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    rows = []
    for b in np.flatnonzero(np.diff(cut)):
        h = head[cut[b] : cut[b + 1]]
        shared, rest = front_code(right[h])
        ls, lr = left[h], hi[h]
        flat = ls[np.arange(REACH)[None, :] < lr[:, None]].tobytes()
        rows.append((int(b), number, len(h), shared.tobytes(), rest, flat, np.stack([lo[h], lr], 1).astype(np.uint8).tobytes(), owner[cut[b] : cut[b + 1]].tobytes(), count[cut[b] : cut[b + 1]].tobytes() + places[before[cut[b]] : before[cut[b + 1]]].tobytes(), None))
    if len(known):
        rows.append((int(mix64(np.array([number], np.uint64))[0] % np.uint64(buckets)), number, 0, b"", b"", b"", b"", b"", b"", known.astype(np.int64).tobytes()))
    for k in range(0, len(rows), 64):
        c = list(zip(*rows[k : k + 64], strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:3]), *(pa.array(x, pa.binary()) for x in c[3:])], names=[f.split()[0] for f in _RUN.split(", ")])


def _ranks(raw: np.ndarray) -> np.ndarray:
    """Ranks of rows of bytes in their order."""
    pad = (-raw.shape[1]) % 8
    words = np.ascontiguousarray(np.pad(raw, ((0, 0), (0, pad)))).view(">u8")
    order = np.lexsort(words.T[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (words[order][1:] != words[order][:-1]).any(1)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _merge_bucket(table: pa.Table) -> pa.Table:
    """Byte ranges of documents that a document with a smaller id owns."""
    docs, starts, ends = [], [], []
    runs, left, lo, hi, doc, count, places = [], [], [], [], [], [], []
    for r in table.to_pylist():
        if r["known"] is not None:
            x = np.frombuffer(r["known"], np.int64).reshape(-1, 4)
            docs.append(x[:, :2])
            starts.append(x[:, 2])
            ends.append(x[:, 3])
            continue
        shared = np.frombuffer(r["shared"], np.uint8)
        rows = front_decode(shared, r["rest"], SPAN)
        raw = rows.tobytes()
        runs.append(([int.from_bytes(raw[k : k + SPAN]) for k in range(0, len(raw), SPAN)], shared.tolist()))
        both = np.frombuffer(r["ranges"], np.uint8).reshape(-1, 2).astype(np.int64)
        before = np.zeros((len(both), REACH), np.uint8)
        before[np.arange(REACH)[None, :] < both[:, 1:]] = np.frombuffer(r["before"], np.uint8)
        left.append(before)
        lo.append(both[:, 0])
        hi.append(both[:, 1])
        doc.append(np.frombuffer(r["doc"], np.int64).reshape(-1, 2))
        n = np.frombuffer(r["places"][: 4 * len(both)], np.uint32)
        count.append(n.astype(np.int64))
        places.append(np.frombuffer(r["places"][4 * len(both) :], np.int64))
    if runs:
        base = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
        merged = np.array(list(merge(runs, SPAN)), np.int64)
        order, shared = base[merged[:, 0]] + merged[:, 1], merged[:, 2]
        left, lo, hi, doc, count = (np.concatenate(x) for x in (left, lo, hi, doc, count))
        at = np.concatenate([[0], np.cumsum(count)])
        places = np.concatenate(places)
        l, a, b, d = left[order], lo[order], hi[order], doc[order, 0]
        prefix = np.zeros(len(d), np.uint64)
        for j in range(REACH + 1):  # strings that start j bytes before their anchor
            if j:
                prefix = mix64(prefix * np.uint64(257) + l[:, j - 1].astype(np.uint64) + np.uint64(1))
            has = np.flatnonzero((a <= j) & (j <= b))
            if len(has) < 2:
                continue
            group = np.cumsum(shared < SPAN - j)[has].astype(np.uint64)
            same = mix64(prefix[has] + group * np.uint64(0x9E3779B97F4A7C15))
            by = np.lexsort((d[has], same))
            new = np.ones(len(by), bool)
            new[1:] = same[by][1:] != same[by][:-1]
            owner = d[has][by][np.flatnonzero(new)][np.cumsum(new) - 1]
            lost = has[by][owner < d[has][by]]
            if len(lost):
                k = order[lost]
                n = count[k]
                stop = np.cumsum(n)
                p = places[np.repeat(at[k] - stop + n, n) + np.arange(stop[-1])] - j
                docs.append(np.repeat(doc[k], n, axis=0))
                starts.append(p)
                ends.append(p + SPAN)
    if not docs:
        return pa.table({"doc_id": pa.array([], pa.int64()), "version": pa.array([], pa.int64()), "starts": pa.array([], pa.binary()), "ends": pa.array([], pa.binary())})
    d, s, e = (np.concatenate(x) for x in (docs, starts, ends))
    d, code = np.unique(d, axis=0, return_inverse=True)
    code, s, e, cut = _joined(code.ravel(), s, e)
    found = d[code[cut]]
    return pa.table({"doc_id": pa.array(found[:, 0]), "version": pa.array(found[:, 1]), "starts": pa.array([x.tobytes() for x in np.split(s, cut[1:])], pa.binary()), "ends": pa.array([x.tobytes() for x in np.split(e, cut[1:])], pa.binary())})


def _joined(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document joined where they touch, in order, and where each document's begin."""
    order = np.lexsort((s, d))
    d, s, e = d[order], s[order], e[order]
    far = np.int64(1) << 40
    number = np.cumsum(np.diff(d, prepend=d[:1]) != 0)
    reach = np.maximum.accumulate(e + number * far)
    new = np.ones(len(d), bool)
    new[1:] = (s[1:] + number[1:] * far) > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(d)) - 1
    d, s, e = d[at], s[at], reach[last] - number[at] * far
    return d, s, e, np.flatnonzero(np.diff(d, prepend=d[:1] - 1))


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the ranges from each text."""
    for batch in batches:
        out = []
        for doc, version, text, starts, ends in zip(*(batch.column(c) for c in ("doc_id", "version", "text", "starts", "ends")), strict=True):
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            s, e = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in c.values]) for c in (starts, ends))
            _, s, e, _ = _joined(np.zeros(len(s), np.int64), s, np.minimum(e, len(raw)))
            edge = np.zeros(len(raw) + 1, np.int8)
            edge[s] += 1
            edge[e] -= 1
            kept = raw[np.cumsum(edge[:-1]) == 0].tobytes()
            out.append((doc.as_py(), version.as_py(), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept))
        c = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.string()), pa.array(c[5], pa.binary())], names=["doc_id", "version", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_passages(docs: DataFrame, work: Workspace | None = None, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts, also kept (the remaining bytes of changed documents, else null).

    A null text is empty. Rows without an id keep everything and take nothing from others. Rows that share an id and a text are one document, given as often; several
    texts of one id are documents of their own that take nothing from each other, as none has a smaller id. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "suffix")
    t = F.coalesce("text", F.lit(""))
    document = ["doc_id", "version"]
    rows = work.keep(docs.select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("digest"), F.xxhash64(t).alias("version")), "digests")
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = firsts.where("first <> last").select("digest", "first")
    marked = work.keep(rows.join(firsts, "digest", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first"), "marked")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    work.drop(rows)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 * BUCKET_ANCHORS)))
    # Texts move to their marks once, and each distinct one that no smaller id has is written; the steps read that. What a step has written goes when no later one reads it.
    named = docs.where(f"doc_id is not null and octet_length(text) >= {SPAN}").select("doc_id", F.xxhash64("text").alias("version"), "text")
    single = named.join(marked.where("not copy").select(*document), document, "left_semi").groupBy(*document).agg(F.first("text").alias("text"))
    single = work.keep(single, "single")
    entries = single.mapInArrow(_send_keys(buckets), _ENTRIES)
    met = work.keep(entries.groupBy("bucket").applyInArrow(_meet_keys, "run long, keys binary, docs binary, ids binary"), "met")
    shared = work.keep(met.groupBy("run").applyInArrow(_by_document, "doc_id long, version long, keys binary").where("octet_length(keys) > 0"), "shared")
    work.drop(met)
    sharing = work.keep(single.join(shared, document), "sharing")
    work.drop(single, shared)
    owned = work.keep(sharing.mapInArrow(_send_suffixes(buckets), _RUN).groupBy("bucket").applyInArrow(_merge_bucket, _OWNED), "owned")
    ranges = owned.groupBy(*document).agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    cut = sharing.drop("keys").join(ranges, document).mapInArrow(_drop, "doc_id long, version long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if not texts:
        cut = work.keep(cut.drop("kept"), "cut")
        work.drop(sharing, owned)
    gone = F.col("copy") & (F.col("n_bytes") >= SPAN)
    out = marked.join(cut, document, "left")
    cols = [
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    ]
    return out.select(*cols, *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if texts else []))
