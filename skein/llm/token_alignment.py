"""Alignment of two tokenizers over the same bytes, by byte-owner arrays.

np.repeat gives every byte the index of the token of A, and of B, that holds it. Where the pair of owners changes a new overlap begins; where both owners change at once both tokenizers end a
token, and the text is cut there into groups. A group links each of its A tokens with each of its B tokens.

A text is cut before every blank that follows something other than white space: no token of either tokenizer stands across such a place (Tokenizers checks its vocabularies for that), so both
end a token there, and what a segment gives is computed once for each distinct segment that a worker remembers.

Pass one reads the texts once and writes, for each document, its counts, the hash of its groups and its distinct linked id pairs with their times; documents come in runs of about RUN_BYTES of
text, with one row of the run's distinct pairs and of how many of its documents hold each. Sums over these rows are the corpus-wide counts; a join gives them to each run's pairs, and a cogroup
by run brings them to the documents. Nothing is broadcast, and no task holds more than a run, a text longer than that being one of its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Workspace, slices, text_arrays

#: Text of a run, in bytes, unless one text is longer.
RUN_BYTES = 12 << 20
#: Segments, and tokens of these, that a worker remembers; both only save time.
CACHE_SEGMENTS, CACHE_TOKENS = 300_000, 4_000_000
#: Text that is encoded in one call.
CALL_CHARS = 100_000
#: Groups with more links than this are counted by their distinct ids.
WIDE = 4096
_DOC = "run long, is_run boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# ---------------------------------------------------------------- owners


def owners(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The A token and the B token of every byte; sizes are tokens' bytes, of the same sum."""
    return np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consecutive distinct pairs of owners: which A token shares bytes with which B token."""
    if not len(a):
        return a, b
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[new], b[new]


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token: a new one begins where both owners change."""
    if not len(a):
        return a, b
    cut = np.cumsum(np.concatenate([[False], (a[1:] != a[:-1]) & (b[1:] != b[:-1])]))
    first = lambda x: np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return cut[first(a)], cut[first(b)]


# ---------------------------------------------------------------- tokenizers


def _byte_chars() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones of Latin-1 as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and whether texts may be cut before blanks."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, special = _byte_chars(), {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(map(chars.__getitem__, t)): i for t, i in vocab.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if [vocab[x + y] for x, y in merges] != list(range(256, 256 + len(merges))):
            raise ValueError("the ids of the byte-level vocabulary are not in the order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = _table([t for t, _ in sorted(ranks.items(), key=lambda x: x[1])])
        self.b_bytes = _table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.blank, self.n_b = self.b.piece_to_id("▁"), len(pieces)
        # A token in which a text would be cut stands for texts that cannot be.
        inner = [t for t in (*ranks, *(p.replace("▁", " ").encode() for p in pieces)) if b" " in t[1:] and len(cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))) > 1]
        if inner:
            raise ValueError(f"tokens hold a blank behind other characters, so texts cannot be cut before blanks: {inner[:3]}")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that starts with a blank: by A whole, by B without that blank, which B adds itself."""
        rest = text[1:]
        return np.array(self.a.encode_ordinary(text), np.int64), np.array(self.b.encode(rest) if rest else [self.blank], np.int64)


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes, each token's start and size."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def _spread(size: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive runs of these sizes."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _bytes_of(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    flat, start, size = table
    n = size[ids]
    return flat[np.repeat(start[ids], n) + _spread(n)]


# ---------------------------------------------------------------- segments

_BLANK = "▁".encode()
_DIGITS = np.array([[int(c) for c in f"{n:<5}".replace(" ", "0")] for n in range(100_000)], np.uint8) + 48
_WIDTH = np.searchsorted([10, 100, 1000, 10_000], np.arange(100_000), "right") + 1


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where segments start in rows of texts that start with a blank each (off: rows' bounds): at rows' starts, and at blanks that follow no white space.

    What may be the end of white space outside ASCII counts as such; cutting less is always right.
    """
    if len(data) < 2:
        return off[:-1]
    before = data[:-1]
    white = before <= 32
    wide = before >= 128
    two, three = np.zeros(len(before), np.uint8), np.zeros(len(before), np.uint8)
    two[1:], three[2:] = data[:-2], data[:-3]
    white |= wide & (two == 0xC2) & ((before == 0x85) | (before == 0xA0))
    white |= wide & (three >= 0xE1) & (three <= 0xE3) & ((two == 0x9A) | (two == 0x80) | (two == 0x81))
    return np.union1d(np.flatnonzero((data[1:] == 32) & ~white) + 1, off[:-1])


class Segments:
    """What distinct segments give: ids, groups, linked pairs and the text of their groups, each computed once."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.clear()

    def clear(self) -> None:
        z = np.empty(0, np.int64)
        self.keys, self.slot, self.texts, self.tokens = np.empty(0, np.uint64), z, [], 0
        self.n_a, self.n_b, self.n_groups, self.n_links, self.good = z, z, z, z, np.empty(0, bool)
        self.pair, self.times, self.pair_at, self.n_pairs = z, z, z, z

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each segment's entry, which holds until the next call."""
        keys, where, inverse = np.unique(Rolling(data).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_SEGMENTS or self.tokens > CACHE_TOKENS:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            self._learn(keys[new], [data[a:b].tobytes() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        return self.slot[at][inverse]

    def _alone(self, part: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of one segment, none if not both tokenizers give it back as it is."""
        a, b = self.t.encode(part.decode())
        good = all(_bytes_of(x, t).tobytes() == part for x, t in ((a, self.t.a_bytes), (b, self.t.b_bytes)))
        return (a, b, True) if good else (a[:0], b[:0], False)

    def _together(self, parts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """A ids, how many a segment has, B ids and how many, and which segments both tokenizers give back. The segments are encoded in one call, as no token stands across two of them."""
        whole, ends, out = b"".join(parts), np.cumsum([len(p) for p in parts]), []
        raw = np.frombuffer(whole, np.uint8)
        for x, table in zip(self.t.encode(whole.decode()), (self.t.a_bytes, self.t.b_bytes), strict=True):
            till = np.cumsum(table[2][x])
            last = np.searchsorted(till, ends)
            if not len(till) or till[-1] != len(raw) or (till[last] != ends).any() or (_bytes_of(x, table) != raw).any():
                return self._each(parts)
            out += [x, np.diff(last, prepend=-1)]
        return out, np.ones(len(parts), bool)

    def _each(self, parts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        got = [self._alone(p) for p in parts]
        out = []
        for k in (0, 1):
            out += [np.concatenate([g[k] for g in got]), np.array([len(g[k]) for g in got])]
        return out, np.array([g[2] for g in got])

    def _encode(self, parts: list[bytes], n_odd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same over all segments, of which the last n_odd are encoded each by itself."""
        found, plain = [], len(parts) - n_odd
        at = 0
        for end in [*np.flatnonzero(np.diff(np.cumsum([0, *map(len, parts[:plain])]) // CALL_CHARS)).tolist(), plain]:
            if end > at:
                found.append(self._together(parts[at:end]))
                at = end
        if n_odd:
            found.append(self._each(parts[plain:]))
        return *(np.concatenate([f[0][k] for f in found]) for k in range(4)), np.concatenate([f[1] for f in found])

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        # Behind a segment that ends with white space the next one's blank would not start a token.
        odd = np.array([p[-1:].isspace() or p[-1] >= 128 and p.decode()[-1].isspace() or _BLANK in p for p in parts])
        order = np.argsort(odd, kind="stable")
        keys, parts = keys[order], [parts[i] for i in order.tolist()]
        a, n_a, b, n_b, good = self._encode(parts, int(odd.sum()))
        own_a, own_b = owners(self.t.a_bytes[2][a], self.t.b_bytes[2][b])
        group_a, group_b = groups(own_a, own_b)
        n = int(group_a[-1]) + 1 if len(a) else 0
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        seg_a = np.repeat(np.arange(len(parts)), n_a)
        segment = np.zeros(n, np.int64)
        segment[group_a] = seg_a  # a group lies in one segment
        pair, times, owner = self._pairs(a, group_a, b, group_b, in_a, in_b, segment)
        self.texts += self._written(a, group_a, b, group_b, seg_a, np.repeat(np.arange(len(parts)), n_b), len(parts))
        per = lambda w=None: np.bincount(segment, w, len(parts)).astype(np.int64)
        n_pairs = np.bincount(owner, minlength=len(parts))
        join = lambda name, x: setattr(self, name, np.concatenate([getattr(self, name), x]))
        join("pair_at", len(self.pair) + np.cumsum(n_pairs) - n_pairs)
        for name, x in {"n_a": n_a, "n_b": n_b, "n_groups": per(), "n_links": per(in_a * in_b), "good": good, "pair": pair, "times": times, "n_pairs": n_pairs}.items():
            join(name, x)
        keys, slot = np.concatenate([self.keys, keys]), np.concatenate([self.slot, np.arange(len(self.slot), len(self.slot) + len(parts))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot, self.tokens = keys[order], slot[order], self.tokens + len(a) + len(b)

    def _pairs(self, a, group_a, b, group_b, in_a, in_b, segment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs, their links, and their segments, in order of these."""
        wide = in_a * in_b > WIDE
        first_b = np.cumsum(in_b) - in_b
        narrow = ~wide[group_a]
        x, g = a[narrow], group_a[narrow]
        n = in_b[g]
        keys = [np.repeat((segment[g] << 31) + x * self.t.n_b, n) + b[np.repeat(first_b[g], n) + _spread(n)]]
        times = [np.ones(len(keys[0]), np.int64)]
        first_a = np.cumsum(in_a) - in_a
        for g in np.flatnonzero(wide).tolist():
            x, i = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            y, j = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            keys.append(((segment[g] << 31) + x[:, None] * self.t.n_b + y[None, :]).ravel())
            times.append((i[:, None] * j[None, :]).ravel())
        keys, times = _summed(np.concatenate(keys), np.concatenate(times))
        return keys & ((1 << 31) - 1), times, keys >> 31

    def _written(self, a, group_a, b, group_b, seg_a, seg_b, n: int) -> list[bytes]:
        """The groups of each segment as text: ids by commas, a bar before those of B, groups by semicolons."""
        ids, side = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        place = 2 * np.concatenate([group_a, group_b]) + side
        order = np.argsort(place, kind="stable")
        ids, place, segment = ids[order], place[order], np.concatenate([seg_a, seg_b])[order]
        size = _WIDTH[ids] + 1
        start = np.cumsum(size) - size
        out = np.empty(size.sum(), np.uint8)
        for k in range(5):
            has = size > k + 1
            out[start[has] + k] = _DIGITS[ids[has], k]
        last = np.concatenate([place[1:] != place[:-1], [True]]) if len(place) else np.empty(0, bool)
        out[start + size - 1] = np.where(last, np.where(place & 1, ord(";"), ord("|")), ord(","))
        whole, end = out.tobytes(), np.zeros(n + 1, np.int64)
        end[1:] = np.cumsum(np.bincount(segment, size, n)).astype(np.int64)
        return [whole[i : max(i, j - 1)] for i, j in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(values[order], new)


# ---------------------------------------------------------------- pass one


class _Texts:
    """Rows of a slice as segments."""

    def __init__(self, segments: Segments, column: pa.Array):
        data, off = text_arrays(column)
        rows = len(off) - 1
        # A blank before every text.
        self.off = off + np.arange(rows + 1)
        full = np.empty(len(data) + rows, np.uint8)
        mask = np.ones(len(full), bool)
        mask[self.off[:-1]] = False
        full[~mask], full[mask] = 32, data
        starts = cuts(full, self.off)
        ends = np.append(starts[1:], len(full))
        self.doc = np.searchsorted(self.off, starts, "right") - 1
        live = np.diff(off)[self.doc] > 0  # an empty text has no tokens
        self.segments, self.doc, self.rows = segments, self.doc[live], rows
        self.entry = segments.of(full, starts[live], ends[live]) if live.any() else np.empty(0, np.int64)
        bad = np.unique(self.doc[~segments.good[self.entry]])
        keep = ~np.isin(self.doc, bad)
        self.doc, self.entry = self.doc[keep], self.entry[keep]

    def total(self, per_entry: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, per_entry[self.entry], self.rows).astype(np.int64)

    @cached_property
    def bounds(self) -> np.ndarray:
        return np.searchsorted(self.doc, np.arange(self.rows + 1))

    def hashes(self) -> list[str]:
        entry, texts = self.entry.tolist(), self.segments.texts
        return [hashlib.sha256(b";".join([texts[e] for e in entry[i:j]])).hexdigest() if j > i else "" for i, j in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each row, in order, with their links and rows."""
        keys, n = np.unique((self.doc << 32) | self.entry, return_counts=True)
        doc, entry = keys >> 32, keys & 0xFFFFFFFF
        size = self.segments.n_pairs[entry]
        at = np.repeat(self.segments.pair_at[entry], size) + _spread(size)
        keys, times = _summed((np.repeat(doc, size) << 31) | self.segments.pair[at], np.repeat(n, size) * self.segments.times[at])
        return keys & ((1 << 31) - 1), times, keys >> 31


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.astype(np.int32)))


class _Run:
    def __init__(self, number: int):
        self.number, self.bytes, self.parts = number, 0, []

    def add(self, ids: pa.Array, texts: _Texts) -> None:
        pair, times, doc = texts.pairs()
        s = texts.segments
        self.parts.append((ids, [texts.total(x) for x in (s.n_a, s.n_b, s.n_groups, s.n_links)], texts.hashes(), pair, times, np.bincount(doc, minlength=texts.rows)))
        self.bytes += int(texts.off[-1])

    def rows(self) -> Iterator[pa.RecordBatch]:
        distinct, held = np.unique(np.concatenate([p[3] for p in self.parts]), return_counts=True)
        for ids, numbers, hashes, pair, times, n in self.parts:
            same = lambda x, kind: pa.array([x] * len(ids), kind)  # noqa: B023, E731
            yield _batch([same(self.number, pa.int64()), same(False, pa.bool_()), ids.cast(pa.int64()), *map(pa.array, numbers), pa.array(hashes, pa.string()), _lists(np.searchsorted(distinct, pair), n), _lists(times, n)])
        none = [pa.array([None], pa.int64())] * 5
        yield _batch([pa.array([self.number]), pa.array([True]), *none, pa.array([None], pa.string()), _lists(distinct, [len(distinct)]), _lists(held, [len(distinct)])])


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _DOC.split(", ")])


def _first_pass(a_path: str, b_path: str, run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, base = Segments(Tokenizers(a_path, b_path)), TaskContext.get().partitionId() << 32
        now = _Run(base)
        for batch in batches:
            for part in slices(batch):
                now.add(part.column("doc_id"), _Texts(segments, part.column("text")))
                if now.bytes >= run_bytes:
                    yield from now.rows()
                    now = _Run(now.number + 1)
        if now.parts:
            yield from now.rows()

    return run


# ---------------------------------------------------------------- counts


def _scored(key, docs: pa.Table, values: pa.Table) -> pa.Table:
    """The documents of a run with the counts of its pairs."""
    order = np.argsort(values.column("pair").to_numpy())
    count, best = values.column("n").to_numpy()[order], values.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    size = docs.column("pairs").combine_chunks().value_lengths().to_numpy()
    at, times = (docs.column(c).combine_chunks().flatten().to_numpy() for c in ("pairs", "times"))
    doc = np.repeat(np.arange(docs.num_rows), size)
    total = lambda x: pa.array(_sums(doc, x, docs.num_rows))
    own = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(own | {"n_best": total(times * best[at]), "count_sum": total(times * count[at]), "groups_sha256": docs.column("groups_sha256")})


def _sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row in integers; rows are in order."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    bounds = np.searchsorted(row, np.arange(n + 1))
    return total[bounds[1:]] - total[bounds[:-1]]


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES, work: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (byte-level BPE) encodes a blank and the text, B (sentencepiece) the text, to which it adds the blank. n_links are all pairs of an A and a B token of one group; a pair of ids counts as
    often as documents hold it linked; n_best are links whose count is the highest of their A id (ties included), count_sum the sum of counts over links.
    Texts that are null or empty, or that the tokens' bytes do not give back, have zeros and an empty hash. Rows that share an id are documents of their own; a null id stays null. Other
    columns may have any names. An empty table gives no rows. A text of any length is one row of one task.
    """
    work = work or Workspace(docs.sparkSession, "alignment")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = work.keep(rows.mapInArrow(_first_pass(a_path, b_path, run_bytes), _DOC), "aligned")
    runs = found.where("is_run").select("run", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("run", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    n_b = Tokenizers(a_path, b_path).n_b
    counts = work.keep(runs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {n_b}")), "counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    values = runs.select("run", "pair").join(counts, "pair").select("run", "pair", "n", "best")
    again = docs.sparkSession.read.schema(found.schema).parquet(found._skein_path)  # columns of their own: both sides of the cogroup come from one table
    return again.where("not is_run").drop("is_run").groupBy("run").cogroup(values.groupBy("run")).applyInArrow(lambda k, d, v: _scored(k, d, v), RESULT)


def alignments(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, a_groups, b_groups, overlap_a, overlap_b): each text's tokens, the group of each, and the A and B tokens (by place) that share bytes.

    Edge cases as alignment_counts: what has no tokens there has empty lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizers(a_path, b_path)
        for batch in batches:
            out = []
            for value in batch.column("text").to_pylist():
                raw = (" " + (value or "")).encode()
                a, b = t.encode(raw.decode()) if value else (np.empty(0, np.int64),) * 2
                if any(_bytes_of(x, table).tobytes() != raw for x, table in ((a, t.a_bytes), (b, t.b_bytes))):
                    a = b = np.empty(0, np.int64)
                own = owners(t.a_bytes[2][a], t.b_bytes[2][b])
                out.append((a, b, *groups(*own), *overlaps(*own)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in out], pa.list_(pa.int32())) for k in range(6))], names=["doc_id", *_PARTS])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} array<int>" for c in _PARTS))


_PARTS = ("a_ids", "b_ids", "a_groups", "b_groups", "overlap_a", "overlap_b")
