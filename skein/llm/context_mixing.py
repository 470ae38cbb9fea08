"""LM scoring by counts of tokens and pairs over logistic context mixing of hashed bit predictors.

A text is its tokens: words (A-Z lower-cased, without the white space), then one end. A token is a path of binary decisions. The first ones say which of the CLASSES most
frequent tokens it is, or none of them, in a Huffman tree of those; another token is then spelled byte by byte, ended by a blank, in a Huffman tree of the bytes. Three predictors
count zeros and ones per decision, each in a table addressed by a hash of the decision and its context. For the first decisions the contexts are nothing, the class of
the token before, and the classes of the two before; for spelling the last three and the last five bytes and all bytes of the token so far (counted for the TOP most
frequent tokens only: it tells words that are known from others, and rare ones would crowd it). A predictor's
stretched probability ln((n1 + d) / (n0 + d)) is near 0 where little was seen. A mixer sums them by weights that its gate selects: the decision, and how often the longest context was seen. An
adaptive map from gate and mixed probability to the frequency observed refines the result. The log probabilities of all decisions add up to the score, and to bits per byte.

Gathering is distributed. A task counts over its runs of documents; after each run it looks at the run's decisions once more, each with its own occurrence taken out of the
counts, predicts, and updates the mixer's weights and the map online, batch by batch. Counts are additive and the weights of tasks are averaged by how often they used a gate;
all are of fixed size and summed in blocks, in two rounds. All training documents count, whole. What a run holds several times (a token to spell, a class in its context) is computed
once, and counts as often as it occurs.

The tables are of fixed size, so what they know of rare tokens does not grow. Whole tokens and pairs of a token and the one before it are therefore counted for all training tokens, exactly (by 64-bit hash),
in buckets whose number grows with the input. A token's probability is its pair's count, smoothed by the token's count, which is smoothed by the mixing model: each adds up to one. How much each backs
off is told by how many pairs and tokens occur once (priors()).

No task holds these counts: runs send their distinct tokens and pairs to buckets by hash and get counts back. The base score needs the same counts of tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Rolling, Workspace, crc_mod, lowered, mix64, slices, text_arrays, word_bounds

FOLDS, HELD_OUT = 7, 2
TABLE_BITS = (20, 21, 20)
CLASSES, TOP, DELTA = 254, 65_536, 0.4
#: A table entry: the stretched probability in steps of 1 / STEP, 6 bits, and how often it was seen (SEEN), 2 bits.
STEP, SEEN = 2.8, np.array([1, 4, 32])
#: Decisions are numbered 0-255 in spelling and 256-511 before it; a gate is a decision and how often the longest context was seen.
GATES, MAP_BUCKETS, RATE, BATCH = 512 * 4, 33, 0.15, 1 << 15
#: Text of a run, tokens of a block, groups in which the tables of tasks (of fixed size) are summed first.
RUN_BYTES, RUN_DOCS, BLOCK, SUM_GROUPS = 4 << 20, 60_000, 20_000, 64
CHUNK = 1 << 16
CACHE_TOKENS = 2_000_000
END = np.uint64(0x0A0A0A0A0A0A0A0A)
_ODD, _PAIR_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFF0000)
_CODEC = pa.Codec("zstd", compression_level=1)
_NODE_MIX = np.random.default_rng(0x11).integers(1, 1 << 32, 512, dtype=np.uint32)


# ------------------------------------------------------------------ tokens of a run


@dataclass
class Tokens:
    """Tokens of a run of documents: hashes in order, each document's first, and where the bytes of a token are."""

    data: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def tokens_of(data: np.ndarray, off: np.ndarray) -> Tokens:
    starts, ends, words = word_bounds(data, off)
    low = lowered(data)
    docs = len(off) - 1
    first = words + np.arange(docs + 1)
    hashes, at, size = np.empty(first[-1], np.uint64), np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    is_end = np.zeros(first[-1], bool)
    is_end[first[1:] - 1] = True
    hashes[is_end] = END
    if len(starts):
        # Hashing takes many bytes for one of text: some documents at a time.
        hashed, a = np.empty(len(starts), np.uint64), 0
        while a < docs:
            b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE_BYTES, "right")) - 1)
            i = slice(words[a], words[b])
            hashed[i] = Rolling(low[off[a] : off[b]]).of(starts[i] - off[a], ends[i] - off[a])
            a = b
        hashes[~is_end], at[~is_end], size[~is_end] = hashed, starts, ends - starts
    return Tokens(low, hashes, first, at, size)


def squeezed(x: np.ndarray) -> bytes:
    """An array in few bytes: its bytes by place, those that say most first, compressed. It begins with the width and the number of its elements."""
    if x.dtype.kind in "iu":
        x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return bytes([x.itemsize]) + len(x).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def loosened(raw: bytes, kind: str = "u") -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    body = _CODEC.decompress(raw[9:], width * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(width, n).T).view(f"{kind}{width}").ravel()


def squeezed_sorted(x: np.ndarray) -> bytes:
    """Sorted 64-bit hashes, by their differences."""
    return squeezed(np.diff(x, prepend=np.uint64(0)))


def loosened_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(loosened(raw).astype(np.uint64), dtype=np.uint64)


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Numbered runs of a task's rows: slices of its batches, gathered to about RUN_BYTES of text and RUN_DOCS rows (a longer text is a run)."""
    from pyspark import TaskContext

    number, held, size, docs = TaskContext.get().partitionId() << 24, [], 0, 0
    joined = lambda: held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        for part in slices(batch):
            for at in range(0, part.num_rows, RUN_DOCS):
                rows = part.slice(at, RUN_DOCS)
                n = len(text_arrays(rows.column("text"))[0])
                if held and (size + n > RUN_BYTES or docs + rows.num_rows > RUN_DOCS):
                    yield number, joined()
                    number, held, size, docs = number + 1, [], 0, 0
                held.append(rows)
                size, docs = size + n, docs + rows.num_rows
    if held:
        yield number, joined()


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(11)).astype(np.float64) / float(1 << 53) * buckets).astype(np.int64).clip(0, buckets - 1)


def pairs_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it, 48 bits of it: among 10 thousand million pairs an unseen one is taken for one of them with probability 4e-5."""
    before = np.concatenate([[END], hashes[:-1]])
    before[first[:-1]] = END
    return mix64(hashes + mix64(before) * _ODD) & _PAIR_BITS


# ------------------------------------------------------------------ counts of tokens, pairs and bytes

#: Kinds of counted things: tokens, and pairs of a token and the one before it (the end, before the first).
TOKEN, PAIR = 0, 1
_VOCABULARY = "kind long, bucket long, hashes binary, counts binary, total long, types long, bytes array<long>, sizes array<long>"


def _count_tokens(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in runs_of(batches):
            t = tokens_of(*text_arrays(part.column("text")))
            of_bytes = np.bincount(t.data, minlength=256)
            of_bytes[[9, 10, 11, 12, 13, 32]] = 0
            of_bytes[32], of_bytes[10] = len(t.hashes) - part.num_rows, part.num_rows
            for kind, what in ((TOKEN, t.hashes), (PAIR, pairs_of(t.hashes, t.first))):
                hashes, count = np.unique(what, return_counts=True)
                cut = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), kind), pa.int64()),
                        pa.array(some, pa.int64()),
                        pa.array([squeezed_sorted(hashes[cut[b] : cut[b + 1]]) for b in some], pa.binary()),
                        pa.array([squeezed(count[cut[b] : cut[b + 1]]) for b in some], pa.binary()),
                        pa.array([of_bytes.tobytes() if kind == TOKEN and k == 0 else None for k in range(len(some))], pa.binary()),
                    ],
                    names=["kind", "bucket", "hashes", "counts", "bytes"],
                )

    return run


def _sum_tokens(key, table):
    hashes, inverse = np.unique(np.concatenate([loosened_sorted(x.as_py()) for x in table.column("hashes")]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([loosened(x.as_py()) for x in table.column("counts")]), minlength=len(hashes)).astype(np.int64)
    of_bytes = sum((np.frombuffer(x, np.int64) for x in table.column("bytes").to_pylist() if x is not None), np.zeros(256, np.int64))
    sizes = np.bincount(np.floor(np.log2(counts) * 8).astype(np.int64), minlength=512)
    return pa.table(
        [*(pa.array([k.as_py()], pa.int64()) for k in key), pa.array([squeezed_sorted(hashes)], pa.binary()), pa.array([squeezed(counts)], pa.binary()), pa.array([int(counts.sum())]), pa.array([len(hashes)]), pa.array([of_bytes.tolist()], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64()))],
        names=[c.split()[0] for c in _VOCABULARY.split(", ")],
    )


# ------------------------------------------------------------------ codes


@dataclass
class Code:
    """For each symbol its decisions: how many, where they begin, and each one's number and bit."""

    length: np.ndarray
    offset: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def huffman(counts: np.ndarray, base: int) -> Code:
    """A code of some symbols, the decisions numbered from base on, the root last. Every symbol has a code, also if it was never seen."""
    heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    n, children = len(counts), {}
    while len(heap) > 1:
        (x, _, a), (y, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        node = n + len(children)
        children[node] = (a, b)
        heapq.heappush(heap, (x + y, node, node))
    paths, stack = {}, [(heap[0][2], [])]
    while stack:
        node, path = stack.pop()
        if node < n:
            paths[node] = path
        else:
            stack += [(child, [*path, (base + node - n, k)]) for k, child in enumerate(children[node])]
    length = np.array([len(paths[b]) for b in range(n)])
    flat = np.array([d for b in range(n) for d in paths[b]], np.int64).reshape(-1, 2)
    return Code(length, np.cumsum(length) - length, flat[:, 0], flat[:, 1])


@dataclass
class Codes:
    """classes: sorted hashes of the most frequent tokens, which are symbols 1, 2, ... of the first code; symbol 0 is any other token. others: of further frequent ones."""

    classes: np.ndarray
    first: Code
    others: np.ndarray
    spelling: Code


# ------------------------------------------------------------------ decisions


@dataclass
class Items:
    """The distinct items of a run: classes in their contexts, then tokens to spell. inverse tells the items of each token."""

    tokens: Tokens
    contexts: np.ndarray  # class, class before, class two before
    context_times: np.ndarray
    of_token: np.ndarray
    spelled: np.ndarray  # a place of each distinct token to spell
    spelled_times: np.ndarray
    spelled_of: np.ndarray  # for each token to spell, in order
    frequent: np.ndarray  # of the distinct tokens to spell
    rare: np.ndarray  # places of the tokens to spell


def _context_keys(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each token's class, that before and that two before as one number; 255 before the first token of a document."""
    before = np.concatenate([[255], kind[:-1]])
    before[first[:-1]] = 255
    earlier = np.concatenate([[255], before[:-1]])
    earlier[first[:-1]] = 255
    return kind + (before << 8) + (earlier << 16)


def items_of(t: Tokens, codes: Codes) -> Items:
    kind = _symbols(codes.classes, t.hashes)
    keys, of_token, times = np.unique(_context_keys(kind, t.first), return_inverse=True, return_counts=True)
    rare = np.flatnonzero(kind == 0)
    distinct, place, spelled_of, spelled_times = np.unique(t.hashes[rare], return_index=True, return_inverse=True, return_counts=True)
    return Items(t, np.stack([keys & 255, keys >> 8 & 255, keys >> 16]), times, of_token, rare[place], spelled_times, spelled_of, _symbols(codes.others, distinct) > 0, rare)


def _symbols(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 1, 0)


def _slots(contexts: list[np.ndarray], length: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    mixed, out = _NODE_MIX[node], []
    for bits, context in zip(TABLE_BITS, contexts, strict=True):
        h = np.repeat(context, length) ^ mixed
        h *= np.uint32(0x9E3779B1)
        out.append((h >> np.uint32(32 - bits)).astype(np.int64))
    return out


def _path(code: Code, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = code.length[symbol]
    end = np.cumsum(length)
    at = np.arange(end[-1]) - np.repeat(end - length - code.offset[symbol], length)
    return length, code.node[at], code.bit[at]


def _context(x: np.ndarray, salt: int) -> np.ndarray:
    return (mix64(x.astype(np.uint64) * _ODD + np.uint64(salt)) >> np.uint64(32)).astype(np.uint32)


def decisions(items: Items, codes: Codes) -> Iterator[tuple[slice, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Blocks of items: which, whether to spell, times, decisions of each, numbers, bits, and table slots of each predictor."""
    kind, before, earlier = items.contexts
    for a in range(0, len(kind), BLOCK):
        i = slice(a, min(a + BLOCK, len(kind)))
        length, node, bit = _path(codes.first, kind[i])
        contexts = [_context(np.zeros(len(length)), 1), _context(before[i], 2), _context(before[i] + (earlier[i] << 8), 3)]
        yield i, False, items.context_times[i], length, node, bit, _slots(contexts, length, node)
    t = items.tokens
    raw = np.append(t.data, np.uint8(32))
    for a in range(0, len(items.spelled), BLOCK):
        i = slice(a, min(a + BLOCK, len(items.spelled)))
        where = items.spelled[i]
        size = t.sizes[where] + 1
        stop = np.cumsum(size)
        start = stop - size
        pos = np.arange(stop[-1]) - np.repeat(start, size)
        text = raw[np.minimum(np.repeat(t.starts[where], size) + pos, len(raw) - 1)]
        text[stop - 1] = 32
        roll, at, begin = Rolling(text), np.arange(len(text)), np.repeat(start, size)
        contexts = [(roll.of(np.maximum(begin, at - n), at) >> np.uint64(32)).astype(np.uint32) + np.uint32(n) for n in (3, 5)]
        contexts.append((roll.of(begin, at) >> np.uint64(32)).astype(np.uint32))
        length, node, bit = _path(codes.spelling, text)
        yield i, True, items.spelled_times[i], np.add.reduceat(length, start), node, bit, _slots(contexts, length, node)


# ------------------------------------------------------------------ mixer and refinement


@dataclass
class Mixer:
    """Weights by gate (bias, then one per predictor) and the refinement map: ones and all by gate and bucket of the mixed stretch."""

    weights: np.ndarray
    seen: np.ndarray
    ones: np.ndarray
    all: np.ndarray

    @staticmethod
    def new() -> Mixer:
        w = np.full((GATES, 1 + len(TABLE_BITS)), 0.3)
        w[:, 0] = 0
        return Mixer(w, np.full(w.shape, 1e-3), np.zeros(GATES * MAP_BUCKETS), np.zeros(GATES * MAP_BUCKETS))

    def mixed(self, gate: np.ndarray, st: list[np.ndarray]) -> np.ndarray:
        w = np.ascontiguousarray(self.weights.T, np.float32)
        x = w[0][gate]
        for k, s in enumerate(st):
            x += w[k + 1][gate] * s
        return np.clip(x, -12, 12, out=x)

    @staticmethod
    def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (x + np.float32(12)) * np.float32((MAP_BUCKETS - 1) / 24)
        low = np.minimum(at.astype(np.int64), MAP_BUCKETS - 2)
        return low, at - low

    def update(self, gate: np.ndarray, bit: np.ndarray, times: np.ndarray, st: list[np.ndarray]) -> None:
        """One online step: the map counts what came, the weights follow the error."""
        x = self.mixed(gate, st)
        low, part = self.place(x)
        bucket = gate * MAP_BUCKETS + low + (part > 0.5)
        self.all += np.bincount(bucket, times, minlength=len(self.all))
        self.ones += np.bincount(bucket, times * bit, minlength=len(self.ones))
        # An item that occurs often weighs the root of its times.
        push = np.sqrt(times) * (bit - 1 / (1 + np.exp(-x)))
        step = np.stack([np.bincount(gate, push if k == 0 else push * st[k - 1], minlength=GATES) for k in range(1 + len(st))], 1)
        self.seen += step**2
        self.weights += RATE * step / np.sqrt(self.seen)

    def refined(self) -> np.ndarray:
        """Stretched frequency by gate and bucket; near the bucket's own value where little came."""
        prior = 1 / (1 + np.exp(-np.linspace(-12, 12, MAP_BUCKETS)))
        p = (self.ones.reshape(GATES, -1) + 4 * prior) / (self.all.reshape(GATES, -1) + 4)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p)).astype(np.float32).reshape(-1)


def _seen(n: np.ndarray) -> np.ndarray:
    """In which of the four ranges of SEEN a count is."""
    return (n >= SEEN[0]).astype(np.int64) + (n >= SEEN[1]) + (n >= SEEN[2])


def _gate(node: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return node * 4 + seen


def _groups(held: list[tuple], decisions: int = 2_500_000) -> Iterator[list[tuple]]:
    """Neighbouring blocks of about so many decisions together."""
    group, n = [], 0
    for h in held:
        group.append(h)
        n += len(h[4])
        if n >= decisions:
            yield group
            group, n = [], 0
    if group:
        yield group


def _gather(codes: Codes):
    """Counts of a task's runs, and its mixer, learned with each decision's own occurrence taken out of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Zeros and ones of an entry as one number of two halves: one look-up for both.
        tables, mixer, some = [np.zeros(1 << bits, np.complex64) for bits in TABLE_BITS], Mixer.new(), False
        delta = np.float32(DELTA)
        for _, part in runs_of(batches):
            some = True
            items = items_of(tokens_of(*text_arrays(part.column("text"))), codes)
            held = []
            for i, spell, times, n, node, bit, slots in decisions(items, codes):
                own = items.frequent[i] if spell else np.ones(len(n), bool)
                held.append((times.astype(np.float32), own, n, node.astype(np.int16), bit.astype(np.int8), [slot.astype(np.int32) for slot in slots]))
            for group in _groups(held):
                bits, times = np.concatenate([h[4] for h in group]), np.concatenate([np.repeat(h[0], h[2]) for h in group])
                for k, table in enumerate(tables):
                    if k == len(tables) - 1:
                        times *= np.concatenate([np.repeat(h[1], h[2]) for h in group])
                    flat, at = table.view(np.float32), np.concatenate([h[5][k] for h in group])
                    at *= 2
                    at += bits
                    flat += np.bincount(at, times, minlength=len(flat))
                del bits, times, at
            for times, own, n, node, bit, slots in held:
                times, own = np.repeat(times, n), np.repeat(own, n)
                for k in range(0, len(bit), BATCH):
                    j = slice(k, k + BATCH)
                    one = bit[j].astype(np.float32)
                    zero, st = 1 - one, []
                    for m, (table, slot) in enumerate(zip(tables, slots, strict=True)):
                        pair = table[slot[j]]
                        n0, n1 = pair.real, pair.imag
                        if m < len(tables) - 1:
                            n0, n1 = n0 - zero, n1 - one
                        else:
                            n0, n1 = n0 - zero * own[j], n1 - one * own[j]
                        st.append(np.log(n1 + delta) - np.log(n0 + delta))
                    mixer.update(_gate(node[j].astype(np.int64), _seen(n0 + n1)), one, times[j], st)
            del held
        if some:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId() % SUM_GROUPS
            used = mixer.all.reshape(GATES, -1).sum(1)
            learned = np.concatenate([(mixer.weights * used[:, None]).ravel(), used, mixer.ones, mixer.all])
            for kind, table in enumerate([*(t.view(np.float32) for t in tables), learned]):
                for k in range(0, len(table), CHUNK):
                    block = table[k : k + CHUNK]
                    if block.any():
                        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int64()), pa.array([k // CHUNK], pa.int64()), pa.array([part], pa.int64()), pa.array([squeezed(block)], pa.binary())], names=["kind", "chunk", "part", "block"])

    return run


def _total(table: pa.Table) -> np.ndarray:
    total = 0
    for x in table.column("block"):
        total = total + loosened(x.as_py(), "f").astype(np.float64)
    return total


def _sum_part(key, table):
    """A block summed over a group of tasks."""
    kind, chunk, part = (k.as_py() for k in key)
    return pa.table([pa.array([kind]), pa.array([chunk]), pa.array([part]), pa.array([squeezed(_total(table).astype(np.float32 if kind < len(TABLE_BITS) else np.float64))], pa.binary())], names=["kind", "chunk", "part", "block"])


def _sum_blocks(key, table):
    """A block summed over all groups: of a table, its entries of 6 and 2 bits; of what the mixers learned, the sums."""
    kind = key[0].as_py()
    total = _total(table)
    if kind < len(TABLE_BITS):
        n = total.reshape(-1, 2)
        st = np.clip(np.round((np.log(n[:, 1] + DELTA) - np.log(n[:, 0] + DELTA)) * STEP), -31, 31).astype(np.int64) + 32
        total = (st * 4 + np.searchsorted(SEEN, n.sum(1), "right")).astype(np.uint8)
    return pa.table([pa.array([kind]), pa.array([key[1].as_py()]), pa.array([squeezed(total)], pa.binary())], names=["kind", "chunk", "block"])


_ENTRY = ((np.arange(256) >> 2) - 32).astype(np.float32) / np.float32(STEP)


@dataclass
class Model:
    codes: Codes
    tables: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray
    train_tokens: int
    train_types: int
    #: Spelled tokens that a scoring worker remembers, and their values; it only saves time.
    spelled: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    values: np.ndarray = field(default_factory=lambda: np.empty(0))

    #: Tokens that the mixing model weighs beside the counts of tokens, and tokens that these weigh beside the counts of pairs.
    token_prior: float = 1.0
    pair_prior: float = 1.0

    def score(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability by the mixing model and bytes of each document; every token has a byte more, for what ends it."""
        return np.add.reduceat(self.each(t), t.first[:-1]), np.add.reduceat(t.sizes + 1, t.first[:-1])

    def each(self, t: Tokens) -> np.ndarray:
        """log10 probability of each token by the mixing model."""
        items, of_context, of_spelled = self.values_of(t)
        each = of_context[items.of_token]
        each[items.rare] += of_spelled[items.spelled_of]
        return each

    def values_of(self, t: Tokens) -> tuple[Items, np.ndarray, np.ndarray]:
        """The items of a run and log10 probabilities: of each class in its context, and of each spelled token (by hash, in order)."""
        items = items_of(t, self.codes)
        hashes = t.hashes[items.spelled]
        slot = np.minimum(np.searchsorted(self.spelled, hashes), max(0, len(self.spelled) - 1))
        new = self.spelled[slot] != hashes if len(self.spelled) else np.ones(len(hashes), bool)
        fresh = replace(items, spelled=items.spelled[new], spelled_times=items.spelled_times[new])
        value = [np.empty(items.contexts.shape[1]), np.empty(len(fresh.spelled))]
        mixer = Mixer(self.weights, None, None, None)
        for i, spell, _, n, node, bit, slots in decisions(fresh, self.codes):
            logs = np.empty(len(bit))
            for k in range(0, len(bit), BATCH):
                entries = [table[s[k : k + BATCH]] for table, s in zip(self.tables, slots, strict=True)]
                gate = _gate(node[k : k + BATCH], entries[-1] & 3)
                x = mixer.mixed(gate, [_ENTRY[e] for e in entries])
                low, part = Mixer.place(x)
                at = gate * MAP_BUCKETS + low
                x = 0.5 * (x + self.refined[at] * (1 - part) + self.refined[at + 1] * part)
                logs[k : k + BATCH] = np.log1p(np.exp(np.where(bit[k : k + BATCH] == 1, -x, x)))
            value[spell][i] = np.add.reduceat(logs, np.cumsum(n) - n) * (-1 / np.log(10))
        spelled = np.empty(len(hashes))
        spelled[new] = value[True]
        if len(self.spelled):
            spelled[~new] = self.values[slot[~new]]
        if len(self.spelled) + len(fresh.spelled) > CACHE_TOKENS:
            self.spelled, self.values = hashes, spelled
        else:
            keys, values = np.concatenate([self.spelled, hashes[new]]), np.concatenate([self.values, spelled[new]])
            order = np.argsort(keys)
            self.spelled, self.values = keys[order], values[order]
        return items, value[False], spelled


def priors(n: int, tokens: np.ndarray, pairs: np.ndarray) -> tuple[float, float]:
    """The weights of what backs off, in tokens, from the numbers of types by size: a token or pair is new as often as those seen once say (Good-Turing)."""
    if not n:
        return 1.0, 1.0
    new_token, new_pair = (min(max(x[0], 1) / n, n / (n + 1)) for x in (tokens, pairs))
    size = 2 ** (np.arange(len(tokens)) / 8)
    share = tokens * size / (tokens * size).sum()
    low, high = 1e-3, 1e15
    for _ in range(100):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if (share * mid / (size + mid)).sum() < new_pair else (low, mid)
    return n * new_token / (1 - new_token), low


def assemble(blocks: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Tables, weights and refinement map from the summed blocks."""
    tables = [np.full(1 << bits, 32 * 4, np.uint8) for bits in TABLE_BITS]
    width = 1 + len(TABLE_BITS)
    learned = np.zeros(GATES * (width + 1 + 2 * MAP_BUCKETS))
    for kind, chunk, block in zip(*(blocks.column(c).to_pylist() for c in ("kind", "chunk", "block")), strict=True):
        x = loosened(block, "u" if kind < len(tables) else "f")
        if kind < len(tables):
            k = chunk * (CHUNK // 2)
            tables[kind][k : k + len(x)] = x
        else:
            learned[chunk * CHUNK : chunk * CHUNK + len(x)] = x
    w, used, ones, all_ = np.split(learned, np.cumsum([GATES * width, GATES, GATES * MAP_BUCKETS]))
    mixer = Mixer.new()
    some = used > 0
    mixer.weights[some] = w.reshape(GATES, width)[some] / used[some, None]
    mixer.ones, mixer.all = ones, all_
    return tables, mixer.weights.astype(np.float32), mixer.refined()


def codes_of(top: np.ndarray, counts: np.ndarray, total: int, spelling: Code) -> Codes:
    """The first code, of the most frequent of the frequent tokens."""
    order = np.lexsort((top, -counts))
    best, rest = np.sort(order[:CLASSES]), np.sort(order[CLASSES:TOP])
    first = huffman(np.concatenate([[total - counts[best].sum()], counts[best]]), 256)
    return Codes(top[best], first, top[rest], spelling)


def train(docs: DataFrame, work: Workspace) -> tuple[Model, DataFrame, int]:
    """The model of all rows of docs, its tokens and pairs in buckets, and their number."""
    spark = docs.sparkSession
    texts = docs.select("text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 26)
    counted = texts.mapInArrow(_count_tokens(buckets), "kind long, bucket long, hashes binary, counts binary, bytes binary")
    vocabulary = work.keep(counted.groupBy("kind", "bucket").applyInArrow(_sum_tokens, _VOCABULARY), "vocabulary")
    n, v = (x or 0 for x in vocabulary.where(F.col("kind") == TOKEN).agg(F.sum("total"), F.sum("types")).first())

    def by_place(c: str, size: int, kind: int = TOKEN) -> np.ndarray:
        out = np.zeros(size, np.int64)
        for r in vocabulary.where(F.col("kind") == kind).select(F.posexplode(c)).groupBy("pos").agg(F.sum("col").alias("n")).collect():
            out[r.pos] = r.n
        return out

    spelling = huffman(by_place("bytes", 256), 0)
    # The least count that at most TOP tokens reach.
    sizes = by_place("sizes", 512)
    reach = np.cumsum(sizes[::-1])[::-1]
    least = 2 ** (int(np.argmax(reach <= TOP)) / 8)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                h, c = loosened_sorted(h), loosened(c).astype(np.int64)
                some = c >= np.ceil(least - 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array([h[some].tobytes()], pa.binary()), pa.array([c[some].tobytes()], pa.binary())], names=["hashes", "counts"])

    got = vocabulary.where(F.col("kind") == TOKEN).select("hashes", "counts").mapInArrow(frequent, "hashes binary, counts binary").toArrow()
    top = np.frombuffer(b"".join(got.column("hashes").to_pylist()), np.uint64)
    counts = np.frombuffer(b"".join(got.column("counts").to_pylist()), np.int64)
    order = np.argsort(top)
    top, counts = top[order], counts[order]
    codes = codes_of(top, counts, n, spelling)
    blocks = texts.mapInArrow(_gather(codes), "kind long, chunk long, part long, block binary")
    parts = blocks.groupBy("kind", "chunk", "part").applyInArrow(_sum_part, "kind long, chunk long, part long, block binary")
    tables = work.keep(parts, "tables")
    summed = tables.groupBy("kind", "chunk").applyInArrow(_sum_blocks, "kind long, chunk long, block binary").toArrow()
    work.drop(tables)
    token_prior, pair_prior = priors(n, sizes, by_place("sizes", 512, PAIR))
    return Model(codes, *assemble(summed), n, v, token_prior=token_prior, pair_prior=pair_prior), vocabulary, buckets


# ------------------------------------------------------------------ scoring

#: A row of a run: its documents (rows), its distinct tokens' classes and spelled log10 probabilities, each token's place among them, and the log10 probabilities of its distinct contexts, in order. Other rows
#: have distinct hashes of tokens or pairs to look up, by kind and bucket, in order, and get their counts.
_PARTS = "bucket long, run long, kind long, hashes binary, counts binary, rows binary, classes binary, spelled binary, places binary, contexts binary"
_ROWS = [("id", "i8"), ("null", "?"), ("held", "?"), ("n", "i8"), ("size", "i8")]
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _score_runs(shared, buckets: int):
    """A row per run, and rows of its tokens and of its pairs, each once, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for number, part in runs_of(batches):
            t = tokens_of(*text_arrays(part.column("text")))
            items, of_context, of_spelled = m.values_of(t)
            hashes, place = np.unique(t.hashes, return_inverse=True)
            spelled = np.zeros(len(hashes), np.float32)
            spelled[np.searchsorted(hashes, t.hashes[items.spelled])] = of_spelled
            ids, n = part.column("doc_id"), np.diff(t.first)
            table = np.zeros(len(n), _ROWS)
            table["id"], table["null"], table["held"] = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column("held").to_numpy(zero_copy_only=False)
            table["n"], table["size"] = n, np.add.reduceat(t.sizes + 1, t.first[:-1])
            sent = [_symbols(m.codes.classes, hashes).astype(np.uint8), spelled, place, of_context.astype(np.float32)]
            rows = [(number % buckets, number, None, None, None, table.tobytes(), *map(squeezed, sent))]
            # A bucket is a range of hashes, so what is in order is in order of buckets too.
            for kind, x in ((TOKEN, hashes), (PAIR, np.unique(pairs_of(t.hashes, t.first)))):
                cut = np.searchsorted(_bucket(x, buckets), np.arange(buckets + 1))
                rows += [(int(b), number, kind, squeezed_sorted(x[cut[b] : cut[b + 1]]), *[None] * 6) for b in np.flatnonzero(np.diff(cut))]
            names, types = [f.split()[0] for f in _PARTS.split(", ")], [pa.int64()] * 3 + [pa.binary()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _look_up(key, parts, vocabulary):
    """The rows of runs as they are, and counts in place of the hashes to look up."""
    known = {k: (loosened_sorted(h), loosened(c).astype(np.int64)) for k, h, c in zip(*(vocabulary.column(c).to_pylist() for c in ("kind", "hashes", "counts")), strict=True)}
    found = []
    for kind, raw in zip(parts.column("kind").to_pylist(), parts.column("hashes"), strict=True):
        if kind is None:
            found.append(None)
            continue
        hashes = loosened_sorted(raw.as_py())
        out = np.zeros(len(hashes), np.int64)
        if kind in known:
            words, counts = known[kind]
            at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
            out = np.where(words[at] == hashes, counts[at], 0)
        found.append(squeezed(out))
    # Hashes of pairs are known from those of tokens.
    kept = pc.if_else(pc.equal(parts.column("kind"), PAIR), pa.scalar(None, pa.binary()), parts.column("hashes"))
    return parts.set_column(parts.column_names.index("hashes"), "hashes", kept).set_column(parts.column_names.index("counts"), "counts", pa.array(found, pa.binary()))


def _finish(n_train: int, v_train: int, token_prior: float, pair_prior: float):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-1 if r["kind"] is None else r["kind"], r["bucket"]))
        own = rows[0]
        t = np.frombuffer(own["rows"], _ROWS)
        classes, spelled, contexts = loosened(own["classes"]), loosened(own["spelled"], "f"), loosened(own["contexts"], "f")
        hashes = np.concatenate([loosened_sorted(r["hashes"]) for r in rows if r["kind"] == TOKEN])
        counts, pair_counts = (np.concatenate([loosened(r["counts"]).astype(np.int64) for r in rows if r["kind"] == k]) for k in (TOKEN, PAIR))
        place = loosened(own["places"]).astype(np.int64)
        stop = np.cumsum(t["n"])
        start = stop - t["n"]
        first = np.append(start, stop[-1])
        each = contexts[np.unique(_context_keys(classes[place].astype(np.int64), first), return_inverse=True)[1]].astype(float) + spelled[place]
        pair = pair_counts[np.unique(pairs_of(hashes[place], first), return_inverse=True)[1]]
        before = np.roll(place, 1)
        before[start] = place[stop[0] - 1]  # the end, which every document has
        n = counts[place]
        p = (n + token_prior * 10.0**each) / (n_train + token_prior)
        p = np.log10(pair + pair_prior * p) - np.log10(counts[before] + pair_prior)
        score = np.add.reduceat(p, start)
        base, known = np.add.reduceat(np.log10(n + 1.0), start) - t["n"] * np.log10(n_train + v_train + 1.0), np.add.reduceat((n > 0).astype(np.int64), start)
        bits = -score * np.log2(10) / t["size"]
        return pa.table(
            [pa.array(t["id"].copy(), pa.int64(), mask=t["null"].copy()), pa.array(t["held"].copy()), pa.array(t["n"].copy()), pa.array(known), pa.array(np.full(len(t), n_train, np.int64)), pa.array(base), pa.array(score), pa.array(t["size"].copy()), pa.array(bits)],
            names=[f.split()[0] for f in _RESULT.split(", ")],
        )

    return run


def score_documents(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Training rows are those whose crc32 of doc_id as text, modulo 7, is not 2; a null id counts as empty text. A null or empty text is its end token alone.
    n_tokens counts the end, n_known tokens with a count in training; base_score is the sum of log10((count + 1) / (N + V + 1)); score the model's log10 probability,
    n_bytes the bytes it coded and bits_per_byte what it took for each. Repeated rows score alike. Without training rows the model is
    uniform over decisions. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "lm")
    held = crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT
    model, vocabulary, buckets = train(docs.where(~held), work)
    shared = spark.sparkContext.broadcast(model)
    parts = docs.select("doc_id", "text", held.alias("held")).mapInArrow(_score_runs(shared, buckets), _PARTS)
    counted = vocabulary.select("kind", "bucket", "hashes", "counts").groupBy("bucket")
    looked = parts.groupBy("bucket").cogroup(counted).applyInArrow(_look_up, _PARTS)
    return looked.groupBy("run").applyInArrow(_finish(model.train_tokens, model.train_types, model.token_prior, model.pair_prior), _RESULT)
