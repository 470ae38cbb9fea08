"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the embeddings of its hashed byte n-grams (3 to 5 bytes, with marks at both ends) and of itself, so a misspelling
that was never seen shares most of its vectors with the word that was. A span of SPAN words, one from every word on, is the average of its words, and a linear
softmax over that average says how likely it is toxic; a text is as toxic as its most toxic span, so a few words count as much in a
long text as in a short one, wherever they stand. Embeddings and softmax are trained together, by gradient descent with momentum, on the spans that
decide each labelled text.

As the softmax is linear, a span's logit is the average of its words' logits: scoring looks up one number per distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, lowered, slices, text_arrays, word_bounds
from .labelled import SAMPLE_ROWS, held_out, sample

BUCKETS, DIM, SPAN, THRESHOLD = 1 << 18, 8, 2, 0.7
#: Labelled texts that an n-gram must be in to get an embedding; others stay at zero.
MIN_TEXTS = 3
STEPS, RATE, MOMENTUM, DECAY = 100, 3000.0, 0.9, 1e-3
_GRAMS = (3, 4, 5)
#: Words that a scoring worker remembers; it only saves time.
CACHE_WORDS = 500_000


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams and each word's bounds in them."""
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8)
    start = np.cumsum(size) - size
    roll, found, owner = Rolling(data), [], []
    at, of = np.arange(len(data)), np.repeat(np.arange(len(words)), size)
    left = (start + size)[of] - at
    for n in _GRAMS:
        ok = left >= n
        found.append(roll.of(at[ok], at[ok] + n))
        owner.append(of[ok])
    found.append(roll.of(start, start + size))
    owner.append(np.arange(len(words)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    grams = (np.concatenate(found)[order] >> np.uint64(20)) % np.uint64(BUCKETS)
    return grams.astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def spans(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds of the spans of each row, one from every word on, and the number of spans before each row. A row of fewer words is one span."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - SPAN + 1, 1), 0)
    base = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    start = first[row] + np.arange(base[-1]) - base[row]
    return np.stack([start, np.minimum(start + SPAN, first[row + 1])], 1).astype(np.int32 if first[-1] < 1 << 31 else np.int64), base


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Averages over SPAN at least: a short text is not judged by one word alone more than by any other."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[bounds[:, 1]] - total[bounds[:, 0]]) / SPAN


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of the first range, then those of the next."""
    stop = np.cumsum(length)
    return np.repeat(start - stop + length, length) + np.arange(stop[-1] if len(stop) else 0)


def _gathered(to: np.ndarray, values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of values[at] by to, in blocks that keep the temporaries small."""
    out = np.zeros(n)
    for k in range(0, len(to), 1 << 20):
        out += np.bincount(to[k : k + (1 << 20)], values[at[k : k + (1 << 20)]], minlength=n)
    return out


def _shared_out(chosen: np.ndarray, values: np.ndarray, span: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Sums by word of the values of the spans that hold it, in blocks that keep the temporaries small."""
    out = np.zeros(n)
    for k in range(0, len(chosen), 1 << 18):
        at = chosen[k : k + (1 << 18)]
        length = span[at, 1] - span[at, 0]
        out += np.bincount(word[_ranges(span[at, 0], length)], np.repeat(values[k : k + (1 << 18)], length), minlength=n)
    return out


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """table: the logit of each bucket, that is its embedding times the difference of the softmax's two rows."""

    table: np.ndarray
    bias: float
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    values: np.ndarray = field(default_factory=lambda: np.empty(0))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The logit of each word; remembers distinct words."""
        low = lowered(data)
        hashes, where, inverse = np.unique(Rolling(low).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.keys, self.values = np.empty(0, np.uint64), np.empty(0)
        slot = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
        new = self.keys[slot] != hashes if len(self.keys) else np.ones(len(hashes), bool)
        if new.any():
            raw = low.tobytes()
            grams, bounds = word_grams([raw[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            value = np.add.reduceat(self.table[grams], bounds[:-1]) / np.diff(bounds)
            keys, values = np.concatenate([self.keys, hashes[new]]), np.concatenate([self.values, value])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order]
            slot = np.searchsorted(self.keys, hashes)
        return self.values[slot][inverse]

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """From 0 to 1 for each row; a row without words has the score of an average of no words."""
        starts, ends, first = word_bounds(data, off)
        out = np.full(len(off) - 1, sigmoid(self.bias))
        if len(starts):
            bounds, base = spans(first)
            logits = _means(self.words(data, starts, ends), bounds) + self.bias
            some = np.flatnonzero(np.diff(base))
            out[some] = sigmoid(np.maximum.reduceat(logits, base[some]))
        return out


def fit(texts: list[str] | pa.Array, y: np.ndarray, steps: int = STEPS, seed: int = 5) -> Model:
    """Joint training of embeddings and softmax. No labelled row: every text scores one half."""
    if not len(texts) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 0.0 if not len(texts) else float(np.log((y.mean() + 0.01) / (1.01 - y.mean()))))
    # By slices, as hashing takes many bytes for one of text.
    hashes, firsts, seen = [], [np.zeros(1, np.int64)], {}
    for part in slices(pa.record_batch([texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())], ["text"])):
        data, off = text_arrays(part.column("text"))
        starts, ends, first = word_bounds(data, off)
        firsts.append(first[1:] + firsts[-1][-1])
        if len(starts):
            low = lowered(data)
            found, where, inverse = np.unique(Rolling(low).of(starts, ends), return_index=True, return_inverse=True)
            hashes.append(found[inverse])
            raw = low.tobytes()
            for h, a, b in zip(found.tolist(), starts[where].tolist(), ends[where].tolist(), strict=True):
                seen.setdefault(h, raw[a:b])
    first = np.concatenate(firsts)
    keys, word = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]), return_inverse=True)
    word = word.astype(np.int32)
    if not len(keys):
        return Model(np.zeros(BUCKETS), float(np.log((y.mean() + 0.01) / (1.01 - y.mean()))))
    del hashes
    blocks = [word_grams([seen[h] for h in keys[k : k + 20_000].tolist()]) for k in range(0, len(keys), 20_000)]
    del seen
    grams = np.concatenate([b[0].astype(np.int32) for b in blocks])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b[1]) for b in blocks]))])
    del blocks
    n_grams = np.diff(bounds)
    # Buckets in use, numbered anew; the rest stay at zero.
    span, base = spans(first)
    pairs = np.unique(np.repeat(np.arange(len(texts)), np.diff(first)) * len(n_grams) + word)
    texts_of = np.zeros(BUCKETS, np.int64)
    for doc_words in np.split(pairs % len(n_grams), np.flatnonzero(np.diff(pairs // len(n_grams))) + 1):
        texts_of[np.unique(grams[_ranges(bounds[doc_words], n_grams[doc_words])])] += 1
    used = np.flatnonzero(texts_of >= MIN_TEXTS)
    number = np.full(BUCKETS, len(used), np.int32)
    number[used] = np.arange(len(used))
    grams = number[grams]
    common = grams < len(used)
    per = np.concatenate([[0], np.cumsum(np.add.reduceat(common, bounds[:-1]))])
    grams, owner_word = grams[common], np.repeat(np.arange(len(n_grams), dtype=np.int32), np.diff(per))
    del pairs, common, per
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.01, (len(used), DIM))
    w, bias = rng.normal(0, 1.0, DIM), -2.0
    w /= np.linalg.norm(w)
    me, mw, mb = np.zeros_like(e), np.zeros(DIM), 0.0
    rows = np.flatnonzero(np.diff(base))
    target = y[rows].astype(float)
    weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum())) * len(rows)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(base)[rows])
    lone = np.arange(len(span), dtype=np.int32)
    if not len(used):
        return Model(np.zeros(BUCKETS), float(np.log((y.mean() + 0.01) / (1.01 - y.mean()))))
    for step in range(steps):
        z = e @ w
        value = _gathered(owner_word, z, grams, len(n_grams)) / n_grams
        logit = _means(value[word], span) + bias
        if step < steps // 8:
            # At first all spans of a text stand for it alike; later the one that decides.
            chosen, share = lone, 1.0 / np.diff(base)[rows][owner]
            of = owner
        else:
            top = np.maximum.reduceat(logit, base[rows])
            hit = np.flatnonzero(logit == top[owner])
            of, at = np.unique(owner[hit], return_index=True)
            chosen, share = hit[at], np.ones(len(of))
        error = (sigmoid(logit[chosen]) - target[of]) * weight[of] * share / len(rows)
        per_word = _shared_out(chosen, error / SPAN, span, word, len(n_grams)) / n_grams
        per_bucket = _gathered(grams, per_word, owner_word, len(used))
        # The gradient of a bucket's embedding is its share of the error times the softmax's direction; that of the direction is the sum of the embeddings by those shares.
        d_w = per_bucket @ e
        me *= MOMENTUM
        me += per_bucket[:, None] * w[None, :]
        mw = MOMENTUM * mw + d_w / max(1.0, float(np.abs(e).max()))
        mb = MOMENTUM * mb + error.sum()
        e *= 1 - DECAY
        e -= RATE * SPAN * me
        w -= 0.02 * mw
        bias -= 0.3 * mb
    table = np.zeros(BUCKETS)
    table[used] = e @ w
    return Model(table, float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fits on the bounded sample (rows * SAMPLE_CHARS characters at most reach the driver)."""
    got = sample(docs, labels, label, rows).select("doc_id", "text", "y").toArrow().sort_by("doc_id")
    texts, y = got.column("text").combine_chunks(), got.column("y").to_numpy()
    del got
    return fit(texts, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row and its whole text; null and empty texts have the score of no words.

    Rows that repeat score alike; null ids stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                s = m.scores(*text_arrays(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return score(docs, train(docs, labels, rows=rows)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
