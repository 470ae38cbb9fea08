"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms of a document are pairs of neighbouring byte classes, how often its words recur in it, words that repeat the one before, and hashed words. A singular value
decomposition over a bounded sample of labelled rows, in one task, gives a projection to a few latent dimensions. The sample's projected vectors are broadcast (at most
SAMPLE_ROWS * RANK floats); every document of the table is projected and compared with all of them by exact cosine, in blocks of
one matrix product each, and its nearest neighbours vote with their similarities as weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_arrays, word_hashes
from .labelled import SAMPLE_ROWS, held_out, sample

RANK, NEIGHBOURS, THRESHOLD, SHARPNESS = 48, 15, 0.5, 8.0
#: Documents that are compared with all labelled vectors at once.
BLOCK = 512
_WORD_DIMS, _RECUR_DIMS = 256, 20


def _classes() -> np.ndarray:
    """A class for each byte: lower, upper, digit, blank, line end, other controls, UTF-8 lead and follow; each punctuation byte has its own."""
    c = np.full(256, 5, np.int64)
    c[97:123], c[65:91], c[48:58], c[[32, 9]], c[[10, 13]] = 0, 1, 2, 3, 4
    c[128:192], c[192:] = 6, 7
    own = [b for b in range(33, 127) if not chr(b).isalnum()]
    c[own] = 8 + np.arange(len(own))
    return c


_CLASS = _classes()
_N_CLASS = int(_CLASS.max()) + 1
DIMS = _N_CLASS * _N_CLASS + _RECUR_DIMS + _WORD_DIMS


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of term weights for each text: square roots of shares, block by block; all zero for an empty text."""
    n = len(off) - 1
    out = np.zeros((n, DIMS), np.float32)
    if not len(data):
        return out
    c, row = _CLASS[data], np.repeat(np.arange(n), np.diff(off))
    same = row[1:] == row[:-1]
    pairs = (row[:-1] * _N_CLASS + c[:-1]) * _N_CLASS + c[1:]
    k = _N_CLASS * _N_CLASS
    out[:, :k] = np.bincount(pairs[same], minlength=n * k).reshape(n, k)
    words, first = word_hashes(data, off)
    if len(words):
        of = np.repeat(np.arange(n), np.diff(first))
        keys, inverse, count = np.unique(words ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        share = count[inverse] / np.diff(first)[of]
        bucket = np.clip(np.floor(np.log2(np.maximum(share, 1e-9)) + 12), 0, _RECUR_DIMS - 2).astype(np.int64)
        out[:, k : k + _RECUR_DIMS] = np.bincount(of * _RECUR_DIMS + bucket, minlength=n * _RECUR_DIMS).reshape(n, _RECUR_DIMS)
        again = np.flatnonzero((words[1:] == words[:-1]) & (of[1:] == of[:-1])) + 1
        out[:, k + _RECUR_DIMS - 1] = np.bincount(of[again], minlength=n)
        out[:, k + _RECUR_DIMS :] = np.bincount(of * _WORD_DIMS + (words % np.uint64(_WORD_DIMS)).astype(np.int64), minlength=n * _WORD_DIMS).reshape(n, _WORD_DIMS)
    for a, b, weight in ((0, k, 1.0), (k, k + _RECUR_DIMS, 0.8), (k + _RECUR_DIMS, DIMS, 0.4)):
        part = out[:, a:b]
        total = part.sum(1, keepdims=True)
        np.divide(part, total, out=part, where=total > 0)
        np.sqrt(part, out=part)
        part *= weight
    return out


@dataclass
class Model:
    mean: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, x: np.ndarray, leave_out: bool = False) -> np.ndarray:
        """Votes of each row's neighbours, from 0 to 1; a row without terms, or a model without labels, has the share of label 1."""
        out = np.full(len(x), self.prior)
        some = np.flatnonzero(x.any(1))
        if not len(self.vectors) or not len(some):
            return out
        for at in range(0, len(some), BLOCK):
            rows = some[at : at + BLOCK]
            cos = self.latent(x[rows]) @ self.vectors.T
            if leave_out:
                cos[np.arange(len(cos)), rows] = -2
            k = min(NEIGHBOURS, cos.shape[1])
            near = np.argpartition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k :]
            weight = np.maximum(np.take_along_axis(cos, near, 1), 1e-6).astype(float) ** SHARPNESS
            out[rows] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def fit(x: np.ndarray, y: np.ndarray, rank: int = RANK) -> Model:
    if not len(x):
        return Model(np.zeros(DIMS, np.float32), np.zeros((DIMS, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), 0.5)
    mean = x.mean(0)
    centred = x - mean
    values, axes = np.linalg.eigh((centred.T @ centred).astype(np.float32))
    model = Model(mean, np.ascontiguousarray(axes[:, ::-1][:, :rank]), np.zeros((0, 0)), y.astype(float), float(y.mean()))
    model.vectors = model.latent(x)
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x = features(*text_arrays(part.column("text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])


_MODEL = "mean binary, projection binary, vectors binary, labels binary, prior double"


def _fitted(table: pa.Table) -> pa.Table:
    """A model, as one row, of rows (doc_id, y, x)."""
    table = table.sort_by("doc_id")
    x, y = np.empty((table.num_rows, DIMS), np.float32), table.column("y").to_numpy()
    for n, row in enumerate(table.column("x")):
        x[n] = np.frombuffer(row.as_buffer(), np.float16)
    m = fit(x, y)
    arrays = [np.ascontiguousarray(a) for a in (m.mean.astype(np.float32), m.projection.astype(np.float32), m.vectors.astype(np.float32), m.labels.astype(float))]
    return pa.table([*(pa.array([a.tobytes()], pa.binary()) for a in arrays), pa.array([m.prior])], names=["mean", "projection", "vectors", "labels", "prior"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fits on the bounded sample, in one task that gets its term weights, rows * DIMS half floats at most; the driver gets the model alone."""
    found = sample(docs, labels, label, rows).mapInArrow(_feature_rows, "doc_id long, y int, x binary").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fitted, _MODEL).first()
    if found is None:
        return fit(np.zeros((0, DIMS), np.float32), np.zeros(0))
    mean, projection, vectors = (np.frombuffer(found[c], np.float32) for c in ("mean", "projection", "vectors"))
    rank = len(projection) // DIMS
    return Model(mean, projection.reshape(DIMS, rank), vectors.reshape(-1, rank), np.frombuffer(found["labels"], float), found["prior"])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted for every row, whole texts, with further columns named in keep.

    A null or empty text scores the share of label 1 in the sample. Rows that repeat score alike; null ids stay. Columns of docs not named are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "text", *(c for c in keep if c not in ("doc_id", "text"))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select("doc_id", *(c for c in keep if c != "doc_id")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                s = m.scores(features(*text_arrays(part.column("text"))))
                cols = [part.column("doc_id"), *(part.column(c) for c in keep if c != "doc_id")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", *(c for c in keep if c != "doc_id"), "score", "predicted"])

    return docs.select(*names).mapInArrow(run, f"{schema}, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose text scores THRESHOLD or more; a null or empty text counts as score() says."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(m.scores(features(*text_arrays(part.column("text")))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return score(docs, train(docs, labels, rows=rows)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
