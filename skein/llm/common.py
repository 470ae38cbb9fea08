"""What the corpus operators share: the shared work folder, Arrow text access and vectorised hashing.

All Python here works on whole Arrow batches with numpy; nothing loops over words or bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder

#: Bytes of text that are handled at once in a Python worker.
SLICE_BYTES = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word, as all contracts of this package define it.
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one where none is set and the session is on one machine, as in tests."""
    return shared_folder(spark)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """A folder of written tables. Writing a table cuts its lineage; losing an executor loses none of it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self._n = spark, f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex[:12]}", 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes a table and reads it back. Nothing reads the shuffle files of the write again, so they go when it is done."""
        self._n += 1
        path, conf = f"{self.path}/{self._n:03d}-{name}", self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._skein_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            if path := getattr(t, "_skein_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


# ---------------------------------------------------------------- SQL expressions


def ascii_lower(col):
    return F.translate(col, _UPPER, _LOWER)


def crc_mod(doc_id, m: int):
    """crc32(doc_id as text) mod m; the text of a null id is empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


# ---------------------------------------------------------------- Arrow text


def text_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's bounds; null counts as empty."""
    col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows, at about `most` bytes of text; a longer text stands alone and whole."""
    _, off = text_arrays(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


# ---------------------------------------------------------------- hashing

_RNG = np.random.default_rng(0x5EED)
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_TABLE = np.arange(256, dtype=np.uint8)
_LOWER_TABLE[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int, inverse: bool = False) -> np.ndarray:
    k = int(inverse)
    if len(_powers[k]) < n:
        size = 1 << (n - 1).bit_length()
        base = np.full(size, _BASE_INV if inverse else _BASE, np.uint64)
        base[0] = 1
        _powers[k] = np.cumprod(base, dtype=np.uint64)
    return _powers[k][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of any ranges of a byte string in constant time each: prefix sums of random byte codes times powers."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * _power(n), out=self.sums[1:])
        self.inverse = _power(n + 1, True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER_TABLE[data]


def word_bounds(data: np.ndarray, off: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and, for each row, the number of words before it (one more at the end).

    cuts: bytes that start a word of their own although no space stands before.
    """
    if not len(data):
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    if cuts is not None:
        edge[cuts] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    start = inside & (~before | edge[:-1])
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    end = inside & (~after | edge[1:])
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all rows, and the number of words before each row."""
    starts, ends, first = word_bounds(data, off)
    if not len(starts):
        return np.empty(0, np.uint64), first
    return Rolling(lowered(data)).of(starts, ends), first


_WEIGHTS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of `width` words; a shorter row that has words is one run."""
    words, first = word_hashes(data, off)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        runs += words[k : k + len(runs)] * _WEIGHTS[k]
    runs = mix64(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * _WEIGHTS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64((b - a) << 32)
            out.append(mix64(short))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def spanning(linked: np.ndarray, q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest that connects what a block's links connect, at most one a vector."""
    rows, cols = np.nonzero(linked)
    if not len(rows):
        return rows, rows
    label = np.concatenate([q, y])
    while True:
        before = label.copy()
        low = np.minimum(label[rows], label[len(q) + cols])
        np.minimum.at(label, rows, low)
        np.minimum.at(label, len(q) + cols, low)
        if (before == label).all():
            break
    ids = np.concatenate([q, y])
    moved = label < ids
    return ids[moved], label[moved]
