"""Sum-of-squares online packing of token sequences.

Each scan partition packs its own documents in order, with a level array: level[h] is the number of open windows filled to h ids.
A document's whole windows are cut off first. What is left, s ids, goes into the fill level h that minimises the sum of squares of
the level array after placing: moving a window from h to h + s changes that sum by 2 * (level[h + s] - level[h] + 1), closing one by
1 - 2 * level[h], opening one by 2 * level[s] + 1. At the end of a partition the windows still open are poured together: their pieces are cut freely into
full windows, and the last, shorter rest into sequences whose lengths are powers of two, which need no padding. So nothing is padded
at all, and only pieces of open windows are cut further.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, Rolling, lowered, slices, text_arrays, word_bounds

WINDOW = 2048
END_ID = 1
#: Words that a worker remembers the ids of, and ids of one remembered word; both only save time.
CACHE_WORDS = 400_000
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _SCHEMA.split(", ")])


#: 1 for ASCII letters, 2 for ASCII marks between which and a letter no id ever spans. Not the apostrophe (contractions) nor < > | (special tokens).
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<>|"]] = 2


class WordEncoder:
    """Ids of whole texts, encoding each distinct word once.

    This equals encoding a text at once for tokenizers that drop white space, fold case and never join ids across white space or from a letter to a mark, as
    word_bpe_49k does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; waiting threads cost CPU seconds
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        # All in one call, a blank between: no id spans a blank, so the place where an id starts tells its word.
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        start = np.fromiter((a for a, _ in got.offsets), np.int64, len(got.ids))
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        size = np.bincount(np.searchsorted(np.cumsum(length), start, "right"), minlength=len(words))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.array(got.ids, np.uint32)])
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """The ids of each row."""
        kind = _KIND[data]
        starts, ends, first = word_bounds(data, off, np.flatnonzero(kind[1:] * kind[:-1] == 2) + 1)
        if not len(starts):
            return [np.empty(0, np.uint32)] * (len(off) - 1)
        # Case does not tell ids apart but in the special tokens' own names.
        text = data if b"<|" in (raw := data.tobytes()) else lowered(data)
        hashes, where, inverse = np.unique(Rolling(text).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        slot = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
        new = self.keys[slot] != hashes if len(self.keys) else np.ones(len(hashes), bool)
        if new.any():
            self._learn(hashes[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            slot = np.searchsorted(self.keys, hashes)
        size, at = self.size[slot][inverse], self.at[slot][inverse]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(at - stop + size, size) + np.arange(stop[-1])]
        bounds = np.concatenate([[0], stop])[first]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class SumOfSquares:
    """The online packer of one partition. Windows hold (document, start, length) pieces; ids are not kept."""

    def __init__(self, window: int = WINDOW):
        self.window, self.level = window, np.zeros(window, np.int64)
        self.open: dict[int, list[list[tuple[int, int, int]]]] = {}

    def place(self, piece: tuple[int, int, int]) -> list[tuple[int, int, int]] | None:
        """Puts a piece shorter than a window somewhere; returns a window that is now full."""
        w, s, level = self.window, piece[2], self.level
        cost = np.full(w - s + 1, np.iinfo(np.int64).max)
        cost[1 : w - s] = 2 * (level[s + 1 :] - level[1 : w - s] + 1)
        cost[w - s] = 1 - 2 * level[w - s]
        cost[1:][level[1 : w - s + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * level[s] + 1
        h = int(np.argmin(cost))
        pieces = self.open[h].pop() if h else []
        level[h] -= h > 0
        pieces.append(piece)
        if h + s == w:
            return pieces
        level[h + s] += 1
        self.open.setdefault(h + s, []).append(pieces)
        return None

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """All open windows, poured into full ones and then into powers of two."""
        left = [p for h in sorted(self.open) for pieces in self.open[h] for p in pieces]
        total, done = sum(p[2] for p in left), 0
        size = lambda: self.window if total - done >= self.window else 1 << ((total - done).bit_length() - 1)
        room, out = size() if total else 0, []
        for key, start, length in left:
            while length:
                n = min(room, length)
                out.append((key, start, n))
                start, length, room, done = start + n, length - n, room - n, done + n
                if not room:
                    yield out
                    out, room = [], size() if done < total else 0
        self.open.clear()
        self.level[:] = 0


def pack_partition(batches: Iterator[pa.RecordBatch], path: str, window: int = WINDOW, end_id: int = END_ID) -> Iterator[pa.RecordBatch]:
    """The pieces of a partition's documents. Held between batches: the open windows, and the ids of documents in them."""
    from pyspark import TaskContext

    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 33
    encoder, packer = WordEncoder(path), SumOfSquares(window)
    held: dict[int, tuple[int | None, np.ndarray, int, int]] = {}  # by piece: doc_id, ids, their start in the document, the document's number of ids
    rows: list[tuple] = []

    def close(pieces: list[tuple[int, int, int]]) -> None:
        nonlocal number
        at = 0
        for key, start, length in pieces:
            doc, ids, base, total = held[key]
            rows.append((doc, start, length, zlib.crc32(ids[start - base : start - base + length].astype("<u4").tobytes()), total, number, at))
            at += length
            if start + length == base + len(ids):
                del held[key]
        number += 1

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)
        rows.clear()
        return out

    serial = 0
    for batch in batches:
        for part in slices(batch, most=SLICE_BYTES):
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(*text_arrays(part.column("text"))), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    rows.append((doc, start, window, zlib.crc32(ids[start : start + window].astype("<u4").tobytes()), len(ids), number, 0))
                    number += 1
                if whole < len(ids):
                    serial += 1
                    held[serial] = (doc, ids[whole:].copy(), whole, len(ids))
                    if full := packer.place((serial, whole, len(ids) - whole)):
                        close(full)
            if len(rows) >= 20_000:
                yield flush()
    for pieces in packer.rest():
        close(pieces)
    if rows:
        yield flush()


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id; a null or empty text is end_id alone. Rows that repeat a doc_id are packed each. Null ids stay null. An
    empty table gives no rows; other columns are ignored. tokenizer is a path that every executor can open (installed with the library).
    The numbers of a partition's sequences start at its number * 2 ** 33. There is no shuffle; a lost task packs its split again, alike.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: pack_partition(batches, tokenizer, window, end_id), _SCHEMA)
