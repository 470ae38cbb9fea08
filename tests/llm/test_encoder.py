"""The word-wise encoder gives the ids of whole texts."""

from __future__ import annotations

import random

import pyarrow as pa

from skein.llm.common import text_arrays
from skein.llm.packing import WordEncoder


def test_same_ids_as_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(3)
    parts = ["don't", "I'LL", "it's.", "a.b", "x,", "...'s", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "é", ",́", " ", "ß", "İ", "Σ", "ΑΣ ", "12,5", "a1b", "%%%", " ", "漢字", "'", "'.d", "\n", "\t", " ", "  ", "|", "<", "\x1c", "\x85"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(400)] + ["", "A" * 3000, None]
    texts = [*texts[:200], *["plain Words, plain words."] * 3, *texts[200:]]
    t, e = Tokenizer.from_file(path), WordEncoder(path)
    for k in range(0, len(texts), 50):
        part = texts[k : k + 50]
        for text, ids in zip(part, e.encode(*text_arrays(pa.array(part, pa.string()))), strict=True):
            assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)
