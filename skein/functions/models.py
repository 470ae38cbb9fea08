"""Models from outside: embedding functions that run in workers, and language models that run on the driver and never in a plan."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

#: Texts that a model gets at once.
BATCH = 256


def embedder(load: Callable[[], Callable[[list[str]], list]], batch: int = BATCH, tries: int = 3, wait: float = 1.0) -> Callable[[Column], Column]:
    """A column function of texts to vectors. load() gives a worker its model, once for all its batches; the model maps a list of texts to vectors.

    A batch that fails is tried again, after a wait that doubles, and at last text by text; a text that still fails has a null vector. Null texts count as empty.
    """

    @pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def several(texts: list[str], left: int = tries) -> list | None:
            for k in range(left):
                try:
                    return list(model(texts))
                except Exception:
                    if k + 1 < left:
                        time.sleep(wait * 2**k)
            return None

        for texts in batches:
            all_texts, out = [t or "" for t in texts], []
            for at in range(0, len(all_texts), batch):
                part = all_texts[at : at + batch]
                got = several(part)
                out += got if got is not None else [(several([t], 1) or [None])[0] for t in part]
            yield pd.Series([None if v is None else [float(x) for x in v] for v in out], dtype=object)

    return run


def hashing_model(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic model without training: signed counts of words by hash, of unit length. A stand-in for tests and where no model is installed."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for k, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return run


class LanguageModel(Protocol):
    """What answers need of a language model."""

    def generate(self, query: str, context_documents: list[str], system_prompt: str | None = None, temperature: float = 0.3) -> str: ...

    def chat(self, messages: list[dict], temperature: float = 0.3) -> str: ...


MODELS: dict[str, Callable[..., LanguageModel]] = {}


def register(name: str, make: Callable[..., LanguageModel]) -> None:
    MODELS[name] = make


def language_model(name: str, **options) -> LanguageModel:
    """A registered model by name."""
    if name not in MODELS:
        raise ValueError(f"no language model {name!r}; known: {', '.join(sorted(MODELS)) or 'none'}")
    return MODELS[name](**options)


class Quoting:
    """A language model that only quotes what it is given: the first sentences of the context that share most words with the question."""

    def generate(self, query: str, context_documents: list[str], system_prompt: str | None = None, temperature: float = 0.3) -> str:
        asked = set(re.findall(r"\w+", query.lower()))
        sentences = [s.strip() for d in context_documents for s in re.split(r"(?<=[.!?])\s+|\n", d) if s.strip()]
        best = sorted(sentences, key=lambda s: -len(asked & set(re.findall(r"\w+", s.lower()))))[:3]
        return " ".join(best) or "Nothing about this is known."

    def chat(self, messages: list[dict], temperature: float = 0.3) -> str:
        return self.generate(messages[-1]["content"], [m["content"] for m in messages[:-1]])


register("quoting", Quoting)
