"""The toxicity scorer against a plain one, and what must not change a score."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa


def model():
    from skein.llm import toxicity

    bad, good = ["you vile clot", "such vile people here", "a clot of vile words"], ["a calm day", "such kind people here", "many words of the day", "the sea is calm"]
    texts = bad * 6 + good * 6
    return toxicity.fit(texts, np.array([1] * (len(bad) * 6) + [0] * (len(good) * 6)))


def scores(m, texts):
    from skein.llm.common import text_arrays

    return m.scores(*text_arrays(pa.array(texts, pa.string())))


def test_scores_equal_a_plain_scorer():
    """A word's logit is the mean over its own n-grams; a text has that of its highest pair of neighbouring words."""
    from skein.llm import toxicity

    m = model()
    texts = ["You VILE clot", "vile", "", None, "  \t ", "a calm day by the sea, far from vile people", "vi1e cl0t", "x " * 999 + "vile clot" + " y" * 500, "é ü 漢字 vile"]

    def plain(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        logits = []
        for w in re.findall(r"[^\x20\x09-\x0D]+", low):
            grams, _ = toxicity.word_grams([w.encode()])
            logits.append(sum(m.table[g] for g in grams) / len(grams))
        size = toxicity.SPAN
        spans = [sum(logits[k : k + size]) / size for k in range(max(1, len(logits) - size + 1))] if logits else [0.0]
        return 1 / (1 + math.exp(-max(-40, min(40, max(spans) + m.bias))))

    assert np.allclose(scores(m, texts), [plain(t) for t in texts], atol=1e-9)
    assert scores(m, ["you vile clot"])[0] >= 0.7 > scores(m, ["a calm day"])[0]


def test_words_in_front_do_not_hide_a_toxic_text(spark):
    """Of the table's toxic documents, each also with one and two neutral words in front."""
    from skein.llm import toxicity

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = toxicity.train(docs, labels)
    toxic = [r.text for r in docs.join(labels.where("toxic = 1"), "doc_id").orderBy("doc_id").limit(40).collect()]
    before = scores(m, toxic) >= 0.7
    for words in ("and ", "and the ", "and the of "):
        assert (before != (scores(m, [words + t for t in toxic]) >= 0.7)).sum() <= 1
    assert before.mean() >= 0.6
