"""The quality model is fitted in a task; the driver gets the model, not the sample's term weights."""

from __future__ import annotations

import numpy as np


def test_the_driver_gets_the_model_alone(spark, monkeypatch):
    from skein.llm import quality
    from skein.llm.common import text_arrays

    words = ["buy now cheap", "the river runs", "42 x 7", "a quiet evening", "click HERE"]
    docs = spark.createDataFrame([(n, " ".join(words[(n * k) % 5] for k in range(1, 9))) for n in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)], "doc_id long, quality int")
    from skein.llm.labelled import sample

    rows = sample(docs, labels, "quality").orderBy("doc_id").toArrow()
    x = quality.features(*text_arrays(rows.column("text"))).astype(np.float16).astype(np.float32)
    want = quality.fit(x, rows.column("y").to_numpy())

    # Nothing but the one row of the model is fetched.
    monkeypatch.setattr(type(docs), "toArrow", lambda df: (_ for _ in ()).throw(AssertionError("fetched whole")))
    got = quality.train(docs, labels)
    assert got.vectors.shape == want.vectors.shape and got.prior == want.prior and (got.labels == want.labels).all()
    assert np.allclose(got.scores(x), want.scores(x), atol=1e-4)
