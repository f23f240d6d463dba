"""Language identification: held-out accuracy, the decoder against its formula, odd rows."""

import numpy as np
import pytest

pytest.importorskip("fiscalis.llm")

from pyspark.sql import functions as F  # noqa: E402

from fiscalis.llm import language_id as g  # noqa: E402
from fiscalis.llm.queries import LLM_QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = LLM_QUERIES["op1_language_id"].build(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(rows) == 1000 and len(held) > 150
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_codewords():
    assert g.codewords(1).shape == (1, 0) and g.codewords(0).shape[0] == 0
    assert g.codewords(4).shape == (4, 7)
    big = g.codewords(20)
    assert min((a != b).sum() for i, a in enumerate(big) for b in big[:i]) >= 12


def test_outputs_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.RandomState(1)
    model = g.Model(["a", "b"], np.array([[1], [-1]]), np.ones((2, 1)), rng.standard_normal((g.FEATURES, 1)).astype(np.float32))
    texts = [bytes(rng.randint(97, 123, n).astype(np.uint8)) for n in (0, 1, 2, 50, 0, 700, 3)]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    whole = g._outputs(data, offsets, model, g._folded())
    alone = [g._outputs(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]), model, g._folded())[0] for t in texts]
    monkeypatch.setattr(g, "BLOCK", 7)
    small = g._outputs(data, offsets, model, g._folded())
    assert np.allclose(whole, alone, atol=1e-5) and np.allclose(whole, small, atol=1e-5)


def test_odd_rows(spark):
    docs = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", "fr"), (5, "123 !?", None), (5, "der Hund", None),
            (None, "the dog and the cat " * 2000, ""), (7, "Ж", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'x' AS language", "true AS ambiguous")
    model = g.fit_languages(df)
    assert model.languages == ["en", "fr"]
    got = [(r.doc_id, r.lang_pred) for r in g.predict_languages(df, model, [F.col("doc_id")]).collect()]
    assert got[:5] == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und")] and got[6] == (None, "en") and got[7][1] in ("en", "fr")
    none = g.fit_languages(df.where("false"))
    assert {r.lang_pred for r in g.predict_languages(df, none, [F.col("doc_id")]).collect()} == {"und"}
    one = g.fit_languages(df.where("doc_id = 1"))
    assert [(r.lang_pred, r.score) for r in g.predict_languages(df.where("doc_id = 2"), one, [F.col("doc_id")]).collect()] == [("en", 1.0)]
