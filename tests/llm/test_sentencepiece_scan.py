"""Max-plus encoding against a plain left-to-right search, and exact round trips."""

import random

import numpy as np
import pytest

pytest.importorskip("fiscalis.llm")

from pyspark.sql import functions as F  # noqa: E402

from fiscalis.llm import sentencepiece_scan as q  # noqa: E402

PARTS = ["a", "the", "in", "ing", "  ", "\n", "▁", "😀", "é", "tion", "----", "x", " ", "\x00", "<0x0A>", "</s>", "中"]


def plain(text, pieces, vocabulary):
    codes = q.code_points(" " + text)
    n, best, last = len(codes), [0.0], [0]
    for j in range(1, n + 1):
        top, take = None, 0
        for size in range(min(j, vocabulary.longest), 0, -1):
            piece = "".join(chr(c) if c != q.LITERAL else "\ud800" for c in codes[j - size:j])
            score = pieces[piece][1] if piece in pieces else vocabulary.unknown if size == 1 else None
            if score is not None and (top is None or best[j - size] + score > top):
                top, take = best[j - size] + score, size
        best.append(top)
        last.append(take)
    out, j = [], n
    while j:
        piece = "".join(chr(c) if c != q.LITERAL else "\ud800" for c in codes[j - last[j]:j])
        out.append([pieces[piece][0]] if piece in pieces else [vocabulary.byte_ids[b] for b in (" " + text)[j - 1].encode()])
        j -= last[j]
    return [i for ids in reversed(out) for i in ids], best[n]


@pytest.fixture(scope="module")
def model():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=q.MODEL_FILE)
    pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    return q.load_vocabulary(), pieces


@pytest.mark.parametrize("chunk", [1, 20, 37, 512])
def test_against_plain_search(model, chunk):
    vocabulary, pieces = model
    rng = random.Random(chunk)
    for k in range(40):
        text = "".join(rng.choices(PARTS, k=rng.randint(1, 150)))
        if k % 3 == 0:
            text = text.replace(" ", "") or "x"
        vocabulary.ids_of.clear()
        ids, score = q.encode([text], vocabulary, chunk)[0]
        assert (np.frombuffer(ids, dtype=np.int32).tolist(), score) == plain(text, pieces, vocabulary)
        assert q.decode(ids, vocabulary) == text


def test_ties_and_crossing_pieces():
    """A vocabulary with equal scores and a piece across a space: texts can't be cut there."""
    pieces = {"▁": (0, -1.0), "a": (1, -1.0), "b": (2, -1.0), "ab": (3, -2.0), "aa": (4, -2.0), "aab": (5, -3.0), "b▁a": (6, -0.5), "▁a": (7, -2.0)}
    vocabulary = q.build_vocabulary(pieces, [p.replace("▁", " ").encode() for p in pieces] + [bytes([i]) for i in range(256)], list(range(8, 264)))
    assert not vocabulary.splits
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choices("aab é", k=rng.randint(1, 60)))
        for chunk in (3, 5, 512):
            vocabulary.ids_of.clear()
            ids, score = q.encode([text], vocabulary, chunk)[0]
            assert (np.frombuffer(ids, dtype=np.int32).tolist(), score) == plain(text, pieces, vocabulary)
            assert q.decode(ids, vocabulary) == text


def test_running_products():
    rng = np.random.RandomState(1)
    matrices = rng.randint(-9, 9, (11, 4, 4)).astype(float)
    one = matrices[0]
    for i, found in enumerate(q.running_products(matrices)):
        if i:
            one = np.array([[max(one[s, k] + matrices[i][k, t] for k in range(4)) for t in range(4)] for s in range(4)])
        assert (found == one).all()


def test_rows(spark, model):
    vocabulary, _ = model
    texts = [None, "", " ", "a", "a", "x" * 30_000 + " y", "the cat\t\n ▁ 😀 " * 400, "  lead", "trail  "]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS score", "'x' AS round_trip")
    coded = q.encode_texts(df, vocabulary, [F.col("doc_id"), F.col("text")])
    rows = coded.collect()
    assert [r.text for r in rows] == texts and all(r.round_trip for r in rows)
    assert [r.n_pieces for r in rows[:2]] == [0, 0] and all(len(r["ids"]) == r.n_pieces for r in rows)
    back = q.decode_ids(coded.drop("text"), vocabulary, [F.col("doc_id")]).collect()
    assert [r.text for r in back] == [t or "" for t in texts]
    digest = q.encode_texts(df, vocabulary, [F.col("doc_id")], digest=True).collect()
    assert digest[3]["ids"] == digest[4]["ids"] and len(digest[0]["ids"]) == 64
    assert q.encode_texts(df.where("false"), vocabulary, [F.col("doc_id")]).count() == 0


@pytest.mark.parametrize("giant,band", [(40, 2), (100, 3), (700, 64)])
def test_giant_texts_over_many_tasks(spark, model, monkeypatch, giant, band):
    """Chunks as rows, in tasks of their own, against the plain search."""
    vocabulary, pieces = model
    monkeypatch.setattr(q, "GIANT", giant)
    monkeypatch.setattr(q, "BAND", band)
    rng = random.Random(giant)
    texts = ["".join(rng.choices(PARTS, k=n)) for n in (5, 60, 300, 900, 1500)] + ["the cat in the hat " * 60, "x" * 800, None, "a" * (2 * giant - 1), "a" * (2 * giant - 2)]
    texts += [texts[2], texts[2]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS number", "2 AS c", "'x' AS part", "'y' AS keep")
    got = {r.doc_id: r for r in q.encode_texts(df.repartition(3), vocabulary, [F.col("doc_id"), F.col("number"), F.col("keep")]).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain(t, pieces, vocabulary) if t else ([], 0.0)
        assert got[i]["ids"] == want[0] and got[i].score == pytest.approx(want[1], rel=1e-12) and got[i].round_trip and got[i].n_pieces == len(want[0]), i
    digest = {r.doc_id: r.ids for r in q.encode_texts(df, vocabulary, [F.col("doc_id")], digest=True).collect()}
    assert digest[2] == digest[10] == digest[11] == __import__("hashlib").sha256(np.array(got[2]["ids"], dtype=np.int32).tobytes()).hexdigest()
    chunks = q._encode_giants(df.where("text IS NOT NULL AND length(text) > 200").select(F.col("doc_id").alias("number"), "text"), vocabulary)
    assert chunks.selectExpr("max(size(ids))").first()[0] > 1


def test_segments_are_decoded_once_and_frequent_ones_stay_remembered(model, monkeypatch):
    vocabulary, _ = model
    monkeypatch.setattr(q, "REMEMBER", 3)
    vocabulary.ids_of.clear()
    texts = ["the words of a text", "", None, "the  other wörds 😀", "x" * 1300 + " the"]
    for _ in range(2):
        found = q.encode_and_decode(texts, vocabulary)
        assert [back for _, _, back in found] == [t or "" for t in texts]
        assert [q.decode(ids, vocabulary) for ids, _, _ in found] == [t or "" for t in texts]
    solved, plain_solver = [], q.encode_short
    monkeypatch.setattr(q, "encode_short", lambda segments, v: solved.extend(segments) or plain_solver(segments, v))
    q.encode_and_decode(["the new", "the text"], vocabulary)
    assert solved == [" new"] and set(vocabulary.ids_of) == {" the", " text", " new"}
