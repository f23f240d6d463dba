"""Winnowing against a search for every window."""

import random
import re

import pytest

pytest.importorskip("fiscalis.llm")

from fiscalis.llm.decontamination import contaminated_words, contamination_digest  # noqa: E402


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            size = min(10, len(v))
            runs = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
            for i in range(len(w) - size + 1 if size else 0):
                if tuple(w[i:i + size]) in runs:
                    hit.update(range(i, i + size))
                    found.add(str(item_id))
        spans = []
        for i in sorted(hit):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out.append((doc_id, len(w), spans, sorted(found)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "Ñu", "a1", "É", "x", "longer", "THE", "ﬀ"]
    items = [(i, rng.choice([" ", "--", "\n"]).join(rng.choices(vocabulary, k=rng.choice([1, 2, 4, 9, 10, 11, 25, 40])))) for i in range(40)]
    items += [(40, None), (41, "?!"), (42, items[3][1]), (42, items[3][1]), (None, "x x x x x x x x x x x"), (43, "the of the of the of the of the of the of the")]
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 20, 80])))
        for _ in range(rng.randint(0, 3)):
            passage = re.split(r"[ \n-]+", rng.choice(items)[1] or "")
            lo = rng.randint(0, len(passage) // 2)
            text += "! " + " ".join(passage[lo:lo + rng.choice([5, 9, 10, 12, 40])]) + " q" + str(i)
        docs.append((i, text))
    docs += [(200, None), (201, ""), (7, "the of " * 3000), (7, items[5][1]), (7, items[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "'a' AS item_id", "2 AS n_words")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS h", "'z' AS doc_id")
    judged = contaminated_words(d, b)
    got = sorted([(r.doc_id, r.n_words, [list(s) for s in r.hits], r["items"]) for r in judged.collect()], key=str)
    assert got == brute(docs, [(i, t) for i, t in items if i is not None])
    assert {r.contaminated for r in contamination_digest(judged).collect()} == {True, False}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    assert contaminated_words(docs, items).count() == 0
    assert [r.n_hit for r in contamination_digest(contaminated_words(some, items)).collect()] == [0]
    assert contaminated_words(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_items_without_id(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(None, passage), (None, "two words"), (5, "of " + passage), (6, "other " * 10)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "here two words stand"), (3, "nothing of it"), (None, passage)], "doc_id long, text string")
    judged = contaminated_words(docs, items, nameless=True)
    got = {r.doc_id: ([list(x) for x in r.hits], r["items"]) for r in judged.collect()}
    assert got == {1: ([[1, 13]], ["5"]), 2: ([[1, 3]], []), 3: ([], []), None: ([[0, 12]], ["5"])}
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in contamination_digest(judged).collect()} == {
        1: (12, 2, True), 2: (2, 1, True), 3: (0, 0, False), None: (12, 2, True)}
