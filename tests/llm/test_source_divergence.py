import re
from collections import Counter

import pyarrow as pa
import pytest

from fiscalis.llm import source_divergence as sd

SCHEMA = "doc_id bigint, text string, lang string, source string, terms string, n int, p int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs=10):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(FOLD))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= min_docs}
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def diff(p, q):
            return (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = [(-sum(diff(share(c, t), share(counts[o], t)) for t in kept), o.encode(), o) for o in counts if o != s]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            terms = [(-diff(share(c, t), share(whole, t)), t.encode(), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:10], 1)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, *r, "x", 1, 2) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in sd.source_divergence(df, **more).collect())


def corpus():
    words = "uno dos tres CUATRO cinco. seis siete ocho nueve diez-once Ñandú straße".split()
    rows = []
    for i in range(150):
        n = 3 + i * 7 % 11
        rows.append((" ".join(words[(i * j + j * j) % len(words)] for j in range(n)), ("es", "de")[i % 5 == 0], f"s{i * i % 7}"))
    return rows


@pytest.mark.parametrize("shard_terms", [sd.SHARD_TERMS, 3])
def test_equals_plain(spark, monkeypatch, shard_terms):
    monkeypatch.setattr(sd, "SHARD_TERMS", shard_terms)
    monkeypatch.setattr(sd, "HELD_TERMS", 5 if shard_terms == 3 else sd.HELD_TERMS)
    assert found(spark, corpus()) == plain(corpus())


def test_terms_belong_to_their_language(spark):
    rows = [("gemeinsam wort", "de", "a")] * 9 + [("gemeinsam wort", "nl", "a")] * 11 + [("wort", "nl", "b"), ("nichts", "de", "b")]
    assert found(spark, rows) == plain(rows)


def test_odd_input(spark):
    rows = [(None, None, None), ("", "es", "a"), ("123 ...", "es", "b"), ("x" * 300_000, "es", None), (" a" * 100_000, "es", "a"), *[("B b c", None, "q$1\\")] * 12,
            *[("uno dos", "es", "a")] * 10, *[("uno tres", "es", "c")] * 4, ("dos", "es\0x", "a")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_shares_are_exact_for_huge_counts(spark):
    n, total, kept = 7_000_000_000_123_456, 9_000_000_000_000_001, 1_234_567
    got = spark.range(1).select(sd._share(sd.F.lit(n), sd.F.lit(total), sd.F.lit(kept))).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 2) // (total + 2 * kept)


def test_repeated_terms_are_handed_over_by_the_bits_of_their_counts():
    text = "the " * 1000 + "of " * 6
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 20, "source": ["a", "b"] * 10, "text": [text] * 20})
    rows = [r for out in sd._keyed(1, 0)(iter([batch])) for r in out.to_pylist()]
    for source in "ab":
        counts = {w: sum(r["times"] * r["keyed"].count(f"en\0{w}") for r in rows if r["source"] == source) for w in ("the", "of")}
        assert counts == {"the": 10_000, "of": 60}
    assert sum(len(r["keyed"]) for r in rows) == 2 * ((10_000).bit_count() + (60).bit_count())
    assert max(len(r["keyed"]) for r in rows) <= sd.ROW_TERMS
