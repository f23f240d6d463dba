"""The corpus pipeline on the smallest tables: each stage against brute force on its own input."""

import os
import re

import pytest
from compare import connect
from pyspark.sql import functions as F

from fiscalis.session import BATCH_CONF, BATCH_ROWS, bounded_batches, shared_dir

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("fiscalis.llm")

from test_decontamination import brute as contaminated  # noqa: E402
from test_minhash_dedup import brute as components  # noqa: E402
from test_secret_scan import base  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of each stage; a few rows are added to the documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    some = max(texts.values(), key=len)
    passage = " ".join(connect(SF).sql("SELECT text FROM benchmark ORDER BY length(text) DESC LIMIT 1").fetchall()[0][0].split()[:12])
    extra = [(9001, some, "en", "s", 1), (9002, some + " one more word", "en", "s", 1), (9003, f"{min(texts.values(), key=lambda t: abs(len(t) - 900))} {passage}", None, "s", 1),
             (9004, None, None, None, None), (9005, None, "en", "s", 0), (9006, "the password=abcdefghijklmnopq1 stands in this text and nothing else of note does", "en", "s", 5),
             (9006, "the password=abcdefghijklmnopq1 stands in this text and nothing else of note does", "en", "s", 5)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.cut(spark, stage(spark, docs, SF), name)
        out[name] = (before, docs)
    return out


def test_columns(steps):
    for name, (before, after) in steps.items():
        if name != "encoding":
            assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_quality(spark, steps):
    before, after = steps["quality"]
    kept, all_rows = rows(after), rows(before)
    assert set(kept) <= set(all_rows) and len(kept) > 0.6 * len(all_rows)
    label = dict(rows(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")))
    ids = {r[0] for r in kept}
    good, bad = [i for i in label if label[i] == 1], [i for i in label if label[i] == 0]
    assert sum(i in ids for i in good) >= 0.98 * len(good)
    assert sum(i in ids for i in bad) <= 0.2 * len(bad)


def test_near_duplicates(steps):
    before, after = steps["near_duplicates"]
    docs = [(r[0], r[1]) for r in rows(before)]
    want = {key for key, _, _, kept in components(docs, n=5) if kept}
    got = [r[0] for r in rows(after)]
    assert set(got) == want and len(got) == len(set(got))
    assert set(rows(after)) <= set(rows(before))


def test_decontamination(spark, steps):
    before, after = steps["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {key for key, _, spans, _ in contaminated([(r[0], r[1]) for r in rows(before)], items) if spans}
    assert sorted(r[0] for r in rows(after)) == sorted(r[0] for r in rows(before) if r[0] not in dirty)
    assert dirty and set(rows(after)) <= set(rows(before))


def test_secrets(steps):
    before, after = steps["secrets"]
    found = {r[0]: r for r in rows(after)}
    changed = 0
    for key, text, *_ in rows(before):
        spans, plain, at = base(text), "", 0
        for a, _, b in sorted(spans):
            if a >= at:
                plain += (text or "")[at:a] + "[secret]"
            at = max(at, b)
        if text is None:
            assert found[key][1] is None
        else:
            plain += text[at:]
            changed += plain != text
            assert found[key][1] == plain or len(re.findall(r"\[secret\]", found[key][1])) > len(spans)
            assert found[key][4] == len(found[key][1])
    assert changed


def test_encoding(spark, steps):
    from fiscalis.llm.sentencepiece_scan import decode, load_vocabulary
    before, after = steps["encoding"]
    vocabulary, texts = load_vocabulary(), {r[0]: r[1] for r in rows(before)}
    got = after.collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.round_trip and len(r["ids"]) == r.n_pieces and decode(r["ids"], vocabulary) == (texts[r.doc_id] or "")


def test_registered():
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted({n.split("_")[0] for n in names}) == sorted([f"op{i}" for i in range(1, 14)] + ["pipeline"])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_decisions_are_by_row(spark):
    passage = " ".join(connect(SF).sql("SELECT text FROM benchmark ORDER BY length(text) DESC LIMIT 1").fetchall()[0][0].split()[:12])
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    body = [f"v{i}" for i in range(100)]
    near = [" ".join([*body, f"end{i}"]) for i in range(4)]

    def ids_and_texts(stage, docs):
        return sorted(((r.doc_id, r.text) for r in stage(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], schema), SF).collect()), key=str)
    assert ids_and_texts(corpus_pipeline.decontamination, [(None, f"so {passage}"), (None, "clean"), (7, f"so {passage}"), (7, "a clean row"), (8, "more")]) == [
        (7, "a clean row"), (8, "more"), (None, "clean")]
    # A near copy goes though its id has another row that stays; of near copies under one id one stays; NULL is the last id.
    left = ids_and_texts(corpus_pipeline.near_duplicate, [(1, near[0]), (2, near[1]), (2, "a row of its own"), (None, near[2]), (None, None), (None, "alone"), (None, "alone")])
    assert left == [(1, near[0]), (2, "a row of its own"), (None, "alone"), (None, None)]
    left = ids_and_texts(corpus_pipeline.near_duplicate, [(4, near[0]), (4, near[1]), (4, near[2]), (5, near[3])])
    assert len(left) == 1 and left[0][0] == 4


def test_columns_of_any_name_pass_unchanged(spark):
    names = ["_number", "number", "row", "_row", "_key", "key", "secret_spans", "_scan", "_base", "content", "hits", "score", "a.b", "bin"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        got = after.collect()
        assert got and all(r[n] == f"{n} of {r.doc_id}" for r in got for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_python_gets_batches_of_bounded_size(spark):
    """Whole rows of 10,000 documents at once, with their text beside them, filled an executor."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.conf.unset(BATCH_CONF)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name != "secrets":  # Spark functions only
                spark.conf.unset(BATCH_CONF)
                stage(spark, docs, SF)
                assert int(spark.conf.get(BATCH_CONF)) == BATCH_ROWS < 10_000
        for asked, held in (("7", "7"), ("0", str(BATCH_ROWS))):
            spark.conf.set(BATCH_CONF, asked)
            bounded_batches(spark)
            assert spark.conf.get(BATCH_CONF) == held
    finally:
        spark.conf.unset(BATCH_CONF)


@pytest.mark.parametrize("stage", ["near_duplicate", "decontamination"])
def test_tables_behind_a_decision_go_when_it_is_written(spark, stage):
    def tables():
        return set(os.listdir(shared_dir(spark)))
    before, docs = tables(), spark.read.parquet(f"{SF}/documents.parquet")
    left = getattr(corpus_pipeline, stage)(spark, docs, SF)
    decision = {"near_duplicate": "copies", "decontamination": "leaks"}[stage]
    assert sorted(name.rsplit("-", 1)[0] for name in tables() - before) == sorted([decision, "numbered"])
    assert 0 < left.count() <= docs.count()


def test_secrets_writes_each_text_once(spark):
    before, docs = set(os.listdir(shared_dir(spark))), spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.secrets(spark, docs, SF)
    written, = set(os.listdir(shared_dir(spark))) - before
    assert set(spark.read.parquet(f"{shared_dir(spark)}/{written}").columns) == {"row", "_scan"}
