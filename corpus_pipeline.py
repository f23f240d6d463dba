"""Training-data pipeline: five stages over `documents`, each written and read again.

Every stage works on all rows that the one before kept. All but the last return
the columns of their input; rows and other columns pass unchanged, whatever they are called: a row travels
as one value beside the columns that a stage works on. The stages:

1. quality: rows that the classifier rejects go; it is fitted on the labels of `labels`.
2. near-duplicates: of each group of near-duplicates one row with the smallest doc_id stays
   (five-word shingles, similarity of 0.8 or more); NULL is the last doc_id.
3. decontamination: rows with a passage of `benchmark` go.
4. secrets: found spans are replaced by `[secret]` in the text, and n_chars follows.
5. encoding: the texts as SentencePiece ids, with the check that decoding gives the text back.

Results for odd input: NULL and empty texts are judged by the classifier as texts without patterns, are no
copies of anything, hold no passage and no secret, and encode to no ids; a NULL text stays NULL, and so does
its n_chars if there is nothing to count; very long texts are read whole; repeated rows are near-duplicates of each other, so one stays; rows
with equal or NULL doc_id are judged one by one; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalis.llm.common import table
from fiscalis.llm.decontamination import contaminated_words
from fiscalis.llm.minhash_dedup import near_duplicates
from fiscalis.llm.quality import fit_quality, score_quality
from fiscalis.llm.secret_scan import find_secrets, redact
from fiscalis.llm.sentencepiece_scan import encode_texts, load_vocabulary
from fiscalis.session import bounded_batches, cut, settled

# Words of a shingle and similarity (percent) of near-duplicates in this pipeline.
SHINGLE_WORDS, SIMILARITY = 5, 80


def _row(columns: list[str]) -> F.Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")


def _rows(picked: DataFrame) -> DataFrame:
    return picked.select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), "doc_id")
    scored = score_quality(docs.select(_row(docs.columns), "text"), model, [F.col("row")])
    return _rows(scored.where("predicted = 1"))


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, number): each row with a written number, by which decisions come back: doc_id may repeat or be NULL."""
    return cut(spark, docs.select(_row(docs.columns), F.monotonically_increasing_id().alias("number")), "numbered")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without words link with nothing and stay."""
    bounded_batches(spark)
    numbered, key = _numbered(spark, docs), F.col("row.doc_id")
    # Smallest id first, NULL last; rows under one id by their content, equal rows by their number.
    order = F.struct(key.isNull().alias("unnamed"), key.alias("id"), F.xxhash64("row").alias("content"), "number").alias("key")

    def copies() -> DataFrame:
        judged = near_duplicates(numbered.select(order, F.col("row.text").alias("text"), "number"), key="key", words=SHINGLE_WORDS, percent=SIMILARITY, row="number")
        return judged.where(~F.col("kept")).select("key.number")
    gone = settled(spark, copies, "copies")
    return _rows(numbered.join(gone, "number", "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    numbered = _numbered(spark, docs)

    def leaks() -> DataFrame:
        judged = contaminated_words(numbered.select("number", F.col("row.text").alias("text")), table(spark, sf_dir, "benchmark"), key="number", nameless=True)
        return judged.where(F.size("hits") > 0).select("number")
    gone = settled(spark, leaks, "leaks")
    return _rows(numbered.join(gone, "number", "left_anti"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The text is scanned and written inside its row, once.
    found = redact(find_secrets(docs.select(_row(docs.columns)), "row.text").withColumn("text", F.col("row.text")))
    fresh = {"text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)}
    return found.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return encode_texts(docs, load_vocabulary(), [F.col("doc_id"), F.col("lang"), F.col("source")])


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding)]

# Models, MinHash and encoding can't be said in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
