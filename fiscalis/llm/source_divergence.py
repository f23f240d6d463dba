"""Divergence of the sources within each language, from exact term counts.

Terms are keyed by their language, so one CountVectorizer counts for all languages at once, each term by the
documents of its language alone. The terms of `min_docs` documents or more are counted as a table, and the
vectorizer is fitted on them, without a limit of their number. Its model
builds the sparse vectors of the documents of a source in a slice of some MB, where a term that stands n times is handed over once for each
bit of n, and vectors are summed by source and place, in each task first: no group is ever a
dense vector. The vocabulary is dealt by term hash into shards of about `SHARD_TERMS` terms, and
one model is made a shard, so that the driver and each task hold one shard, however large the corpus. Counts stay exact as
doubles below 2^53 a batch.

A term's share in a group is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N being the group's counted
terms and V the language's vocabulary; two shares differ by floor((p - q)^2 / (p + q)). The
sum over a vocabulary is taken from counted terms only: with z the share of an absent term and
f0 the difference of two of them,

    V f0 + sum over A [f(pa, zb) - f0] + sum over B [f(za, pb) - f0] + sum over both [f(pa, pb) - f(pa, zb) - f(za, pb) + f0]

The single sums go over a group's distinct counts, the last one over terms that both sources hold.

Results for odd input: NULL text, language and source are empty texts, which name a group like any
other; texts without terms leave their group with counts of 0; a language without kept terms has pairs of value 0 and no
terms; equal rows are documents of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscalis.session import cut

from .common import row_slices

SHARD_TERMS = 1 << 20
HELD_TERMS, HELD_LANGS = 400_000, 2_000  # what a task counts before it passes its counts on
SCALE = 1_000_000_000
ALL_TERMS = (1 << 31) - 1
MARK = b"\0"  # stands in no term
SLICE = 8 << 20
ROW_TERMS = 256  # terms of a row for the vectorizer, so that a batch of rows stays small

# Bytes that stand in no term become spaces, A-Z become a-z; bytes of longer characters stay.
FOLD = bytes(32 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if c <= 0x5A else c for c in range(256))


def _words(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[bytes]]]:
    """Language and terms of each row of (lang, source, text)."""
    for lang, text in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
        yield lang, text.as_py().translate(FOLD).split()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to (lang, term, n): the documents of each term in this task, in pieces."""
    held: dict[bytes, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            terms = list(counts)
            for lo in range(0, len(terms), 50_000):
                part = terms[lo:lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.binary()).cast(pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                                                  pa.array([counts[t] for t in part], pa.int64())], ["lang", "term", "n"])
    for batch in batches:
        for lang, words in _words(batch):
            held.setdefault(lang, Counter()).update(set(words))
            if len(held[lang]) > HELD_TERMS or len(held) > HELD_LANGS:
                yield from rows()
                held.clear()
    yield from rows()


def _keyed(shards: int, shard: int):
    """Documents to (source, times, keyed): distinct terms of a shard that stand in a slice's documents of a source, each behind
    its language. A row has terms whose count holds the bit `times`, so each row with a term stands for so many of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.binary_length(whole.column(2)).to_numpy(zero_copy_only=False)
            for lo, hi in row_slices(np.r_[0, np.cumsum(sizes)], SLICE):
                batch, held = whole.slice(lo, hi - lo), {}
                for source, (lang, words) in zip(batch.column(1).to_pylist(), _words(batch), strict=True):
                    held.setdefault((source, lang), Counter()).update(words)
                terms, ends, sources, times = [], [0], [], []
                for (source, lang), counts in held.items():
                    key, bit = lang + MARK, 1
                    left = {w: n for w, n in counts.items() if crc32(w) % shards == shard} if shards > 1 else counts
                    while left:
                        some = [key + w for w, n in left.items() if n & bit]
                        for at in range(0, len(some), ROW_TERMS):
                            terms += some[at:at + ROW_TERMS]
                            ends.append(len(terms))
                            sources.append(source)
                            times.append(bit)
                        bit *= 2
                        left = {w: n for w, n in left.items() if n >= bit}
                keyed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(times, pa.int64()), keyed], ["source", "times", "keyed"])
    return run


def _group_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse vectors (source, times, vector) to their sums by source and place, a batch at a time."""
    for batch in batches:
        sources, times, vectors = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), batch.column(2)
        places = vectors.field("indices")
        sizes = pc.list_value_length(places).to_numpy()
        at, n = places.flatten().to_numpy(), vectors.field("values").flatten().to_numpy() * np.repeat(times, sizes)
        group = np.repeat(sources.indices.to_numpy().astype(np.int64), sizes)
        keys, back = np.unique(group << 32 | at, return_inverse=True)
        sums = np.bincount(back, n, len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([sources.dictionary.take(pa.array(keys >> 32)), pa.array(keys & 0xFFFFFFFF).cast(pa.int32()), pa.array(sums)], ["source", "at", "n"])


def group_counts(documents: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, source, term, n): how often each kept term stands in each group of (lang, source, text), zeros left out."""
    spark, parts = documents.sparkSession, []
    kept = cut(spark, documents.mapInArrow(_document_counts, "lang string, term string, n bigint").groupBy("lang", "term").agg(F.sum("n").alias("n")).where(
        F.col("n") >= min_docs).select("lang", "term"), "vocabulary")
    shards = math.ceil(kept.count() / SHARD_TERMS)
    for shard in range(shards):
        # Fitted on the kept terms, one a document: a vocabulary without a limit, which stays in the JVM.
        terms = kept.where(F.crc32(F.col("term").cast("binary")) % shards == shard)
        keys = terms.select(F.array(F.concat("lang", F.lit(MARK.decode()), "term")).alias("keyed"))
        model = CountVectorizer(inputCol="keyed", outputCol="vector", minDF=1.0, vocabSize=ALL_TERMS).fit(keys)
        # Handed on whole: each field of it would build the vector again.
        vectors = model.transform(documents.mapInArrow(_keyed(shards, shard), "source string, times bigint, keyed array<string>")).select("source", "times", F.unwrap_udt("vector"))
        sums = vectors.mapInArrow(_group_sums, "source string, at int, n bigint").groupBy("source", "at").agg(F.sum("n").alias("n"))
        named = [key.rpartition(MARK.decode()) for key in model.vocabulary]
        names = spark.createDataFrame(pa.table({"at": pa.array(range(len(named)), pa.int32()), "lang": [n[0] for n in named], "term": [n[2] for n in named]}))
        parts.append(cut(spark, sums.join(names, "at").select("lang", "source", "term", "n"), "group-counts"))
    if not parts:
        return spark.createDataFrame([], "lang string, source string, term string, n bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exact for any long."""
    top = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(kept > 0, F.floor(_quotient(top, (total + 2 * kept).cast("decimal(20,0)"))).cast("long") + 1)


def _quotient(top: Column, bottom: Column) -> Column:
    return F.call_function("div", top, bottom)


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares, which are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, min_docs: int = 10, top_terms: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of each group's language by divergence, and its own strongest terms."""
    spark = docs.sparkSession
    documents = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = cut(spark, group_counts(documents, min_docs), "term-counts")
    whole = cut(spark, counts.groupBy("lang", "term").agg(F.sum("n").alias("n")), "language-counts")
    langs = whole.groupBy("lang").agg(F.count("term").alias("kept"), F.sum("n").alias("total"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = cut(spark, documents.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(
        langs.select("lang", "kept"), "lang", "left").select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept")).withColumn(
        "absent", _share(zero, F.col("total"), F.col("kept"))), "groups")
    shares = cut(spark, counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "absent"), "shares")

    a = groups.select("lang", F.col("source").alias("a"), "kept", F.col("absent").alias("za"))
    b = groups.select("lang", F.col("source").alias("b"), F.col("absent").alias("zb"))
    pairs = cut(spark, a.join(b, "lang").where("a != b"), "source-pairs")
    none = difference(F.col("za"), F.col("zb"))
    # A group's terms against the absent share of each other source, by distinct shares.
    steps = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("term").alias("n"))
    single = pairs.join(steps, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("n") * (difference(F.col("p"), F.col("zb")) - none)).alias("single"))
    # Terms that two sources share, each pair once.
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("absent").alias("za"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("absent").alias("zb"))
    gain = difference(F.col("pa"), F.col("pb")) - difference(F.col("pa"), F.col("zb")) - difference(F.col("za"), F.col("pb")) + none
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(gain).alias("both"))
    single, both = cut(spark, single, "single-sums"), cut(spark, both, "shared-sums")
    mirrored = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    back = single.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("single").alias("back"))
    on = ["lang", "a", "b"]
    valued = pairs.join(single, on, "left").join(back, on, "left").join(mirrored, on, "left")
    value = F.coalesce(F.col("kept") * none, zero) + F.coalesce("single", zero) + F.coalesce("back", zero) + F.coalesce("both", zero)
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair_rows = valued.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value")).withColumn(
        "rank", F.row_number().over(by_value))

    usual = whole.join(langs, "lang").select("lang", "term", _share(F.col("n"), F.col("total"), F.col("kept")).alias("q"))
    strong = shares.join(usual, ["lang", "term"]).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    term_rows = strong.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)
    return pair_rows.unionByName(term_rows)
