"""URL filters by a sort-merge range join.

A host is written as its labels from right to left (`org, example, www`). In
the order of these keys all subdomains of a host lie side by side, so a rule's
host is an interval of keys, and intervals of rules are nested or disjoint.
Urls and rules are sorted together; one sweep keeps the rules whose interval is
open on a stack and judges each url by the stack alone.

Layout: the key space is cut at split points taken from a bounded sample of the
urls (they decide where rows are worked on, never what the result is). The full
sort key is host, path and id, so that a hot host, or even one url repeated in
a third of the rows, is spread over many ranges. A rule goes to each range that
its interval touches; rules over one range's start are nested, so what ranges
receive in all is the rules plus, for each range, one chain of nested hosts.

Results for odd input: a NULL url or one without `://` has empty host and path,
fits no rule and gets the method's verdict; repeated rows are judged each;
rules that are NULL in host or path fit nothing. Of rules of equal length that
fit, the one with the longer host wins; of equal rules, `block` wins.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

DEFAULT_VERDICT = "allow"
SPLIT_SAMPLE = 100_000
ROWS_A_RANGE = 50_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, as the module text says."""
    pattern = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _split_points(keyed: DataFrame) -> list[tuple[list[str], str, int]]:
    """Keys that cut the urls into ranges of about ROWS_A_RANGE rows."""
    rows = keyed.count()
    ranges = rows // ROWS_A_RANGE + 1
    ranges = max(ranges, min(rows // 50, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if ranges < 2:
        return []
    share = min(1.0, SPLIT_SAMPLE / rows)
    found = sorted((tuple(r.labels), r.path, r.id) for r in keyed.select("labels", "path", "id").sample(share, seed=1).collect())
    picked = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []
    return [(list(a), b, c) for a, b, c in picked]


def _range_of(points: list):
    """Column function: the range of a url's key."""
    cuts = [(tuple(a), b, c) for a, b, c in points]

    @F.pandas_udf("int")
    def part(labels: pd.Series, path: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, (tuple(a), b, c)) for a, b, c in zip(labels, path, row, strict=True)], dtype="int32")
    return part


def _ranges_touched(points: list):
    """Column function: the ranges that hold keys of a host or its subdomains."""
    cuts = [tuple(a) for a, _, _ in points]

    @F.pandas_udf("array<int>")
    def parts(labels: pd.Series) -> pd.Series:
        out = []
        for own in map(tuple, labels):
            # Cuts before the host come first, then those inside its interval: both runs are sorted.
            first = bisect.bisect_left(cuts, own)
            last = bisect.bisect_right(cuts, own, key=lambda cut: cut[:len(own)])
            out.append(list(range(first, last + 1)))
        return pd.Series(out)
    return parts


def _sweep(default: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = None, []  # stack: (labels, {path: (rule, verdict)}, lengths of those paths)
        for batch in batches:
            out = []
            for part, labels, path, kind, key, rule, verdict in zip(
                    batch["part"], batch["labels"], batch["path"], batch["kind"], batch["row"], batch["rule"], batch["verdict"],
                    strict=True):
                if part != at:
                    at, stack = part, []
                labels = tuple(labels)
                while stack and labels[:len(stack[-1][0])] != stack[-1][0]:
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != labels:
                        stack.append((labels, {}, []))
                    _, paths, lengths = stack[-1]
                    if path not in paths or verdict == "block":
                        paths[path] = (rule, verdict)
                    if len(path) not in lengths:
                        bisect.insort(lengths, len(path))
                    continue
                best, most = (None, default), -1
                for _, paths, lengths in reversed(stack):  # the longest host first
                    for n in reversed(lengths):
                        if n <= len(path) and (hit := paths.get(path[:n])) is not None:
                            if len(hit[0]) > most:
                                best, most = hit, len(hit[0])
                            break
                out.append((key, *best))
            if out:
                yield pd.DataFrame(out, columns=["row", "rule", "verdict"])
    return run


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id",
               default: str = DEFAULT_VERDICT) -> DataFrame:
    """Key, host, path, rule and verdict of each row of `urls`.

    `rules` has host, path and verdict (`allow` or `block`). A rule fits a url
    whose host is the rule's or below it and whose path starts with the rule's.
    """
    host, path = url_parts(F.col(url))
    keyed = (urls.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
             .withColumn("labels", reversed_labels(F.col("host")))
             .withColumn("id", F.xxhash64("key")))
    points = _split_points(keyed)
    rows = keyed.select(
        _range_of(points)("labels", "path", "id").alias("part"), "labels", "path", F.lit(1).alias("kind"),
        F.struct("key", "host", "path").alias("row"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    fit = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
           .select(F.col("path"), F.col("verdict"), F.concat("host", "path").alias("rule"),
                   reversed_labels(lower_ascii(F.col("host"))).alias("labels")))
    spread = fit.select(F.explode(_ranges_touched(points)("labels")).alias("part"), "labels", "path", F.lit(0).alias("kind"),
                        F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "rule", "verdict")
    ranges = len(points) + 1
    judged = (rows.unionByName(spread).repartition(ranges, "part").sortWithinPartitions("part", "labels", "kind")
              .mapInPandas(_sweep(default), rows.select("row", "rule", "verdict").schema))
    return judged.select(F.col("row.key").alias(key), "row.host", "row.path", "rule", "verdict")
