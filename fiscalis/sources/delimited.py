"""Delimited text files of unknown dialect.

Encoding, delimiter, header and number format are found from all lines of a
file, by aggregation over lines; files that agree on all of them are read
together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalis import reference_data as ref
from fiscalis.session import cut
from fiscalis.sources.files import file_lines, leading_lines

MALFORMED = "_malformed"
QUOTED = r'"(?:[^"]|"")*"'
NUMBER = r"^-?\d[\d.,]*\d$"


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def encodings(lines: DataFrame) -> DataFrame:
    """UTF-8 for files that are valid UTF-8 and use it, else Latin-1 (plain
    ASCII counts as Latin-1)."""
    raw = F.col("line")
    valid, wide = F.is_valid_utf8(raw), F.octet_length(raw) != F.length(F.make_valid_utf8(raw))
    return lines.groupBy("file").agg(
        F.when(F.bool_and(valid) & F.bool_or(wide), "UTF-8").otherwise("ISO-8859-1").alias("encoding"))


def decoded(line: Column, encoding: Column) -> Column:
    """Text of a raw line in its file's encoding."""
    raw = line.cast("binary")
    return F.when(encoding == "UTF-8", F.make_valid_utf8(line)).otherwise(F.decode(raw, "ISO-8859-1"))


def delimiters(lines: DataFrame) -> DataFrame:
    """Semicolon when more frequent than comma, else tab when more frequent,
    else comma; and whether some line has an odd number of quotes, so that a
    quoted field goes on in the next line."""
    text = F.col("line")
    sums = lines.groupBy("file").agg(
        F.sum(_count(text, ";")).alias("_semi"), F.sum(_count(text, ",")).alias("_comma"),
        F.sum(_count(text, "\t")).alias("_tab"), F.bool_or(_count(text, '"') % 2 == 1).alias("quoted_breaks"))
    chosen = F.when(F.col("_semi") > F.col("_comma"), ";").when(F.col("_tab") > F.col("_comma"), "\t").otherwise(",")
    return sums.select("file", chosen.alias("delimiter"), "quoted_breaks")


def number_tokens(lines: DataFrame) -> DataFrame:
    """Fields that are numbers with a separator; needs `delimiter`."""
    field = F.trim(F.trim(F.col("_field")), F.lit('"'))
    fields = lines.select("file", F.explode(F.split(F.col("line"), F.concat(F.lit("\\Q"), "delimiter", F.lit("\\E")))).alias("_field"))
    return fields.select("file", field.alias("token")).where(
        F.col("token").rlike(NUMBER) & (F.col("token").contains(",") | F.col("token").contains(".")))


def token_vote(token: Column) -> Column:
    """'eu', 'anglo' or NULL when the token does not tell."""
    commas, dots = _count(token, ","), _count(token, ".")
    tail = F.length(F.regexp_extract(token, "([^.,]*)$", 1))
    last_comma = F.instr(F.reverse(token), ",") < F.instr(F.reverse(token), ".")
    return (
        F.when((commas > 0) & (dots > 0), F.when(last_comma, "eu").otherwise("anglo"))
        .when(commas > 1, "anglo").when((commas == 1) & tail.isin(1, 2), "eu")
        .when(dots > 1, "eu").when((dots == 1) & tail.isin(1, 2), "anglo"))


def number_formats(tokens: DataFrame) -> DataFrame:
    """Majority over all tokens of a file: (file, eu, anglo, decimal, thousands);
    both NULL on a draw."""
    vote = token_vote(F.col("token"))
    votes = tokens.groupBy("file").agg(
        F.count_if(vote == "eu").alias("eu"), F.count_if(vote == "anglo").alias("anglo"))
    return votes.withColumns({
        "decimal": F.when(F.col("anglo") > F.col("eu"), ".").when(F.col("eu") > F.col("anglo"), ","),
        "thousands": F.when(F.col("eu") > F.col("anglo"), "."),
    })


def with_fallback_format(formats: DataFrame) -> DataFrame:
    """Without a majority the encoding decides: UTF-8 Anglo, else European."""
    utf8 = F.col("encoding") == "UTF-8"
    return formats.withColumns({
        "thousands": F.when(F.col("decimal").isNotNull(), F.col("thousands")).when(~utf8, "."),
        "decimal": F.coalesce("decimal", F.when(utf8, ".").otherwise(",")),
    })


def profile(lines: DataFrame) -> DataFrame:
    """One row per file: encoding, delimiter, number format and header line."""
    found = cut(lines.sparkSession, encodings(lines).join(delimiters(lines), "file"), "file-dialects")
    marked = lines.join(found.select("file", "delimiter"), "file")
    votes = number_formats(number_tokens(marked)).drop("eu", "anglo")
    headers = leading_lines(lines).groupBy("file").agg(F.min_by("line", "at").alias("header"), F.min("at").alias("header_at"))
    out = found.join(headers, "file").join(votes, "file", "left")
    return with_fallback_format(out).withColumn(
        "header", F.regexp_replace(decoded(F.col("header"), F.col("encoding")), "﻿", ""))


def missing_to_null(df: DataFrame) -> DataFrame:
    """Texts that stand for a missing value become NULL."""
    return df.select(*[
        F.when(F.col(f"`{f.name}`").isin(*ref.CSV_NULLS), None).otherwise(F.col(f"`{f.name}`")).alias(f.name)
        if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema.fields])


def _csv_options(delimiter: str) -> dict:
    return {"sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED, "escape": '"'}


def _names(header: list[str]) -> list[str]:
    return [*[f"_{i}" for i in range(len(header))], MALFORMED]


def _fitting(rows: DataFrame, header: list[str], delimiter: str) -> DataFrame:
    """Parsed rows (_file and a column per field) that don't have more fields than the header, with its names."""
    # A record with another number of fields comes with its text; the delimiters outside quotes tell which.
    fields = 1 + _count(F.regexp_replace(MALFORMED, QUOTED, ""), delimiter)
    kept = rows.where(F.col(MALFORMED).isNull() | (fields <= len(header)))
    return missing_to_null(kept.select("_file", *[F.col(f"_{i}").alias(h) for i, h in enumerate(header)]))


def read_delimited(spark: SparkSession, paths, header: list[str], delimiter: str = ",",
                   encoding: str = "UTF-8", quoted_breaks: bool = False) -> DataFrame:
    """Files with one header as texts. Rows with too many fields are dropped,
    short ones are padded. Only files with line breaks inside quotes are read
    as a whole; the others can be split."""
    rows = (
        spark.read.schema(", ".join(f"`{n}` string" for n in _names(header))).options(**_csv_options(delimiter))
        .option("encoding", encoding).option("header", "true").option("columnPruning", "false")
        .option("enforceSchema", "true").option("multiLine", quoted_breaks).csv(paths))
    return _fitting(rows.withColumn("_file", F.col("_metadata.file_path")), header, delimiter)


def parse_lines(lines: DataFrame, header: list[str], delimiter: str, encoding: str) -> DataFrame:
    """Raw lines (file, line) below their headers, of any number of files with one header and dialect, as the same rows."""
    text = decoded(F.col("line"), F.lit(encoding))
    record = F.from_csv(text, F.lit(", ".join(f"`{n}` string" for n in _names(header))), _csv_options(delimiter))
    return _fitting(lines.select(F.col("file").alias("_file"), record.alias("r")).select("_file", "r.*"), header, delimiter)


def plain_number(text: Column, decimal: str, thousands: str | None) -> Column:
    """The text in plain Anglo notation, NULL when not a number of this format."""
    t = F.trim(text)
    group = "\\" + thousands if thousands else ""
    shape = rf"^[+-]?\d[\d{group}]*(\{decimal}\d*)?$|^[+-]?\{decimal}\d+$"
    bare = F.replace(t, F.lit(thousands), F.lit("")) if thousands else t
    return F.when(t.rlike(shape), F.replace(bare, F.lit(decimal), F.lit(".")))


def unify_numbers(df: DataFrame, columns: list[str], decimal: str, thousands: str | None) -> DataFrame:
    """Columns that hold only numbers of the format in a file are rewritten in
    plain notation; a column with any other text stays as it is."""
    plain = {c: plain_number(F.col(f"`{c}`"), decimal, thousands) for c in columns}
    whole = df.groupBy("_file").agg(*[
        (F.count(f"`{c}`") == F.count(p)).alias(f"_ok{i}") for i, (c, p) in enumerate(plain.items())])
    # Written first, so that the join knows its size: the rows are not dealt by file, which may be large.
    joined = df.join(cut(df.sparkSession, whole, "whole-columns"), "_file")
    return joined.select("_file", *[
        F.when(F.col(f"_ok{i}"), p).otherwise(F.col(f"`{c}`")).alias(c) for i, (c, p) in enumerate(plain.items())])


def read_folder(spark: SparkSession, paths) -> list[DataFrame]:
    """One DataFrame per group of files that agree on header and dialect.

    Only the distinct headers and dialects come to the driver. A group's lines find their files by a
    join, so no list of files is made; files with line breaks inside quotes alone are named to a reader.
    """
    keys = ["header", "delimiter", "encoding", "decimal", "thousands", "quoted_breaks"]
    lines = file_lines(spark, paths)
    found = cut(spark, profile(lines), "file-profiles")
    groups = found.groupBy(*keys).agg(F.collect_set(F.when(F.col("quoted_breaks"), F.col("file"))).alias("files")).orderBy(*keys).collect()
    out = []
    for g in groups:
        header = [h.strip().strip('"') for h in g["header"].split(g["delimiter"])]
        if g["quoted_breaks"]:
            rows = read_delimited(spark, sorted(g["files"]), header, g["delimiter"], g["encoding"], True)
        else:
            same = found
            for k in keys:
                same = same.where(F.col(k).eqNullSafe(F.lit(g[k])))
            mine = lines.join(same.select("file", "header_at"), "file").where((F.col("at") > F.col("header_at")) & (F.trim("line") != ""))
            rows = parse_lines(mine, header, g["delimiter"], g["encoding"])
        out.append(unify_numbers(rows, header, g["decimal"], g["thousands"]))
    return out


def union_groups(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
