"""JSON records, nested columns and repeating XML elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscalis.sources.files import file_lines, first_lines

# Places where records usually sit, in order.
RECORD_PATHS = [["result", "items"], ["value"], ["data"], ["items"], ["records"]]


def _type_at(schema: T.StructType, path: list[str]) -> T.DataType | None:
    node: T.DataType | None = schema
    for name in path:
        if not isinstance(node, T.StructType) or name not in node.names:
            return None
        node = node[name].dataType
    return node


def record_path(schema: T.StructType) -> list[str] | None:
    """Where the records of an object document are, from its schema alone."""
    for path in RECORD_PATHS:
        if isinstance(_type_at(schema, path), T.ArrayType):
            return path
    for field in schema.fields:
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            return [field.name]
    return None


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects as dotted columns."""
    def leaves(fields, prefix: list[str]):
        for f in fields:
            path = [*prefix, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, path)
            else:
                yield F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path))

    return df.select(*leaves(df.schema.fields, []))


def read_records(spark: SparkSession, paths, schema: T.StructType | None = None) -> DataFrame:
    """Records of JSON documents that share a layout: a top-level list, else
    the list found in the document, else the document itself. Files that are
    not valid UTF-8 are read as Latin-1."""
    reader = spark.read.option("multiLine", "true")
    reader = reader.schema(schema) if schema is not None else reader
    other = file_lines(spark, paths).where(~F.is_valid_utf8("line")).select("file").distinct()
    docs = reader.json(paths)
    if not other.isEmpty():
        place = F.col("_metadata.file_path").alias("_place")
        latin = reader.option("encoding", "ISO-8859-1").json(paths)
        docs = latin.select("*", place).join(other, F.col("_place") == other["file"], "left_semi").drop("_place").unionByName(
            reader.option("encoding", "UTF-8").schema(latin.schema).json(paths).select("*", place).join(
                other, F.col("_place") == other["file"], "left_anti").drop("_place"))
    starts = first_lines(file_lines(spark, paths)).select(
        F.substring(F.ltrim(F.regexp_replace("first", "﻿", "")), 1, 1).alias("c")).distinct()
    is_list = [r["c"] for r in starts.collect()] == ["["]
    path = None if is_list else record_path(docs.schema)
    if path is None:
        return flatten(docs)
    records = docs.select(F.explode(F.col(".".join(f"`{p}`" for p in path))).alias("r"))
    if isinstance(records.schema["r"].dataType, T.StructType):
        return flatten(records.select("r.*"))
    return records.withColumnRenamed("r", "0")


def tag_counts(texts: DataFrame) -> DataFrame:
    """(id, tag, n, first): how often each element occurs in a document
    (columns id, text), and where it starts first."""
    body = F.regexp_replace("text", r"(?s)<!--.*?-->", "")
    tags = texts.select("id", F.posexplode(F.regexp_extract_all(body, F.lit(r"<([A-Za-z_][\w.:-]*)"), F.lit(1))).alias("at", "tag"))
    local = F.substring_index("tag", ":", -1)
    return tags.groupBy("id", local.alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


def row_tags(counts: DataFrame) -> DataFrame:
    """The most frequent element of a document that is not its root and occurs
    at least twice; the earlier one on ties."""
    rows = counts.where((F.col("first") > 0) & (F.col("n") >= 2))
    best = rows.groupBy("id").agg(F.min(F.struct(-F.col("n"), F.col("first"), F.col("tag"))).alias("b"))
    return best.select("id", F.col("b.tag").alias("tag"))


def read_xml(spark: SparkSession, paths, row_tag: str) -> DataFrame:
    """Elements as rows: children and `@attributes` as columns."""
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@").load(paths)
