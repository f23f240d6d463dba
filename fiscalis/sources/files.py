"""Raw files: manifest, reader choice, archives, API pages, workbooks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalis import reference_data as ref
from fiscalis.functions.labels import lookup
from fiscalis.functions.md5 import BLOCK, START, block_function, finish
from fiscalis.session import cut, remove, save, scratch_path

# Format code -> reader, and extension -> reader when the format lies.
READER_OF_FORMAT = {"CSV": "delimited", "TSV": "delimited", "XLSX": "workbook", "XLS": "workbook",
                    "JSON": "json", "XML": "xml", "PC-AXIS": "cube", "PX": "cube"}
READER_OF_EXTENSION = {"csv": "delimited", "tsv": "delimited", "xlsx": "workbook", "xls": "workbook", "px": "cube"}


PIECE_BYTES = 1 << 20
# A file's digest goes on by this many bytes a job, and a job's files are dealt to this many tasks for each such load.
SEGMENT_BYTES, DEALT = 128 << 20, 4
PIECES = "file string, size bigint, block bigint, k bigint, piece binary"
STATES = "file string, size bigint, last bigint, extra bigint, digest binary, tail binary, md5 string"
# Pieces are large values: a reader holds a row group of them.
SMALL_ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4", "parquet.enable.dictionary": "false"}
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
# Names of files that Spark's text reader unpacks; their bytes come whole, as rows of up to 2 GB.
UNPACKED = r"(?i)\.(gz|gzip|bz2|bzip2|deflate|lz4|snappy|zst|zstd)$"


def _pack_lines(batches):
    """Lines (file, size, block, k, line) in order to pieces of bounded size, each line with its line end."""
    for batch in batches:
        files, sizes, blocks, marks = (batch.column(i).to_pylist() for i in range(4))
        rows, held, length = [], [], 0
        for i, line in enumerate(batch.column(4)):
            if held and (files[i] != files[i - 1] or blocks[i] != blocks[i - 1] or length >= PIECE_BYTES):
                rows.append((*first, b"".join(held)))
                held, length = [], 0
            if not held:
                first = (files[i], sizes[i], blocks[i], marks[i])
            held += [line.as_py(), b"\n"]
            length += len(held[-2]) + 1
        if held:
            rows.append((*first, b"".join(held)))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "size", "block", "k", "piece"])


def _advance_md5(batches):
    """Rows in the order of their files, each file's state before its pieces, to the states after them.

    Where no more pieces follow, the MD5 is made. The last `extra` bytes of a file are not its own: they wait in the tail.
    """
    blocks = block_function()
    held = None

    def after():
        own = held["tail"][:len(held["tail"]) - held["extra"]]
        return {**held, "md5": finish(blocks, held["digest"], own, held["size"]) if held["final"] else None}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["block"] < 0:
                if held is not None:
                    out.append(after())
                held = {name: row[name] for name in ("file", "size", "last", "extra", "final", "digest")} | {"tail": row["piece"]}
                continue
            data = held["tail"] + row["piece"]
            whole = (len(data) - held["extra"]) // BLOCK * BLOCK
            if whole > 0:
                held["digest"], data = blocks(held["digest"], data[:whole]), data[whole:]
            held["tail"] = data
        yield _state_rows(out)
    if held is not None:
        yield _state_rows([after()])


def _state_rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "size": pa.int64(), "last": pa.int64(), "extra": pa.int64(), "digest": pa.binary(), "tail": pa.binary(), "md5": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()], list(kinds))


def _open_states(pieces: DataFrame) -> DataFrame:
    """The state of each file before its first piece. Spark's reader drops a byte order mark, and each line has got a line end, the last one too."""
    ends = pieces.groupBy("file", "size").agg(F.sum("bytes").alias("found"), F.max("segment").alias("last"))
    mark = F.col("found") < F.col("size")
    extra = F.col("found") + F.when(mark, len(BYTE_ORDER_MARK)).otherwise(0) - F.col("size")
    return ends.select(
        "file", "size", "last", F.when(extra.isin(0, 1), extra).otherwise(
            F.raise_error(F.concat(F.lit("other bytes than the file's were read: "), "file"))).cast("bigint").alias("extra"),
        F.lit(START).alias("digest"), F.when(mark, F.lit(BYTE_ORDER_MARK)).otherwise(F.lit(b"")).alias("tail"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and MD5 of every file with content below a path.

    Files are read in splits and kept as pieces of about `PIECE_BYTES`, by segment of
    `SEGMENT_BYTES` of their file. The digest of a file is a chain over its bytes: a job
    for each segment takes all files on by that segment and hands their states to
    the next, so a task reads a segment of a file, however large the file. Only lines
    are never parted: one without a line end is read by one task.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    # A byte order mark alone has no line.
    whole = F.col("_metadata.file_name").rlike(UNPACKED) | (F.col("_metadata.file_size") <= len(BYTE_ORDER_MARK))
    rows = reader.option("lineSep", "\n").text(path).where(~whole).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("k"), F.col("value").cast("binary").alias("line"))
    pieces = rows.mapInArrow(_pack_lines, PIECES).withColumns(
        {"bytes": F.octet_length("piece").cast("bigint"), "segment": F.expr(f"block div {SEGMENT_BYTES}")})
    kept, states = scratch_path(spark, "pieces"), scratch_path(spark, "digests")
    save(spark, pieces.write.options(**SMALL_ROW_GROUPS).partitionBy("segment"), kept)
    pieces = spark.read.schema(f"{PIECES}, bytes bigint, segment bigint").parquet(kept)
    waiting = cut(spark, _open_states(pieces), "states")
    loads = pieces.groupBy("segment").agg(F.sum("bytes").alias("bytes")).collect()
    for segment, load in sorted(map(tuple, loads)):
        before = waiting.select(
            "file", "size", F.lit(-1).cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("k"), F.col("tail").alias("piece"),
            "last", "extra", (F.col("last") == segment).alias("final"), "digest")
        now = pieces.where(F.col("segment") == segment).select("file", "size", "block", "k", "piece")
        dealt = before.unionByName(now, allowMissingColumns=True).repartition(1 + DEALT * load // SEGMENT_BYTES, "file")
        after = dealt.sortWithinPartitions("file", "block", "k").mapInArrow(_advance_md5, STATES)
        save(spark, after.write, f"{states}/upto={segment}")
        remove(spark, f"{kept}/segment={segment}")
        waiting = spark.read.schema(STATES).parquet(f"{states}/upto={segment}").where(F.col("md5").isNull())
    rest = cut(spark, reader.format("binaryFile").load(path).where(whole & (F.col("length") > 0)).select(
        F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"), F.md5("content").alias("md5")), "manifest")
    if not loads:
        return rest
    done = spark.read.schema(STATES).option("recursiveFileLookup", "true").parquet(states).where(F.col("md5").isNotNull())
    return done.select(F.col("file").alias("path"), F.col("size").alias("bytes"), "md5").unionByName(rest)


def file_lines(spark: SparkSession, path) -> DataFrame:
    """(file, at, line): raw lines of text files; `at` orders them in a file.

    Files are split over tasks, so their size does not matter.
    """
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k")).alias("at"),
        F.col("value").alias("line"))


def folder_lines(spark: SparkSession, path) -> DataFrame:
    """(file, line): raw lines of files written in parts; `file` is the folder of the parts."""
    lines = file_lines(spark, path)
    return lines.select(F.regexp_extract("file", "^(.*)/", 1).alias("file"), "line")


def _first_of_runs(batches):
    """Rows (file, at, line) of a task in order to the first one of each run of rows from one block of a file."""
    held = None
    for batch in batches:
        files, blocks = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).field("block").to_numpy()
        if len(files):
            keep = np.r_[(batch.column(0)[0].as_py(), blocks[0]) != held, (files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])]
            held = (batch.column(0)[-1].as_py(), blocks[-1])
            yield batch.filter(pa.array(keep))


def leading_lines(lines: DataFrame) -> DataFrame:
    """The first non-blank line of each block of a file, among which is the file's: the least of texts sorts its rows, so few may reach it."""
    rows = lines.where(F.trim("line") != "").select("file", "at", F.col("line").cast("binary").alias("line"))
    return rows.mapInArrow(_first_of_runs, rows.schema).withColumn("line", F.col("line").cast("string"))


def first_lines(lines: DataFrame) -> DataFrame:
    """The first non-blank line of each file."""
    return leading_lines(lines).groupBy("file").agg(F.min_by("line", "at").alias("first"))


def reader_for(code: Column, path: Column, first: Column) -> Column:
    """Reader of a file: by format code, or by extension when the format is
    unknown or the content contradicts it."""
    by_format = lookup(READER_OF_FORMAT, F.upper(code))
    by_extension = lookup(READER_OF_EXTENSION, F.lower(F.substring_index(path, ".", -1)))
    start = F.substring(F.ltrim(F.regexp_replace(first, "﻿", "")), 1, 1)
    wrong = (
        ((by_format == "json") & ~start.isin("{", "["))
        | ((by_format == "xml") & (start != "<"))
        | ((by_format == "delimited") & start.isin("{", "[", "<")))
    return F.when(F.coalesce(wrong, F.lit(False)), F.coalesce(by_extension, by_format)).otherwise(
        F.coalesce(by_format, by_extension))


def read_routed(spark: SparkSession, files: DataFrame, readers: dict) -> DataFrame:
    """Read every file with its reader, one read per route.

    `files` holds (path, reader); `readers` maps a route to a function of
    (spark, paths). Only file names pass through the driver.
    """
    routes = {r["reader"]: r["paths"] for r in
              files.where(F.col("reader").isin(list(readers))).groupBy("reader").agg(
                  F.sort_array(F.collect_set("path")).alias("paths")).collect()}
    parts = [readers[name](spark, routes[name]) for name in sorted(routes)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def archive_members(members: DataFrame) -> DataFrame:
    """Members to read of each archive (columns archive, member): CSVs before
    workbooks, and of those the ones named like spending, else all."""
    name = F.lower("member")
    kind = F.when(name.endswith(".csv"), 0).when(name.endswith(".xlsx") | name.endswith(".xls"), 1)
    spending = reduce(lambda a, b: a | b, [name.contains(k) for k in ref.ARCHIVE_KEYWORDS])
    rows = members.select("archive", "member", kind.alias("_kind"), (~spending).cast("int").alias("_other")).where(
        F.col("_kind").isNotNull())
    best = rows.groupBy(F.col("archive").alias("_a")).agg(F.min(F.struct("_kind", "_other")).alias("_best"))
    return rows.join(best, F.col("archive") == F.col("_a")).where(
        F.struct("_kind", "_other") == F.col("_best")).select("archive", "member", F.col("member").alias("_zip_source"))


def api_items(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Items of landed catalogue pages."""
    reader = spark.read.option("multiLine", "true")
    pages = (reader.schema(schema) if schema is not None else reader).json(path)
    return pages.select(F.col("_metadata.file_path").alias("file"), F.posexplode("result.items").alias("pos", "item"))


def header_rows(cells: DataFrame, search: int = 10) -> DataFrame:
    """Header row of each sheet (columns file, sheet, fila, celdas).

    `celdas` holds one struct (valor, es_texto) per cell. The header is the
    first of the leading rows that is filled and mostly text, else row 0.
    """
    filled = F.size(F.filter("celdas", lambda c: c["valor"].isNotNull()))
    words = F.size(F.filter("celdas", lambda c: c["valor"].isNotNull() & c["es_texto"]))
    fits = (filled >= F.greatest(F.lit(3), F.floor(F.size("celdas") * 0.5))) & (words >= filled * 0.6)
    return cells.groupBy("file", "sheet").agg(
        F.coalesce(F.min(F.when(fits & (F.col("fila") < search), F.col("fila"))), F.lit(0)).alias("header"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """Data rows of all sheets below their header, tagged with the sheet."""
    headers = header_rows(cells)
    return cells.join(headers, ["file", "sheet"]).where(F.col("fila") > F.col("header")).select(
        "file", F.col("sheet").alias("__sheet__"), "fila", F.transform("celdas", lambda c: c["valor"]).alias("valores"))
