"""Readers: k-mer text files, packed k-mer files, lists of files, sequence files, FASTA and FASTQ, stored graphs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codec


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, value): the lines of text files, numbered from 0 in each file's order.

    Files are read in splits. A first pass counts the lines of each split; only these counts, a row a split,
    are summed up and sent to the tasks, no line is shuffled.
    """
    c = F.col
    lines = spark.read.text(path).select(
        c("_metadata.file_path").alias("path"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value"
    )
    splits = lines.groupBy("path", "block").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select("path", "block", (F.coalesce(before, F.lit(0)) - c("first")).alias("shift"))
    return lines.join(F.broadcast(splits), ["path", "block"]).select("path", (c("i") + c("shift")).alias("number"), "value")


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(position, path) of a manifest with one path a line; blank lines are skipped."""
    return numbered_lines(spark, path).where(F.trim("value") != "").select(F.col("number").alias("position"), F.trim("value").alias("path"))


def kmer_text(spark: SparkSession, paths: list[str] | str, k: int, keep_invalid: bool = False) -> DataFrame:
    """(path, kmer): the first k characters of every line, in bases.

    Lines that are too short or have a non-base there are skipped, or kept with a null k-mer.
    """
    line = spark.read.text(paths).select(F.input_file_name().alias("path"), codec.bases(F.substring("value", 1, k)).alias("kmer"))
    good = F.when(codec.is_kmer(F.col("kmer"), k), F.col("kmer"))
    out = line.select("path", good.alias("kmer"))
    return out if keep_invalid else out.where(F.col("kmer").isNotNull())


def _header(path: str, head: bytes, size: int, k: int) -> tuple[int, int]:
    """(records, where they begin) of a packed file; its k must be the graph's and all records must be there."""
    first, count, _ = head.split(b"\n", 2)
    if int(first) != k:
        raise ValueError(f"{path}: packed for k = {int(first)}, not {k}")
    start, width = len(first) + len(count) + 2, (2 * k + 7) // 8
    if size - start < int(count) * width:
        raise ValueError(f"{path}: {int(count)} k-mers announced, {(size - start) // width} there")
    return int(count), start


def _records(path: str, data: bytes, first: int, k: int) -> Iterator[pa.RecordBatch]:
    width = (2 * k + 7) // 8
    for at in range(0, len(data) // width, 65536):
        rows = [data[i : i + width] for i in range(at * width, min(len(data), (at + 65536) * width), width)]
        pos = range(first + at, first + at + len(rows))
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(pos, pa.int64()), pa.array(rows, pa.binary())], names=["path", "pos", "packed"])


def _unpack_whole(k: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                n, start = _header(path, content[:64], len(content), k)
                yield from _records(path, content[start : start + n * ((2 * k + 7) // 8)], 0, k)

    return run


def _unpack_ranges(k: int, piece: int):
    width = (2 * k + 7) // 8

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for path, size, nth in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), b.column("nth").to_pylist()):
                with open(unquote(re.sub("^file:/*", "/", path)), "rb") as f:
                    n, start = _header(path, f.read(64), size, k)
                    first = nth * piece
                    f.seek(start + first * width)
                    yield from _records(path, f.read(max(0, min(piece, n - first)) * width), first, k)

    return run


def kmer_packed(spark: SparkSession, paths: list[str] | str, k: int, piece: int = 1 << 22) -> DataFrame:
    """(path, pos, kmer) of packed files: a line with k, a line with the count, then ceil(2k/8) bytes a k-mer.

    Files on a mounted file system are read in pieces of ``piece`` records, each by its own task; others whole, a file a task.
    """
    files = spark.read.format("binaryFile").load(paths)
    if files.select("path").where(~F.col("path").startswith("file:")).isEmpty():
        last = F.floor(F.col("length") / (piece * ((2 * k + 7) // 8))).cast("int")
        pieces = files.select("path", "length", F.explode(F.sequence(F.lit(0), last)).alias("nth"))
        rows = pieces.repartition("path", "nth").mapInArrow(_unpack_ranges(k, piece), "path STRING, pos BIGINT, packed BINARY")
    else:
        rows = files.select("path", "content").mapInArrow(_unpack_whole(k), "path STRING, pos BIGINT, packed BINARY")
    return rows.select("path", "pos", codec.unpack_bytes(F.col("packed"), k).alias("kmer"))


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, seq): one sequence a line, numbered in the order of the file."""
    return numbered_lines(spark, path).select(F.col("number").alias("query_id"), F.col("value").alias("seq"))


def fasta(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, name, comment, seq) of FASTA files, read in splits: a record is what lies between two ``>`` at a line's start.

    The name ends at the first white space. Sequences run over any number of lines, white space in them is left out.
    """
    record = F.regexp_replace(F.col("value"), r"^>", "")
    rows = spark.read.text(paths, lineSep="\n>").select(F.col("_metadata.file_path").alias("path"), record.alias("r")).where(F.trim("r") != "")
    head = F.regexp_extract("r", r"^([^\r\n]*)", 1)
    comment = F.trim(F.regexp_extract(head, r"^\S*\s+(.*)$", 1))
    seq = F.regexp_replace(F.regexp_replace("r", r"^[^\r\n]*", ""), r"\s+", "")
    return rows.select("path", F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.when(comment != "", comment).alias("comment"), seq.alias("seq"))


def fastx(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, name, comment, seq, qual) of FASTA and FASTQ files with sequences over one or more lines.

    A record whose quality is longer or shorter than its sequence gets a null ``qual``. A quality may begin with any
    sign, so a FASTQ file cannot be cut without reading it from its start: a file is a task's; :func:`fasta` splits files.
    """

    def records(text: str) -> list[tuple]:
        out, lines, i = [], re.split(r"\r\n|\n|\r", text), 0
        while i < len(lines):
            if not lines[i][:1] in (">", "@"):
                i += 1
                continue
            name, *more = lines[i][1:].split(None, 1) if lines[i][1:2].strip() else ["", lines[i][1:].strip()]
            comment = more[0] if more else ""
            i, seq = i + 1, []
            while i < len(lines) and lines[i][:1] not in (">", "@", "+"):
                seq.append(lines[i].strip())
                i += 1
            body, qual = "".join(seq), None
            if i < len(lines) and lines[i][:1] == "+":
                i, got = i + 1, ""
                while i < len(lines) and len(got) < len(body):
                    got += lines[i].strip()
                    i += 1
                qual = got if len(got) == len(body) else None
            out.append((name, comment or None, body, qual))
        return out

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for path, text in zip(b.column("path").to_pylist(), b.column("value").to_pylist()):
                rows = records(text)
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *[pa.array(list(c), pa.string()) for c in cols]], names=["path", "name", "comment", "seq", "qual"])

    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInArrow(run, "path STRING, name STRING, comment STRING, seq STRING, qual STRING")


def dna(text: Column) -> Column:
    """The letters A, C, G and T of any text, in upper case."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]", ""))
