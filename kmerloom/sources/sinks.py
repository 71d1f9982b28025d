"""Writers: k-mer files, presence matrices, path files. Each runs its plan once; what passes is counted on the way."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import codec


def _observed(df: DataFrame, folder: str, what) -> int:
    """Writes the one text column of ``df`` as lines in part files; returns an aggregate of the rows that were written."""
    seen = Observation()
    df.observe(seen, F.coalesce(what, F.lit(0)).alias("x")).write.mode("overwrite").text(folder)
    return seen.get["x"]


def write_kmers(kmers: DataFrame, folder: str) -> int:
    """One k-mer a line, in part files; returns how many."""
    return _observed(kmers.select("kmer"), folder, F.count(F.lit(1)))


def _packed_part(k: int, folder: str):
    """Writes a task's records to a file of its own: under another name first, so that a task that is tried again leaves no half."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        body = Path(folder) / f"_{task.partitionId()}-{task.taskAttemptId()}"
        with body.open("wb") as f:
            for b in stream:
                f.write(b"".join(b.column(0).to_pylist()))
                n += b.num_rows
        if n:
            whole = Path(f"{body}-whole")
            with whole.open("wb") as out, body.open("rb") as f:
                out.write(f"{k}\n{n}\n".encode())
                while piece := f.read(1 << 20):
                    out.write(piece)
            os.replace(whole, Path(folder) / f"part-{task.partitionId():05d}")
        body.unlink()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def write_packed(kmers: DataFrame, k: int, folder: str) -> int:
    """A folder of packed files, one a task: lines with k and the count, then the records. Returns how many k-mers.

    ``folder`` lies on a file system that all executors mount; no row passes through the driver.
    """
    at = re.sub("^file:/*", "/", folder)
    Path(at).mkdir(parents=True, exist_ok=True)
    for old in Path(at).iterdir():
        old.unlink()
    rows = kmers.select(codec.pack_bytes(F.col("kmer"), k).alias("packed"))
    return rows.mapInArrow(_packed_part(k, at), "n BIGINT").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_matrix(rows: DataFrame, genomes: DataFrame, folder: str) -> None:
    """A presence matrix (query_id, present) as lines of CSV, rows in the order of query_id behind a line with the genomes' names, in part files."""
    name = F.concat(F.lit('"'), F.replace("genome_name", F.lit('"'), F.lit('""')), F.lit('"'))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("genome_id", name.alias("n")))), lambda g: g["n"]), ",")  # one line, of the registry's size
    head = genomes.agg(F.concat_ws(",", F.lit("query_id"), names).alias("value")).select(F.lit(0).alias("line"), F.lit(None).cast("bigint").alias("query_id"), "value")
    body = rows.select(F.lit(1).alias("line"), "query_id", F.concat_ws(",", F.col("query_id").cast("string"), "present").alias("value"))
    head.unionByName(body).orderBy("line", "query_id").select("value").write.mode("overwrite").text(folder)


def write_paths(paths: DataFrame, folder: str) -> int:
    """One path a line; returns the longest path's length (0 without paths)."""
    return _observed(paths.select("path"), folder, F.max(F.length("path")))
