"""Command line: build and load graphs, add genomes, query k-mers, sequences and branching, extract k-mers.

    python -m kmerloom.cli build K (kmers|kmers_comp) LIST OUT [option ...]
    python -m kmerloom.cli load GRAPH [option ...]

Options run in the order given: -add_genomes (kmers|kmers_comp) LIST OUT, -query_kmers (kmers|kmers_comp) LIST,
-query_sequences THRESHOLD (canonical|non_canonical) LIST, -query_branching (kmers|kmers_comp) LIST,
-extract_kmers (kmers|kmers_comp) OUT. LIST is a file with one path a line; results of queries are written
next to each input, as a folder named after it with the extension .csv: a header line, then a line a query.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import search
from .operators.graph import ColoredGraph, valid_k
from .sources import readers, sinks

KINDS = {"kmers": False, "kmers_comp": True}


def _paths(spark: SparkSession, list_file: str) -> list[str]:
    paths = [r.path for r in readers.file_list(spark, list_file).orderBy("position").collect()]
    if missing := [p for p in paths if not Path(p).exists()]:
        raise FileNotFoundError(", ".join(missing))
    return paths


def _query_kmers(spark: SparkSession, path: str, kind: str, k: int) -> DataFrame:
    if KINDS[kind]:
        return readers.kmer_packed(spark, path, k).select(F.col("pos").alias("query_id"), "kmer")
    return readers.sequences(spark, path).select("query_id", F.substring("seq", 1, k).alias("kmer"))


def run(spark: SparkSession, args: list[str]) -> list[str]:
    """Runs a command line; returns what it prints."""
    said: list[str] = []
    if args[0] == "build":
        k, kind, list_file, out = int(args[1]), *args[2:5]
        graph = ColoredGraph.empty(spark, valid_k(k, strict=True)).add_files(_paths(spark, list_file), KINDS[kind])
        graph.save(out)
        graph, rest = ColoredGraph.load(spark, out), args[5:]
    elif args[0] == "load":
        graph, rest = ColoredGraph.load(spark, args[1]), args[2:]
    else:
        raise ValueError(f"unknown command {args[0]!r}")
    while rest:
        option, rest = rest[0], rest[1:]
        if option == "-add_genomes":
            (kind, list_file, out), rest = rest[:3], rest[3:]
            graph.add_files(_paths(spark, list_file), KINDS[kind]).save(out)
            graph = ColoredGraph.load(spark, out)
        elif option == "-query_kmers":
            (kind, list_file), rest = rest[:2], rest[2:]
            for path in _paths(spark, list_file):
                rows = search.kmer_presence(graph, _query_kmers(spark, path, kind, graph.k))
                sinks.write_matrix(search.presence_rows(rows, graph.genomes), graph.genomes, str(Path(path).with_suffix(".csv")))
        elif option == "-query_sequences":
            (threshold, mode, list_file), rest = rest[:3], rest[3:]
            for path in _paths(spark, list_file):
                queries = readers.sequences(spark, path)
                found = search.sequence_containment(graph, queries, float(threshold), mode == "canonical").select("query_id", "genome_id")
                rows = queries.select("query_id").join(found, "query_id", "left")
                sinks.write_matrix(search.presence_rows(rows, graph.genomes), graph.genomes, str(Path(path).with_suffix(".csv")))
        elif option == "-query_branching":
            (kind, list_file), rest = rest[:2], rest[2:]
            for path in _paths(spark, list_file):
                d = search.query_degrees(_query_kmers(spark, path, kind, graph.k), graph.vertices(), graph.k)
                said.append(f"{path}: {search.branching(d).count()} branching k-mers")
        elif option == "-extract_kmers":
            (kind, out), rest = rest[:2], rest[2:]
            n = sinks.write_packed(graph.vertices(), graph.k, out) if KINDS[kind] else sinks.write_kmers(graph.vertices(), out)
            said.append(f"{n} k-mers")
        else:
            raise ValueError(f"unknown option {option!r}")
    return said


if __name__ == "__main__":
    for line in run(SparkSession.builder.appName("kmerloom").getOrCreate(), sys.argv[1:]):
        print(line)
