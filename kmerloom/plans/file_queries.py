"""Catalogue of the readers and writers: what is written to the shared folder and read again, whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import ColoredGraph, prefix_page
from ..session import checkpoint_dir, table
from ..sources import readers, sinks
from ..streaming.append import append_stream, stored_pairs
from .graph_queries import _chains, _sql, benchmark_queries, source_graph

c = F.col


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4()}"


def kmers_written_as_text(spark, d):
    """All 18-mers of the graph as lines with a count behind them, read again."""
    at = _folder(spark)
    sinks.write_kmers(source_graph(spark, d, 18).counts().select(F.concat_ws(" ", F.lower("kmer"), "n_colors").alias("kmer")), at)
    return readers.kmer_text(spark, at, 18).select("kmer")


def kmers_written_packed(spark, d):
    at = _folder(spark)
    n = sinks.write_packed(source_graph(spark, d, 27).vertices(), 27, at)
    return readers.kmer_packed(spark, at, 27).select("kmer", F.lit(n).cast("bigint").alias("n_written"))


def sequences_in_order(spark, d):
    """The benchmark's sequences as lines of one file, numbered in its order."""
    at = _folder(spark)
    benchmark_queries(spark, d).orderBy("query_id").select("seq").coalesce(1).write.text(at)
    return readers.sequences(spark, at)


def sequences_as_fasta(spark, d):
    """Every document's letters as a FASTA record with lines of 60, read again: name, comment, length and sum of the sequence."""
    at = _folder(spark)
    docs = table(spark, d, "documents").where(c("doc_id").isNotNull()).select("doc_id", readers.dna(F.coalesce("text", F.lit(""))).alias("seq"))
    lines = F.regexp_replace("seq", "(.{60})", "$1\n")
    docs.select(F.concat(F.lit(">d"), c("doc_id").cast("string"), F.lit("\tof length "), F.length("seq").cast("string"), F.lit("\n"), lines).alias("value")).write.text(at)
    return readers.fasta(spark, at).select("name", "comment", F.length("seq").alias("n"), F.md5("seq").alias("sum"))


def graph_from_files(spark, d):
    """One file of k-mers a genome, in the registry's order; the graph that is built from the files."""
    graph, at = source_graph(spark, d, 9), _folder(spark)
    names = graph.genomes.withColumn("at", F.concat(F.lit("g"), F.lpad(c("genome_id").cast("string"), 9, "0")))
    graph.kmer_colors.join(names, "genome_id").select("at", "kmer").write.partitionBy("at").text(at)
    paths = [f"{at}/at={r['at']}" for r in names.orderBy("genome_id").select("at").collect()]  # a list of files, as a user gives it
    return ColoredGraph.empty(spark, 9).add_files(paths).kmer_colors


def extended_graph(spark, d):
    """The k-mers of the benchmark added to the genome that was registered last."""
    from ..operators.graph import spectrum, window_rows

    graph = source_graph(spark, d, 18)
    return spectrum(graph.extend_last_genome(window_rows(benchmark_queries(spark, d), 18).select("kmer")).counts())


def saved_graph(spark, d):
    at = _folder(spark)
    source_graph(spark, d, 18).save(at)
    graph = ColoredGraph.load(spark, at)
    return graph.kmer_colors.join(graph.genomes, "genome_id").groupBy("genome_name").agg(F.count(F.lit(1)).alias("n_kmers"), F.lit(graph.k).alias("k"))


def streamed_graph(spark, d):
    """The graph's rows as a stream of files, appended batch by batch."""
    at = _folder(spark)
    source_graph(spark, d, 9).kmer_colors.write.parquet(f"{at}/in")
    rows = spark.readStream.schema("kmer STRING, genome_id INT").option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    append_stream(rows, f"{at}/out", f"{at}/state").awaitTermination()
    return stored_pairs(spark, f"{at}/out")


def paths_written(spark, d):
    """Paths of the k-mers of two genomes as lines, read again."""
    from ..operators.traverse import simple_paths

    at = _folder(spark)
    graph = source_graph(spark, d, 9)
    longest = sinks.write_paths(simple_paths(graph.subset(graph.covering([0, 1]))), at)
    return spark.read.text(at).select(c("value").alias("path"), F.lit(longest).alias("longest"))


def kmers_of_one_and_not_another(spark, d):
    of = lambda i: graph.kmer_colors.where(c("genome_id") == i).select("kmer")
    graph = source_graph(spark, d, 9)
    return of(0).exceptAll(of(1))


def kmers_of_both(spark, d):
    of = lambda i: graph.kmer_colors.where(c("genome_id") == i).select("kmer")
    graph = source_graph(spark, d, 9)
    return of(0).intersect(of(1))


def prefix_second_page(spark, d):
    """The second hundred of the k-mers that start with ACG, resumed behind the first hundred's last."""
    from ..session import cut

    v = cut(source_graph(spark, d, 18).vertices())
    last = prefix_page(v, "ACG", 18, 100).agg(F.max("kmer")).first()[0]
    return prefix_page(v, "ACG", 18, 100, last)


QUERIES = {f.__name__: f for f in (
    kmers_written_as_text, kmers_written_packed, sequences_in_order, sequences_as_fasta, graph_from_files, extended_graph, saved_graph, streamed_graph, paths_written,
    kmers_of_one_and_not_another, kmers_of_both, prefix_second_page,
)}

_BOTH = "(SELECT kmer FROM km WHERE list_contains(colors, 0) AND list_contains(colors, 1))"
ORACLES = {
    "kmers_written_as_text": _sql(18, "SELECT kmer FROM km"),
    "kmers_written_packed": _sql(27, "SELECT kmer, (SELECT count(*) FROM km) AS n_written FROM km"),
    "sequences_in_order": """SELECT row_number() OVER (ORDER BY item_id) - 1 AS query_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark WHERE text IS NOT NULL""",
    "sequences_as_fasta": """SELECT 'd' || doc_id AS name, 'of length ' || length(seq) AS comment, length(seq)::INTEGER AS n, md5(seq) AS sum
        FROM (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM documents WHERE doc_id IS NOT NULL)""",
    "graph_from_files": _sql(9, "SELECT kmer, genome_id FROM kc"),
    "extended_graph": _sql(18, """SELECT n::INTEGER AS n_colors, count(*) AS n_kmers FROM (SELECT kmer, count(*) AS n FROM (SELECT kmer, genome_id FROM kc
        UNION SELECT substr(seq, p, 18), (SELECT max(genome_id) FROM g)::INTEGER FROM (SELECT seq, unnest(range(1, greatest(length(seq) - 16, 1)::BIGINT)) AS p FROM q)) GROUP BY 1) GROUP BY 1"""),
    "saved_graph": _sql(18, "SELECT genome_name, count(*) AS n_kmers, 18 AS k FROM kc JOIN g USING (genome_id) GROUP BY 1"),
    "streamed_graph": _sql(9, "SELECT kmer, genome_id FROM kc"),
    "paths_written": _chains(9, _BOTH, "SELECT path, (SELECT max(length(path)) FROM paths)::INTEGER AS longest FROM paths"),
    "kmers_of_one_and_not_another": _sql(9, "SELECT kmer FROM kc WHERE genome_id = 0 EXCEPT SELECT kmer FROM kc WHERE genome_id = 1"),
    "kmers_of_both": _sql(9, "SELECT kmer FROM kc WHERE genome_id = 0 INTERSECT SELECT kmer FROM kc WHERE genome_id = 1"),
    "prefix_second_page": _sql(18, "SELECT kmer FROM km WHERE kmer LIKE 'ACG%' ORDER BY kmer LIMIT 100 OFFSET 100"),
}
