"""The k-mer of every insertion row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inserted_kmers(inserts: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows of kmer_inserts with a k-mer, as (insert_id, graph_id, kmer, id_genome, inserted_at).

    The k-mer is the first k characters of the line in bases, k being the graph's. Lines that are null,
    too short or have a non-base there, and rows of an unknown graph, hold none and are left out.
    """
    ks = meta.where(F.col("k") > 0).select(F.col("graph_id").alias("g"), "k").dropDuplicates(["g"])
    rows = inserts.select("insert_id", "graph_id", "array_kmers", "id_genome", "inserted_at").join(ks, F.col("graph_id") == F.col("g"))
    line = F.translate(F.upper(F.expr("substring(array_kmers, 1, k)")), "U", "T")
    return rows.select("insert_id", "graph_id", line.alias("kmer"), "id_genome", "inserted_at", "k").where(
        (F.length("kmer") == F.col("k")) & F.col("kmer").rlike("^[ACGT]+$")
    ).drop("k")
