"""Catalogue of the heavy-key queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.heavy import heavy_keys, per_key
from ..session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of kmers.annot and ccs.nb_elem that hold at least 2 % of the non-null rows of their column."""
    annot = heavy_keys(table(spark, d, "kmers"), F.col("annot"))
    elem = heavy_keys(table(spark, d, "ccs"), F.col("nb_elem"))
    return annot.select(F.lit("annot").alias("key_field"), F.hex("key").alias("key_value")).unionByName(
        elem.select(F.lit("nb_elem").alias("key_field"), F.col("key").cast("string").alias("key_value"))
    )


def p3_per_color_set(spark: SparkSession, d: str) -> DataFrame:
    """Rows, graphs' range, color counts and first and last update of every encoded color set."""
    c = F.col
    out = per_key(
        table(spark, d, "kmers"), c("annot"), min_graph=F.min("graph_id"), max_graph=F.max("graph_id"),
        sum_colors=F.sum(F.size("colors").cast("bigint")), max_colors=F.max(F.size("colors")),
        first_update=F.min("updated_at"), last_update=F.max("updated_at"), n_dated=F.count("updated_at"),
    )
    return out.select(
        F.hex("key").alias("annot_hex"), "n_rows", "min_graph", "max_graph", "sum_colors", "max_colors",
        F.date_format("first_update", "yyyy-MM-dd HH:mm:ss").alias("first_update"),
        F.date_format("last_update", "yyyy-MM-dd HH:mm:ss").alias("last_update"), "n_dated",
    )


def p3_per_container_size(spark: SparkSession, d: str) -> DataFrame:
    """Rows, levels and children of every container size."""
    out = per_key(
        table(spark, d, "ccs"), F.col("nb_elem"), min_level=F.min("node_level"), max_level=F.max("node_level"),
        sum_children=F.sum(F.col("nb_node_children").cast("bigint")), max_children=F.max("nb_node_children"),
        n_graphs_sum=F.sum(F.col("graph_id").cast("bigint")),
    )
    return out.withColumnRenamed("key", "nb_elem")


QUERIES = {"p3_found": p3_found, "p3_per_color_set": p3_per_color_set, "p3_per_container_size": p3_per_container_size}

ORACLES = {
    "p3_found": """
        SELECT 'annot' AS key_field, hex(annot) AS key_value FROM kmers WHERE annot IS NOT NULL GROUP BY annot
        HAVING count(*) * 100 >= 2 * (SELECT count(annot) FROM kmers)
        UNION ALL
        SELECT 'nb_elem', CAST(nb_elem AS VARCHAR) FROM ccs WHERE nb_elem IS NOT NULL GROUP BY nb_elem
        HAVING count(*) * 100 >= 2 * (SELECT count(nb_elem) FROM ccs)""",
    "p3_per_color_set": """
        SELECT hex(annot) AS annot_hex, count(*) AS n_rows, min(graph_id) AS min_graph, max(graph_id) AS max_graph,
               CAST(sum(len(colors)) AS BIGINT) AS sum_colors, CAST(max(len(colors)) AS INTEGER) AS max_colors,
               strftime(min(updated_at), '%Y-%m-%d %H:%M:%S') AS first_update,
               strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS last_update, count(updated_at) AS n_dated
        FROM kmers WHERE annot IS NOT NULL GROUP BY annot""",
    "p3_per_container_size": """
        SELECT nb_elem, count(*) AS n_rows, min(node_level) AS min_level, max(node_level) AS max_level,
               CAST(sum(nb_node_children) AS BIGINT) AS sum_children, max(nb_node_children) AS max_children,
               CAST(sum(graph_id) AS BIGINT) AS n_graphs_sum
        FROM ccs WHERE nb_elem IS NOT NULL GROUP BY nb_elem""",
}
