import pytest
from conftest import DATA, against_sql

from kmerloom.plans import graph_queries

SOME = ["genomes", "kmer_colors_count", "sequence_containment_t30", "sequence_containment_canonical", "sequence_matrix", "degree_histogram", "genome_jaccard",
        "color_symdiff", "merge_graphs", "decoded_annotations", "kmer_presence_matrix", "neighbors", "subgraph_components", "bfs_levels", "simple_paths", "core_simple_paths", "minimizer_bins", "hamming_distances"]


@pytest.mark.parametrize("name", SOME)
def test_sql(spark, name):
    against_sql(spark, name, graph_queries.QUERIES[name], graph_queries.ORACLES[name], DATA / "sf0.001")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
