"""Catalogue of the graph queries over nucleotides that are projected from documents (genome = source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, colors
from ..operators import graph as g
from ..operators import compact, reads, search, traverse
from ..operators.graph import ColoredGraph
from ..session import cut, fits, spread, table
from ..sources.readers import base_name, dna

c = F.col


def source_sequences(spark: SparkSession, d: str, by: str = "source") -> DataFrame:
    docs = table(spark, d, "documents").where(c(by).isNotNull() & c("text").isNotNull())
    return spread(docs.select(c(by).alias("genome_name"), "text")).select("genome_name", dna(c("text")).alias("seq"))


def source_graph(spark: SparkSession, d: str, k: int, by: str = "source") -> ColoredGraph:
    return ColoredGraph.from_sequences(source_sequences(spark, d, by), k)


def benchmark_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(c("item_id").alias("query_id"), dna(c("text")).alias("seq"))


def ids(column) -> F.Column:
    return F.array_join(F.array_sort(column), ",")


# --- registry, k-mers and codecs ------------------------------------------------------------------


def genomes(spark, d):
    return source_graph(spark, d, 9).genomes.select(c("genome_id").cast("bigint").alias("genome_id"), "genome_name")


def genome_base_names(spark, d):
    return table(spark, d, "genomes").select("genome_id", base_name(F.trim("filename")).alias("base"))


def kmer_colors_count(spark, d):
    return source_graph(spark, d, 27).kmer_colors.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_kmers"))


def kmer_color_sets(spark, d):
    return source_graph(spark, d, 27).kmers().select("kmer", ids(c("colors")).alias("colors"), "n_colors")


def color_set_dictionary(spark, d):
    dictionary, _ = source_graph(spark, d, 27).color_dictionary()
    return dictionary.select(ids(c("colors")).alias("colors"), "n_kmers")


def colors_by_dictionary(spark, d):
    """Color sets of all k-mers, looked up in the dictionary."""
    dictionary, links = source_graph(spark, d, 27).color_dictionary()
    return links.join(dictionary, "color_id").select("kmer", ids(c("colors")).alias("colors"))


def _nine(spark, d):
    return source_graph(spark, d, 9).vertices()


def kmer_encode_int(spark, d):
    v = codec.pack_int(c("kmer"))
    return _nine(spark, d).select("kmer", v.alias("packed"), codec.unpack_int(v, 9).alias("back"))


def kmer_encode_bytes(spark, d):
    v = codec.pack_bytes(c("kmer"), 9)
    return _nine(spark, d).select("kmer", F.hex(v).alias("packed"), codec.unpack_bytes(v, 9).alias("back"))


def bit_helpers(spark, d):
    """Bits set, bits needed, bits turned round, and the hex text with its nibbles swapped, of every packed 9-mer."""
    v = _nine(spark, d).select("kmer", codec.pack_int(c("kmer")).alias("p"))
    return v.select("kmer", codec.popcount(c("p")).cast("int").alias("n_set"), codec.bits_needed(c("p") + 1).alias("n_needed"), codec.reverse_bits(c("p"), 18).alias("turned"),
                    codec.swap_nibbles(codec.pack_ambiguous(c("kmer"))).alias("swapped"))


def reverse_complement(spark, d):
    return _nine(spark, d).select("kmer", codec.reverse_complement(c("kmer")).alias("rc"))


def canonical_kmers(spark, d):
    return _nine(spark, d).select(codec.canonical(c("kmer")).alias("canonical")).groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


def iupac_windows(spark, d):
    """Windows of benchmark texts with ambiguity letters kept: all, and those that hold one."""
    wide = table(spark, d, "benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^ACGTNRacgtnr]", "")).alias("seq"))
    w = wide.select("item_id", F.explode(codec.kmers(c("seq"), 18)).alias("w"))
    return w.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(codec.has_ambiguity(c("w"))).alias("n_skipped"))


def iupac_codes(spark, d):
    wide = table(spark, d, "benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^ACGTNRacgtnr]", "")).alias("seq"))
    packed = codec.pack_ambiguous(c("seq"))
    return wide.select("item_id", F.md5(packed).alias("packed"), (codec.unpack_ambiguous(packed) == c("seq")).alias("back"), codec.last_non_base(c("seq")).alias("last_non_base"))


# --- presence and containment ----------------------------------------------------------------------


def _query_kmers(spark, d, k):
    """(query_id STRUCT<item_id, pos>, kmer): all windows of the benchmark's texts."""
    q = benchmark_queries(spark, d).select(c("query_id").alias("item_id"), F.posexplode(codec.kmers(c("seq"), k)).alias("pos", "kmer"))
    return q.select(F.struct("item_id", "pos").alias("query_id"), "kmer")


def kmer_presence(spark, d):
    rows = search.kmer_presence(source_graph(spark, d, 18), _query_kmers(spark, d, 18))
    return rows.groupBy("query_id", "kmer").agg(F.count("genome_id").alias("n_genomes")).select("query_id.item_id", "query_id.pos", "kmer", "n_genomes")


def kmer_presence_matrix(spark, d):
    """A row a query k-mer with a 0 or 1 per genome. Only the query k-mers' rows of the graph are shuffled, if their texts are small enough to be sent to all tasks."""
    graph, q = source_graph(spark, d, 18), _query_kmers(spark, d, 18)
    asked = q.select("kmer").distinct()
    asked = F.broadcast(asked) if fits(asked, "kmer", 8 << 20) else asked
    rows = search.presence_rows(search.kmer_presence(graph.subset(asked), q), graph.genomes)
    return rows.select("query_id.item_id", "query_id.pos", "present")


def presence_count(spark, d):
    """How many query k-mers are in the graph, repeats counted."""
    q = _query_kmers(spark, d, 18).join(source_graph(spark, d, 18).vertices(), "kmer", "left_semi")
    return q.agg(F.count(F.lit(1)).alias("n_present"))


def _containment(k, t, canonical=False):
    def run(spark, d):
        return search.sequence_containment(source_graph(spark, d, k), benchmark_queries(spark, d), t, canonical)

    return run


def _sequence_rows(graph, queries):
    found = search.sequence_containment(graph, queries, 0.5)
    return queries.select("query_id").join(found.select("query_id", "genome_id"), "query_id", "left")


def sequence_matrix(spark, d):
    """A row a benchmark text with a 0 or 1 per genome."""
    graph = source_graph(spark, d, 9)
    return search.presence_rows(_sequence_rows(graph, benchmark_queries(spark, d)), graph.genomes)


def prefix_match(spark, d):
    return g.prefix_match(source_graph(spark, d, 18).vertices(), "ACG", 18)


# --- neighbours and degrees ------------------------------------------------------------------------


def degree_histogram(spark, d):
    x = search.degrees(source_graph(spark, d, 18).vertices(), 18)
    return x.groupBy("indegree", "outdegree").agg(F.count(F.lit(1)).alias("n"))


def branching_kmers(spark, d):
    return search.branching(search.degrees(source_graph(spark, d, 27).vertices(), 27))


def query_branching_count(spark, d):
    x = search.query_degrees(_query_kmers(spark, d, 18), source_graph(spark, d, 18).vertices(), 18)
    return search.branching(x).agg(F.count(F.lit(1)).alias("n_branching"))


def _neighbors(f):
    def run(spark, d):
        v = source_graph(spark, d, 27).vertices()
        return f(v, v, 27)

    return run


# --- pan-genome and color sets ----------------------------------------------------------------------


def _pan(f):
    def run(spark, d):
        graph = source_graph(spark, d, 9)
        return f(graph.counts(), graph)

    return run


core_kmers = _pan(lambda x, graph: g.core(x, graph.n_genomes()).select("kmer"))
dispensable_kmers = _pan(lambda x, graph: g.dispensable(x, graph.n_genomes()).select("kmer"))
singleton_kmers = _pan(lambda x, graph: g.singleton(x).select("kmer"))
pangenome_spectrum = _pan(lambda x, graph: g.spectrum(x))


def _color_sets(spark, d):
    """Color sets of a k-mer and of its two successors with A and C, where all three are in the graph."""
    s = cut(source_graph(spark, d, 9).kmers().select("kmer", "colors"))
    a, b = s.select(c("kmer").alias("ka"), c("colors").alias("a")), s.select(c("kmer").alias("kc"), c("colors").alias("b"))
    x = s.withColumns({"ka": F.concat(F.substring("kmer", 2, 8), F.lit("A")), "kc": F.concat(F.substring("kmer", 2, 8), F.lit("C"))})
    return x.join(a, "ka").join(b, "kc")


def _algebra(f):
    def run(spark, d):
        return _color_sets(spark, d).select("kmer", F.array_join(f(c("colors"), c("a"), c("b")), ",").alias("result"))

    return run


def color_summary(spark, d):
    s = source_graph(spark, d, 18).kmers()
    return s.select("kmer", colors.count_colors(c("colors")).alias("n"), colors.last_color(c("colors")).alias("last"), colors.has_color(c("colors"), 1, 10**8).alias("has_1"))


def shared_colors_bounded(spark, d):
    return _color_sets(spark, d).select("kmer", colors.intersection_count(c("a"), c("b"), 3).alias("shared"))


def genome_jaccard(spark, d):
    """Shared and united 9-mers per pair of genomes; pairs are bounded by the square of the number of genomes."""
    kc = source_graph(spark, d, 9).kmers()
    pair = F.flatten(F.transform("colors", lambda x: F.transform(F.filter("colors", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    shared = kc.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"))
    size = kc.select(F.explode("colors").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    x = shared.join(size.select(c("g").alias("a"), c("n").alias("na")), "a").join(size.select(c("g").alias("b"), c("n").alias("nb")), "b")
    return x.select("a", "b", "shared", (c("na") + c("nb") - c("shared")).alias("united"))


def subgraph_kmers(spark, d):
    return source_graph(spark, d, 9).covering([0, 1])


def subset_graph(spark, d):
    graph = source_graph(spark, d, 18)
    chosen = g.prefix_match(graph.vertices(), "ACG", 18)
    return graph.subset(chosen).kmer_colors.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_kmers"))


def merge_graphs(spark, d):
    """The graph of sources merged with the graph of languages."""
    both = source_graph(spark, d, 18).merge(source_graph(spark, d, 18, "lang"))
    return both.kmer_colors.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_kmers")).join(both.genomes, "genome_id").select("genome_name", "n_kmers")


def add_genome(spark, d):
    """The benchmark's k-mers added as one more genome."""
    graph = source_graph(spark, d, 18)
    new = g.window_rows(benchmark_queries(spark, d), 18).select("kmer")
    return g.spectrum(graph.add_genome("benchmark", new).counts())


def add_colors(spark, d):
    graph = source_graph(spark, d, 18)
    return g.spectrum(graph.add_colors(g.prefix_match(graph.vertices(), "ACG", 18), [0, 1]).counts())


def decoded_annotations(spark, d):
    """Color sets as decoded from kmers.annot."""
    k = table(spark, d, "kmers").where(c("annot").isNotNull())
    return k.select(codec.bases(c("kmer")).alias("kmer"), "graph_id", ids(F.array_distinct(colors.decode(c("annot")))).alias("colors"))


def encoded_annotations(spark, d):
    """Color sets in their shortest encoding, from kmers.colors."""
    k = table(spark, d, "kmers").where(c("annot").isNotNull())
    return k.select(codec.bases(c("kmer")).alias("kmer"), "graph_id", F.hex(colors.encode(c("colors"))).alias("annot_hex"))


def index_stats(spark, d):
    return source_graph(spark, d, 27).statistics()


def vertex_marks(spark, d):
    v = search.degrees(source_graph(spark, d, 27).vertices(), 27)
    v = cut(v)
    state = g.set_marks(g.with_marks(v), search.branching(v), 2)
    return g.mark_counts(g.set_marks(state, v.where("indegree = 0"), 1)).select(c("flag").cast("int").alias("flag"), "n")


# --- traversal --------------------------------------------------------------------------------------


def simple_path_stats(spark, d):
    graph = source_graph(spark, d, 27)
    v, e, _ = traverse.eligible_edges(graph)
    one = v.select(F.lit(1).alias("v"), F.lit(0).alias("e")).unionByName(e.select(F.lit(0).alias("v"), F.lit(1).alias("e")))
    return one.agg(F.sum("v").alias("vertices"), F.sum("e").alias("edges"))


def simple_paths(spark, d):
    """Paths of the whole graph, from the texts: colors have no part in them."""
    docs = table(spark, d, "documents").where(c("source").isNotNull() & c("text").isNotNull())
    return compact.sequence_paths(spread(docs.select(c("text").alias("seq"))), 27, project=True)


def core_simple_paths(spark, d):
    graph = source_graph(spark, d, 27)
    return traverse.simple_paths(graph, 2.0 / graph.n_genomes() + 1e-9).select("path", "n_kmers")


def components(spark, d):
    """Component of every k-mer of the graph, named by its least k-mer."""
    return traverse.graph_components(source_graph(spark, d, 27).vertices(), 27)


def subgraph_components(spark, d):
    """Components of the subgraph of the k-mers that two given genomes share."""
    return traverse.graph_components(source_graph(spark, d, 9).covering([0, 1]), 9)


def subgraph_levels(spark, d):
    """Steps within that subgraph from its branching k-mers."""
    v = cut(source_graph(spark, d, 9).covering([0, 1]))
    return traverse.bfs_levels(v, 9, search.branching(search.degrees(v, 9)))


def component_count(spark, d):
    """Components of the whole graph: their number and the largest one's size."""
    x = traverse.graph_components(source_graph(spark, d, 27).vertices(), 27)
    return x.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.sum("n").alias("vertices"))


def bfs_levels(spark, d):
    """K-mers by their steps from the nearest branching k-mer, to the end."""
    v = cut(source_graph(spark, d, 27).vertices())
    seeds = search.branching(search.degrees(v, 27))
    return traverse.bfs_levels(v, 27, seeds).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


# --- reads ------------------------------------------------------------------------------------------


def minimizer_bins(spark, d):
    r = table(spark, d, "read_counts").select("read_id", codec.bases(c("read")).alias("seq")).distinct()
    return reads.minimizer_bins(r, 7).select("read_id", "minimizer", "bin")


def rebuilt_reads(spark, d):
    """The first occurrence of every read: its letters with the occurrence's mismatches put at their places, void ones left out."""
    r = table(spark, d, "read_counts").groupBy("read_id").agg(F.max_by(F.struct("read", "occ_count"), F.coalesce("loaded_at", "seen_at")).alias("r"))
    r = r.where(c("r.read").isNotNull()).select("read_id", codec.bases(c("r.read")).alias("seq"), F.coalesce("r.occ_count", F.lit(1)).alias("occ"))
    m = table(spark, d, "mismatches").where("id_read = 0 AND length(mismatch_char) = 1").join(r.where("occ > 0").select("read_id", F.length("seq").alias("n")), "read_id")
    m = m.where((c("position") >= 0) & (c("position") < c("n"))).groupBy("read_id", "position").agg(F.max(codec.bases(c("mismatch_char"))).alias("ch"))
    return reads.put_mismatches(r.select("read_id", "seq"), m)


def hamming_distances(spark, d):
    """A demonstration of the bounded mismatch count, as the SQL has it; not a search for similar reads.

    Each read is held against one other: its successor in alphabetical order among reads of its length and first four letters.
    """
    from pyspark.sql import Window as W

    r = table(spark, d, "read_counts").where(F.length("read") > 0).groupBy("read_id").agg(F.max(codec.bases(c("read"))).alias("a"))
    w = W.partitionBy(F.length("a"), F.substring("a", 1, 4)).orderBy("a", "read_id")
    return reads.mismatches(r.withColumn("b", F.lead("a").over(w)).where(c("b").isNotNull()), 5).select("read_id", "mismatches")


QUERIES = {
    "genomes": genomes,
    "genome_base_names": genome_base_names,
    "kmer_colors_count": kmer_colors_count,
    "kmer_color_sets": kmer_color_sets,
    "color_set_dictionary": color_set_dictionary,
    "colors_by_dictionary": colors_by_dictionary,
    "kmer_encode_int": kmer_encode_int,
    "kmer_encode_bytes": kmer_encode_bytes,
    "bit_helpers": bit_helpers,
    "reverse_complement": reverse_complement,
    "canonical_kmers": canonical_kmers,
    "iupac_windows": iupac_windows,
    "iupac_codes": iupac_codes,
    "kmer_presence": kmer_presence,
    "kmer_presence_matrix": kmer_presence_matrix,
    "presence_count": presence_count,
    "sequence_containment_t30": _containment(9, 0.3),
    "sequence_containment_t50": _containment(9, 0.5),
    "sequence_containment_t90": _containment(9, 0.9),
    "sequence_containment_k18_t30": _containment(18, 0.3),
    "sequence_containment_canonical": _containment(9, 0.5, True),
    "sequence_matrix": sequence_matrix,
    "prefix_match": prefix_match,
    "degree_histogram": degree_histogram,
    "branching_kmers": branching_kmers,
    "query_branching_count": query_branching_count,
    "predecessors": _neighbors(search.predecessors),
    "successors": _neighbors(search.successors),
    "neighbors": _neighbors(search.neighbors),
    "core_kmers": core_kmers,
    "dispensable_kmers": dispensable_kmers,
    "singleton_kmers": singleton_kmers,
    "pangenome_spectrum": pangenome_spectrum,
    "color_intersection": _algebra(colors.intersection),
    "color_union": _algebra(colors.union),
    "color_symdiff": _algebra(colors.symmetric_difference),
    "color_summary": color_summary,
    "shared_colors_bounded": shared_colors_bounded,
    "genome_jaccard": genome_jaccard,
    "subgraph_kmers": subgraph_kmers,
    "subset_graph": subset_graph,
    "merge_graphs": merge_graphs,
    "add_genome": add_genome,
    "add_colors": add_colors,
    "decoded_annotations": decoded_annotations,
    "encoded_annotations": encoded_annotations,
    "index_stats": index_stats,
    "vertex_marks": vertex_marks,
    "simple_path_stats": simple_path_stats,
    "simple_paths": simple_paths,
    "core_simple_paths": core_simple_paths,
    "components": components,
    "subgraph_components": subgraph_components,
    "subgraph_levels": subgraph_levels,
    "component_count": component_count,
    "bfs_levels": bfs_levels,
    "minimizer_bins": minimizer_bins,
    "rebuilt_reads": rebuilt_reads,
    "hamming_distances": hamming_distances,
}

# --- the same in SQL ---------------------------------------------------------------------------------


def _windows(seq: str, k: int) -> str:
    return f"unnest(range(1, greatest(length({seq}) - {k} + 2, 1)::BIGINT))"


def _base(k: int, by: str = "source", tag: str = "") -> str:
    return f"""g{tag} AS (SELECT {by} AS genome_name, row_number() OVER (ORDER BY {by}) - 1 AS genome_id FROM (SELECT DISTINCT {by} FROM documents WHERE {by} IS NOT NULL)),
      s{tag} AS (SELECT genome_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents JOIN g{tag} ON {by} = genome_name WHERE text IS NOT NULL),
      kc{tag} AS (SELECT DISTINCT substr(seq, p, {k}) AS kmer, genome_id::INTEGER AS genome_id FROM (SELECT genome_id, seq, {_windows("seq", k)} AS p FROM s{tag})),
      km{tag} AS (SELECT kmer, list_sort(list(genome_id)) AS colors, count(*)::INTEGER AS n_colors FROM kc{tag} GROUP BY kmer),
      q{tag} AS (SELECT item_id AS query_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark)"""


def _sql(k: int, tail: str, *more: str) -> str:
    return "WITH " + ", ".join([_base(k), *more]) + " " + tail


_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_QK = "qk AS (SELECT query_id AS item_id, (p - 1)::INTEGER AS pos, substr(seq, p, 18) AS kmer FROM (SELECT query_id, seq, " + _windows("seq", 18) + " AS p FROM q))"


def _contain(k: int, t: float, canonical: bool = False) -> str:
    w = "substr(seq, p, " + str(k) + ")"
    w = f"least({w}, {_RC.format(w)})" if canonical else w
    return _sql(
        k,
        f"""SELECT query_id, genome_id, hits::BIGINT AS hits FROM (SELECT query_id, genome_id, n, count(*) AS hits FROM w JOIN kc USING (kmer) GROUP BY ALL)
            WHERE hits >= ceil(n * CAST({t} AS DOUBLE))""",
        f"w AS (SELECT query_id, {w} AS kmer, length(seq) - {k} + 1 AS n FROM (SELECT query_id, seq, {_windows('seq', k)} AS p FROM q))",
    )


def _degrees(k: int) -> str:
    return f"""v AS (SELECT kmer FROM km), o AS (SELECT substr(kmer, 1, {k - 1}) AS x, count(*)::INTEGER AS n FROM v GROUP BY 1),
      i AS (SELECT substr(kmer, 2) AS x, count(*)::INTEGER AS n FROM v GROUP BY 1),
      deg AS (SELECT kmer, coalesce(i.n, 0) AS indegree, coalesce(o.n, 0) AS outdegree FROM v LEFT JOIN o ON o.x = substr(kmer, 2)
        LEFT JOIN i ON i.x = substr(kmer, 1, {k - 1}))"""


def _near(sides: str) -> str:
    ahead = [f"SELECT kmer, {i}::INTEGER AS pos, '{x}' || substr(kmer, 1, 26) AS neighbor FROM v" for i, x in enumerate("ACGT")]
    after = [f"SELECT kmer, {4 + i}::INTEGER AS pos, substr(kmer, 2) || '{x}' AS neighbor FROM v" for i, x in enumerate("ACGT")]
    rows = {"ahead": ahead, "after": after, "both": ahead + after}[sides]
    return _sql(
        27,
        "SELECT x.kmer, pos, neighbor, (y.kmer IS NOT NULL) AS present FROM x LEFT JOIN v y ON y.kmer = neighbor",
        "v AS MATERIALIZED (SELECT DISTINCT kmer FROM kc)", "x AS (" + " UNION ALL ".join(rows) + ")",
    )


_THREE = """t AS (SELECT x.kmer, x.colors AS s, a.colors AS a, b.colors AS b FROM km x JOIN km a ON a.kmer = substr(x.kmer, 2) || 'A'
      JOIN km b ON b.kmer = substr(x.kmer, 2) || 'C')"""
_ALL3 = "list_filter(s, lambda z: list_contains(a, z) AND list_contains(b, z))"
_ANY3 = "list_distinct(list_concat(list_concat(s, a), b))"


def _three(expr: str) -> str:
    return _sql(9, f"SELECT kmer, array_to_string(list_sort({expr}), ',') AS result FROM t", _THREE)


_PATHS = """nb AS (SELECT kmer FROM deg WHERE indegree < 2 AND outdegree < 2),
      e AS (SELECT u.kmer AS u, v.kmer AS v FROM nb u JOIN nb v ON substr(u.kmer, 2) = substr(v.kmer, 1, 26))"""
# Chains of k-mers that branch neither way, each walked once from its head (walk has every such k-mer), and the contracted graph that is left.
_CHAINS = """vv AS MATERIALIZED (SELECT DISTINCT kmer FROM {of}),
      e AS MATERIALIZED (SELECT a.kmer AS u, b.kmer AS w FROM vv a JOIN vv b ON substr(a.kmer, 2) = substr(b.kmer, 1, {k1})),
      many AS MATERIALIZED (SELECT u AS kmer FROM e GROUP BY 1 HAVING count(*) > 1 UNION SELECT w FROM e GROUP BY 1 HAVING count(*) > 1),
      inner_ AS MATERIALIZED (SELECT u, w FROM e WHERE u NOT IN (SELECT kmer FROM many) AND w NOT IN (SELECT kmer FROM many)),
      walk AS (SELECT kmer AS head, kmer AS last, 1 AS n FROM vv WHERE kmer NOT IN (SELECT kmer FROM many) AND kmer NOT IN (SELECT w FROM inner_)
        UNION ALL SELECT head, w, n + 1 FROM walk JOIN inner_ ON u = last),
      paths AS (SELECT head || coalesce(string_agg(right(last, 1), '' ORDER BY n) FILTER (n > 1), '') AS path, count(*)::INTEGER AS n_kmers, head, max(n) AS far FROM walk GROUP BY head),
      node AS MATERIALIZED (SELECT last AS kmer, head AS node FROM walk UNION ALL SELECT kmer, kmer FROM many),
      least AS (SELECT node, min(kmer) AS least FROM node GROUP BY 1),
      ways AS MATERIALIZED (SELECT DISTINCT x.node AS a, y.node AS b FROM e JOIN node x ON x.kmer = u JOIN node y ON y.kmer = w WHERE x.node <> y.node),
      both_ AS MATERIALIZED (SELECT a, b FROM ways UNION SELECT b, a FROM ways),
      cc(node, component) USING KEY (node) AS (SELECT node, least AS component FROM least
        UNION SELECT x.node, x.component FROM (SELECT b AS node, min(component) AS component FROM cc JOIN both_ ON a = node GROUP BY 1) x
        JOIN recurring.cc r ON r.node = x.node WHERE x.component < r.component)"""
_NAMED = "SELECT kmer, component FROM node JOIN cc USING (node)"
_LEVELS = """SELECT kmer, 0 AS level FROM many UNION ALL SELECT last, least(CASE WHEN head IN (SELECT w FROM e) THEN n END,
        CASE WHEN tip IN (SELECT u FROM e) THEN far - n + 1 END)::INTEGER FROM walk JOIN (SELECT head, far, last AS tip FROM paths JOIN walk USING (head) WHERE n = far) USING (head)"""


def _chains(k: int, of: str, tail: str) -> str:
    return "WITH RECURSIVE " + ", ".join([_base(k), _CHAINS.format(of=of, k1=k - 1)]) + " " + tail


_WIDE = "wide AS (SELECT item_id, upper(regexp_replace(text, '[^ACGTNRacgtnr]', '', 'g')) AS seq FROM benchmark)"

ORACLES = {
    "genomes": _sql(9, "SELECT genome_id, genome_name FROM g"),
    "genome_base_names": "SELECT genome_id, regexp_extract(trim(filename), '([^/]*)$', 1) AS base FROM genomes",
    "kmer_colors_count": _sql(27, "SELECT genome_id, count(*) AS n_kmers FROM kc GROUP BY 1"),
    "kmer_color_sets": _sql(27, "SELECT kmer, array_to_string(colors, ',') AS colors, n_colors FROM km"),
    "colors_by_dictionary": _sql(27, "SELECT kmer, array_to_string(colors, ',') AS colors FROM km"),
    "color_set_dictionary": _sql(27, "SELECT array_to_string(colors, ',') AS colors, count(*) AS n_kmers FROM km GROUP BY 1"),
    "kmer_encode_int": _sql(9, """SELECT kmer, list_sum(list_transform(range(9), lambda i: (strpos('ACGT', substr(kmer, i + 1, 1)) - 1) * (4 ** (8 - i))))::BIGINT AS packed,
        kmer AS back FROM km"""),
    "kmer_encode_bytes": _sql(9, """SELECT kmer, array_to_string(list_transform(range(3), lambda b: printf('%02X', list_sum(list_transform(range(4), lambda i:
        greatest(strpos('ACGT', substr(kmer, b * 4 + i + 1, 1)) - 1, 0) * CASE WHEN b * 4 + i < 9 THEN 4 ** i ELSE 0 END))::BIGINT)), '') AS packed, kmer AS back FROM km"""),
    "bit_helpers": _sql(9, """SELECT kmer, bit_count(p)::INTEGER AS n_set, ceil(log2(p + 1))::INTEGER AS n_needed,
        list_sum(list_transform(range(18), lambda i: ((p >> i) & 1) << (17 - i)))::BIGINT AS turned,
        regexp_replace(translate(kmer, 'ACGT', '0123') || '0', '(.)(.)', '\\2\\1', 'g') AS swapped
        FROM (SELECT kmer, list_sum(list_transform(range(9), lambda i: (strpos('ACGT', substr(kmer, i + 1, 1)) - 1) * (4 ** (8 - i))))::BIGINT AS p FROM km)"""),
    "reverse_complement": _sql(9, f"SELECT kmer, {_RC.format('kmer')} AS rc FROM km"),
    "canonical_kmers": _sql(9, f"SELECT least(kmer, {_RC.format('kmer')}) AS canonical, count(*) AS n FROM km GROUP BY 1"),
    "iupac_windows": f"""WITH {_WIDE} SELECT item_id, count(*) AS n_windows, count(*) FILTER (regexp_matches(w, '[NR]')) AS n_skipped
        FROM (SELECT item_id, substr(seq, p, 18) AS w FROM (SELECT item_id, seq, {_windows("seq", 18)} AS p FROM wide)) GROUP BY 1""",
    "iupac_codes": f"""WITH {_WIDE} SELECT item_id, md5(translate(seq, 'ACGTMRWSYKVHDBN', '0123456789ABCDE')) AS packed, true AS back,
        (length(regexp_extract(seq, '^(.*[^ACGT])', 1)) - 1)::INTEGER AS last_non_base FROM wide""",
    "kmer_presence": _sql(18, "SELECT item_id, pos, qk.kmer, count(genome_id) AS n_genomes FROM qk LEFT JOIN kc USING (kmer) GROUP BY 1, 2, 3", _QK),
    "presence_count": _sql(18, "SELECT count(*) AS n_present FROM qk WHERE kmer IN (SELECT kmer FROM km)", _QK),
    "sequence_containment_t30": _contain(9, 0.3),
    "sequence_containment_t50": _contain(9, 0.5),
    "sequence_containment_t90": _contain(9, 0.9),
    "sequence_containment_k18_t30": _contain(18, 0.3),
    "sequence_containment_canonical": _contain(9, 0.5, True),
    "kmer_presence_matrix": _sql(18, """SELECT item_id, pos, string_agg(CASE WHEN kc.kmer IS NULL THEN '0' ELSE '1' END, ',' ORDER BY g.genome_id) AS present
        FROM qk CROSS JOIN g LEFT JOIN kc ON kc.kmer = qk.kmer AND kc.genome_id = g.genome_id GROUP BY 1, 2""", _QK),
    "sequence_matrix": "WITH f AS (" + _contain(9, 0.5) + """), g AS (SELECT row_number() OVER (ORDER BY source) - 1 AS genome_id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
        SELECT item_id AS query_id, string_agg(CASE WHEN f.genome_id IS NULL THEN '0' ELSE '1' END, ',' ORDER BY g.genome_id) AS present
        FROM benchmark CROSS JOIN g LEFT JOIN f ON f.query_id = item_id AND f.genome_id = g.genome_id GROUP BY 1""",
    "prefix_match": _sql(18, "SELECT kmer FROM km WHERE kmer LIKE 'ACG%'"),
    "degree_histogram": _sql(18, "SELECT indegree, outdegree, count(*) AS n FROM deg GROUP BY 1, 2", _degrees(18)),
    "branching_kmers": _sql(27, "SELECT * FROM deg WHERE indegree > 1 OR outdegree > 1", _degrees(27)),
    "query_branching_count": _sql(18, """SELECT count(*) AS n_branching FROM qk LEFT JOIN o ON o.x = substr(kmer, 2) LEFT JOIN i ON i.x = substr(kmer, 1, 17)
        WHERE coalesce(o.n, 0) > 1 OR coalesce(i.n, 0) > 1""", _degrees(18), _QK),
    "predecessors": _near("ahead"),
    "successors": _near("after"),
    "neighbors": _near("both"),
    "core_kmers": _sql(9, "SELECT kmer FROM km WHERE n_colors = (SELECT count(*) FROM g)"),
    "dispensable_kmers": _sql(9, "SELECT kmer FROM km WHERE n_colors < (SELECT count(*) FROM g)"),
    "singleton_kmers": _sql(9, "SELECT kmer FROM km WHERE n_colors = 1"),
    "pangenome_spectrum": _sql(9, "SELECT n_colors, count(*) AS n_kmers FROM km GROUP BY 1"),
    "color_intersection": _three(_ALL3),
    "color_union": _three(_ANY3),
    "color_symdiff": _three(f"list_filter({_ANY3}, lambda z: NOT (list_contains(s, z) AND list_contains(a, z) AND list_contains(b, z)))"),
    "color_summary": _sql(18, "SELECT kmer, n_colors AS n, list_max(colors) AS last, list_contains(colors, 1) AS has_1 FROM km"),
    "shared_colors_bounded": _sql(9, "SELECT kmer, least(len(list_intersect(a, b)), 4)::INTEGER AS shared FROM t", _THREE),
    "genome_jaccard": _sql(9, """SELECT a, b, shared, x.n + y.n - shared AS united FROM (SELECT p.genome_id AS a, r.genome_id AS b, count(*) AS shared
        FROM kc p JOIN kc r ON p.kmer = r.kmer AND p.genome_id < r.genome_id GROUP BY 1, 2) JOIN size x ON x.genome_id = a JOIN size y ON y.genome_id = b""",
        "size AS (SELECT genome_id, count(*) AS n FROM kc GROUP BY 1)"),
    "subgraph_kmers": _sql(9, "SELECT kmer FROM km WHERE list_contains(colors, 0) AND list_contains(colors, 1)"),
    "subset_graph": _sql(18, "SELECT genome_id, count(*) AS n_kmers FROM kc WHERE kmer LIKE 'ACG%' GROUP BY 1"),
    "merge_graphs": "WITH " + _base(18) + ", " + _base(18, "lang", "2") + """ SELECT genome_name, n_kmers FROM (SELECT genome_id, count(*) AS n_kmers FROM kc GROUP BY 1) JOIN g USING (genome_id)
        UNION ALL SELECT genome_name, n_kmers FROM (SELECT genome_id, count(*) AS n_kmers FROM kc2 GROUP BY 1) JOIN g2 USING (genome_id)""",
    "add_genome": _sql(18, """SELECT n::INTEGER AS n_colors, count(*) AS n_kmers FROM (SELECT kmer, count(*) AS n FROM (SELECT kmer, genome_id FROM kc
        UNION ALL SELECT DISTINCT kmer, -1 FROM qk) GROUP BY 1) GROUP BY 1""", _QK),
    "add_colors": _sql(18, """SELECT n::INTEGER AS n_colors, count(*) AS n_kmers FROM (SELECT kmer, count(DISTINCT genome_id) AS n FROM (SELECT kmer, genome_id FROM kc
        UNION ALL SELECT kmer, unnest([0, 1]) FROM km WHERE kmer LIKE 'ACG%') GROUP BY 1) GROUP BY 1"""),
    "decoded_annotations": """SELECT replace(upper(kmer), 'U', 'T') AS kmer, graph_id, array_to_string(list_sort(list_distinct(colors)), ',') AS colors
        FROM kmers WHERE annot IS NOT NULL""",
    "encoded_annotations": "SELECT replace(upper(kmer), 'U', 'T') AS kmer, graph_id, hex(annot) AS annot_hex FROM kmers WHERE annot IS NOT NULL",
    "index_stats": _sql(27, "SELECT count(*) AS n_kmers, sum(n_colors)::BIGINT AS n_pairs, max(n_colors) AS largest_set, 27 AS k FROM km"),
    "vertex_marks": _sql(27, """SELECT CASE WHEN indegree = 0 THEN 1 WHEN outdegree > 1 OR indegree > 1 THEN 2 ELSE 0 END AS flag, count(*) AS n FROM deg GROUP BY 1""", _degrees(27)),
    "simple_path_stats": _sql(27, "SELECT (SELECT count(*) FROM nb) AS vertices, (SELECT count(*) FROM e) AS edges", _degrees(27), _PATHS),
    "core_simple_paths": "WITH RECURSIVE " + ", ".join([_base(27), _degrees(27), """nb AS (SELECT kmer, colors FROM deg JOIN km USING (kmer) WHERE indegree < 2 AND outdegree < 2 AND n_colors >= 2),
      e AS MATERIALIZED (SELECT u.kmer AS u, v.kmer AS v FROM nb u JOIN nb v ON substr(u.kmer, 2) = substr(v.kmer, 1, 26) WHERE len(list_intersect(u.colors, v.colors)) >= 2),
      walk AS (SELECT kmer AS last, kmer AS path, 1 AS n FROM nb WHERE kmer NOT IN (SELECT v FROM e)
        UNION ALL SELECT v, path || substr(v, 27, 1), n + 1 FROM walk JOIN e ON u = last)"""]) + " SELECT path, n::INTEGER AS n_kmers FROM walk WHERE last NOT IN (SELECT u FROM e)",
    "simple_paths": _chains(27, "kc", "SELECT path, n_kmers FROM paths"),
    "bfs_levels": _chains(27, "kc", "SELECT level, count(*) AS n FROM (" + _LEVELS + ") WHERE level IS NOT NULL GROUP BY 1"),
    "subgraph_components": _chains(9, "(SELECT kmer FROM km WHERE list_contains(colors, 0) AND list_contains(colors, 1))", _NAMED),
    "subgraph_levels": _chains(9, "(SELECT kmer FROM km WHERE list_contains(colors, 0) AND list_contains(colors, 1))", "SELECT * FROM (" + _LEVELS + ") WHERE level IS NOT NULL"),
    "minimizer_bins": """WITH r AS (SELECT DISTINCT read_id, replace(upper(read), 'U', 'T') AS seq FROM read_counts),
      m AS (SELECT read_id, min(w) AS minimizer FROM (SELECT read_id, substr(s, p, 7) AS w FROM (SELECT read_id, s, unnest(range(1, greatest(length(s) - 5, 1)::BIGINT)) AS p
        FROM (SELECT read_id, seq AS s FROM r UNION ALL SELECT read_id, reverse(translate(seq, 'ACGTUMRWSYKVHDBN', 'TGCAAKYWSRMBDHVN')) FROM r)))
        WHERE regexp_full_match(w, '[ACGT]+') AND NOT regexp_matches(w, 'AAA|CCC|GGG|TTT') GROUP BY 1)
      SELECT read_id, minimizer, coalesce(list_sum(list_transform(range(7), lambda i: (strpos('ACGT', substr(minimizer, i + 1, 1)) - 1) * (4 ** (6 - i))))::BIGINT, 0) AS bin
      FROM r LEFT JOIN m USING (read_id)""",
    "rebuilt_reads": """WITH r AS (SELECT read_id, replace(upper(arg_max(read, loaded_at)), 'U', 'T') AS read, coalesce(arg_max(struct_pack(o := occ_count), loaded_at).o, 1) AS occ
        FROM read_counts GROUP BY read_id),
      m AS (SELECT read_id, position AS p, max(replace(upper(mismatch_char), 'U', 'T')) AS ch FROM mismatches JOIN r USING (read_id)
        WHERE mismatch_char IS NOT NULL AND id_read = 0 AND occ > 0 AND position >= 0 AND position < length(read) GROUP BY 1, 2),
      x AS (SELECT read_id, string_agg(coalesce(ch, substr(read, p + 1, 1)), '' ORDER BY p) AS seq
        FROM (SELECT read_id, read, unnest(range(length(read))) AS p FROM r) LEFT JOIN m USING (read_id, p) GROUP BY 1)
      SELECT read_id, coalesce(seq, '') AS seq FROM r LEFT JOIN x USING (read_id) WHERE read IS NOT NULL""",
    "hamming_distances": """WITH r AS (SELECT read_id, max(replace(upper(read), 'U', 'T')) AS a FROM read_counts WHERE length(read) > 0 GROUP BY 1),
      p AS (SELECT read_id, a, lead(a) OVER (PARTITION BY length(a), substr(a, 1, 4) ORDER BY a, read_id) AS b FROM r)
      SELECT read_id, CASE WHEN hamming(a, b) > 5 THEN -1 ELSE hamming(a, b) END::INTEGER AS mismatches FROM p WHERE b IS NOT NULL""",
}
