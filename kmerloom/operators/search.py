"""Queries against a graph: presence of k-mers, containment of sequences, neighbours and degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from .graph import ColoredGraph

BASES = "ACGT"


def kmer_presence(graph: ColoredGraph, queries: DataFrame) -> DataFrame:
    """(query_id, kmer, valid, genome_id): a row per query k-mer and genome that has it, genome_id null if none has.

    Rows keep their identity by query_id, duplicates too; invalid k-mers stay, with valid = false.
    """
    b = codec.bases(F.col("kmer"))
    asked = queries.select("query_id", b.alias("kmer"), F.coalesce(codec.is_kmer(b, graph.k), F.lit(False)).alias("valid"))
    return asked.join(graph.kmer_colors, "kmer", "left").select("query_id", "kmer", "valid", "genome_id")


def presence_matrix(rows: DataFrame, genome_ids: list[int]) -> DataFrame:
    """(query_id, g0, g1, ...): 0 or 1 per genome, for rows with a nullable genome_id. The ids are given, not searched; for a few genomes."""
    hit = lambda i: F.coalesce(F.max((F.col("genome_id") == i).cast("int")), F.lit(0)).alias(f"g{i}")
    return rows.groupBy("query_id").agg(*[hit(i) for i in genome_ids])


def presence_rows(rows: DataFrame, genomes: DataFrame) -> DataFrame:
    """(query_id, present): the matrix's rows as text, a 0 or 1 per genome of the registry in the order of ids, apart by commas.

    For any number of genomes: no column each, and no id passes through the driver.
    """
    n = genomes.agg(F.coalesce(F.max("genome_id") + 1, F.lit(0)).alias("n"))
    held = rows.groupBy("query_id").agg(F.array_sort(F.collect_set("genome_id")).alias("ids"))  # sets, bounded by the registry
    zeros = lambda m: F.repeat(F.lit("0,"), m)
    # between two ids that are there stand as many zeros as ids are skipped
    put = F.aggregate("ids", F.struct(F.lit("").alias("t"), F.lit(0).alias("at")), lambda s, i: F.struct(F.concat(s["t"], zeros(i - s["at"]), F.lit("1,")).alias("t"), (i + 1).alias("at")))
    whole = held.select("query_id", put.alias("s")).withColumn("n", n.scalar())
    text = F.concat(F.col("s.t"), zeros(F.col("n") - F.col("s.at")))
    return whole.select("query_id", F.regexp_replace(text, ",$", "").alias("present"))


def sequence_hits(graph: ColoredGraph, queries: DataFrame, canonical: bool = False) -> DataFrame:
    """(query_id, genome_id, hits, n_windows): windows of each query that a genome has, repeats counted.

    Windows with a non-base are skipped but count in n_windows. With ``canonical`` the smaller of a window
    and its reverse complement is looked up. Equal windows of a query are folded before the join.
    """
    k = graph.k
    windows = queries.select("query_id", F.explode(codec.kmers(F.col("seq"), k)).alias("kmer")).where(codec.is_kmer(F.col("kmer"), k))
    if canonical:
        windows = windows.withColumn("kmer", codec.canonical(F.col("kmer")))
    folded = windows.groupBy("query_id", "kmer").agg(F.count(F.lit(1)).alias("times"))
    sizes = queries.select("query_id", codec.n_windows(F.col("seq"), k).alias("n_windows"))
    hits = folded.join(graph.kmer_colors, "kmer").groupBy("query_id", "genome_id").agg(F.sum("times").alias("hits"))
    return hits.join(sizes, "query_id")


def sequence_containment(graph: ColoredGraph, queries: DataFrame, threshold: float, canonical: bool = False) -> DataFrame:
    """(query_id, genome_id, hits): genomes that have at least ceil(n_windows * threshold) windows of the query, and one."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    need = F.ceil(F.col("n_windows") * F.lit(float(threshold)))
    found = sequence_hits(graph, queries, canonical).where((F.col("hits") >= need) & (F.col("hits") > 0))
    return found.select("query_id", "genome_id", "hits")


class Form:
    """How vertices are held while edges are sought: as whole numbers for k of at most 31, else as text. Both sort alike."""

    def __init__(self, k: int) -> None:
        self.k, self.packed = k, k <= 31

    def of(self, kmer: Column) -> Column:
        return codec.pack_int(kmer) if self.packed else kmer

    def text(self, v: Column) -> Column:
        return codec.unpack_int(v, self.k) if self.packed else v

    def head(self, v: Column) -> Column:
        """All letters but the last."""
        return F.shiftright(v, 2) if self.packed else F.substring(v, 1, self.k - 1)

    def tail(self, v: Column) -> Column:
        """All letters but the first."""
        return v.bitwiseAND(F.lit((1 << 2 * (self.k - 1)) - 1)) if self.packed else F.substring(v, 2, self.k - 1)

    def first(self, v: Column) -> Column:
        """The first letter, as a number from 0 to 3."""
        return F.shiftright(v, 2 * (self.k - 1)).cast("int") if self.packed else F.instr(F.lit(BASES), F.substring(v, 1, 1)) - 1

    def last(self, v: Column) -> Column:
        return v.bitwiseAND(F.lit(3)).cast("int") if self.packed else F.instr(F.lit(BASES), F.substring(v, -1, 1)) - 1

    def before(self, i: int, mid: Column) -> Column:
        """The letter i in front of a (k-1)-mer."""
        return F.lit(i << 2 * (self.k - 1)).cast("bigint").bitwiseOR(mid) if self.packed else F.concat(F.lit(BASES[i]), mid)

    def behind(self, mid: Column, i: int) -> Column:
        return F.shiftleft(mid, 2).bitwiseOR(F.lit(i).cast("bigint")) if self.packed else F.concat(mid, F.lit(BASES[i]))


def _sides(vertices: DataFrame, form: Form, into: str, out: str) -> DataFrame:
    """(mid, into, out): every vertex at the (k-1)-mer that it leads into and at the one that it comes out of, its other letter as a bit."""
    v, bit = F.col("v"), lambda i: F.call_function("shiftleft", F.lit(1), i)
    ends = F.array(
        F.struct(form.tail(v).alias("mid"), bit(form.first(v)).alias(into), F.lit(0).alias(out)), F.struct(form.head(v).alias("mid"), F.lit(0).alias(into), bit(form.last(v)).alias(out))
    )
    return vertices.select(F.explode(ends).alias("x")).select("x.*")


def junctions(vertices: DataFrame, form: Form, chosen: DataFrame | None = None) -> DataFrame:
    """(mid, ins, outs) of ``vertices(v)``: per (k-1)-mer the letters of the vertices that lead into it and that come out of it, as four bits each.

    One aggregate, combined on the map side; all edges through a (k-1)-mer are in its row. With ``chosen(v)``
    the columns ask_ins and ask_outs have the letters of those.
    """
    rows = _sides(vertices, form, "ins", "outs")
    if chosen is None:
        return rows.groupBy("mid").agg(F.bit_or("ins").alias("ins"), F.bit_or("outs").alias("outs"))
    none = lambda *c: [F.lit(0).alias(x) for x in c]
    asked = _sides(chosen, form, "ask_ins", "ask_outs").select("mid", *none("ins", "outs"), "ask_ins", "ask_outs")
    both = rows.select("mid", "ins", "outs", *none("ask_ins", "ask_outs")).unionByName(asked)
    return both.groupBy("mid").agg(*[F.bit_or(c).alias(c) for c in ("ins", "outs", "ask_ins", "ask_outs")])


def _letters(mask: Column, each) -> Column:
    """``each(i)`` of the letters i in a mask."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, each(i)) for i in range(4)]))


def vertex_degrees(vertices: DataFrame, form: Form) -> DataFrame:
    """(v, indegree, outdegree) of ``vertices(v)``: each vertex hears from the (k-1)-mers at its two ends."""
    mid, ins, outs = F.col("mid"), F.col("ins"), F.col("outs")
    row = lambda v, a, b: F.struct(v.alias("v"), a.alias("indegree"), b.alias("outdegree"))
    no = F.lit(0)
    here = F.concat(_letters(ins, lambda i: row(form.before(i, mid), no, F.bit_count(outs))), _letters(outs, lambda i: row(form.behind(mid, i), F.bit_count(ins), no)))
    told = junctions(vertices, form).select(F.explode(here).alias("x")).select("x.*")
    n = lambda c: F.sum(c).cast("int").alias(c)
    return told.groupBy("v").agg(n("indegree"), n("outdegree"))


def degrees(kmers: DataFrame, k: int) -> DataFrame:
    """(kmer, indegree, outdegree) of distinct k-mers: two aggregates of small numbers, no join and no candidate rows."""
    form = Form(k)
    return vertex_degrees(kmers.select(form.of(F.col("kmer")).alias("v")), form).select(form.text(F.col("v")).alias("kmer"), "indegree", "outdegree")


def query_degrees(queries: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """Degrees of query k-mers, which need not be in the graph, row by row (query_id kept)."""
    q = queries.select("query_id", codec.bases(F.col("kmer")).alias("kmer")).where(codec.is_kmer(F.col("kmer"), k))
    after = kmers.groupBy(F.substring("kmer", 1, k - 1).alias("tail")).agg(F.count(F.lit(1)).alias("outdegree"))
    before = kmers.groupBy(F.substring("kmer", 2, k - 1).alias("head")).agg(F.count(F.lit(1)).alias("indegree"))
    out = q.withColumns({"head": F.substring("kmer", 1, k - 1), "tail": F.substring("kmer", 2, k - 1)}).join(after, "tail", "left").join(before, "head", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    return out.select("query_id", "kmer", n("indegree"), n("outdegree"))


def branching(degrees_: DataFrame) -> DataFrame:
    """K-mers with more than one predecessor or more than one successor."""
    return degrees_.where((F.col("indegree") > 1) | (F.col("outdegree") > 1))


def neighbors(chosen: DataFrame, kmers: DataFrame, k: int, sides: str = "both") -> DataFrame:
    """(kmer, pos, neighbor, present): positions 0-3 are the predecessors with A, C, G, T in front, 4-7 the successors.

    Of distinct ``chosen(kmer)``, which need not be among ``kmers``. All candidates of a k-mer stand at the (k-1)-mers
    of its two ends, so one aggregate tells which are there. ``sides``: predecessors, successors or both.
    """
    form, mid = Form(k), F.col("mid")
    v = lambda df: df.select(form.of(F.col("kmer")).alias("v"))
    at = junctions(v(kmers), form, None if chosen is kmers else v(chosen))
    ask_ins, ask_outs = ("ins", "outs") if chosen is kmers else ("ask_ins", "ask_outs")
    row = lambda x, pos, y, mask, i: F.struct(x.alias("v"), F.lit(pos).alias("pos"), y.alias("w"), (F.col(mask).bitwiseAND(F.lit(1 << i)) > 0).alias("present"))
    after = F.flatten(_letters(F.col(ask_ins), lambda i: F.array(*[row(form.before(i, mid), 4 + j, form.behind(mid, j), "outs", j) for j in range(4)])))
    ahead = F.flatten(_letters(F.col(ask_outs), lambda j: F.array(*[row(form.behind(mid, j), i, form.before(i, mid), "ins", i) for i in range(4)])))
    rows = {"both": F.concat(ahead, after), "predecessors": ahead, "successors": after}[sides]
    out = at.select(F.explode(rows).alias("x")).select("x.*")
    return out.select(form.text(F.col("v")).alias("kmer"), "pos", form.text(F.col("w")).alias("neighbor"), "present")


def predecessors(chosen: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    return neighbors(chosen, kmers, k, "predecessors")


def successors(chosen: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    return neighbors(chosen, kmers, k, "successors")


def vertex_edges(vertices: DataFrame, form: Form) -> DataFrame:
    """(u, v) of all edges among ``vertices(v)``: the tail of u is the head of v. At most 16 rows a (k-1)-mer, and no join."""
    mid = F.col("mid")
    pairs = F.flatten(_letters(F.col("ins"), lambda i: _letters(F.col("outs"), lambda j: F.struct(form.before(i, mid).alias("u"), form.behind(mid, j).alias("v")))))
    return junctions(vertices, form).where((F.col("ins") > 0) & (F.col("outs") > 0)).select(F.explode(pairs).alias("x")).select("x.*")


def edges(kmers: DataFrame, k: int) -> DataFrame:
    """(u, v) of all edges, as text."""
    form = Form(k)
    e = vertex_edges(kmers.select(form.of(F.col("kmer")).alias("v")), form)
    return e.select(form.text(F.col("u")).alias("u"), form.text(F.col("v")).alias("v"))
