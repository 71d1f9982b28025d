"""Iterative graph operators: non-branching paths by pointer doubling, components by stars, breadth-first levels by stations and chains.

Every round is one or two equi-joins, written to the shared checkpoint folder; what reaches the driver
is one number a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, stored
from .graph import ColoredGraph
from .search import Form, vertex_degrees, vertex_edges


def _doubled(open_: DataFrame, all_: DataFrame) -> DataFrame:
    """ptr jumps to ptr's ptr; distances add up; the least vertex met so far is kept; whose ptr is done is done.

    Joins of rounds are merged: what is small on disk or in a shuffle may be too large for the driver to broadcast.
    """
    to = all_.select(F.col("v").alias("ptr"), F.col("ptr").alias("p2"), F.col("dist").alias("d2"), F.col("least").alias("l2"), F.col("done").alias("done2"))
    return open_.join(to.hint("merge"), "ptr").select("v", F.col("p2").alias("ptr"), (F.col("dist") + F.col("d2")).alias("dist"), F.least("least", "l2").alias("least"), F.col("done2").alias("done"))


def _ranked(pred: DataFrame) -> DataFrame:
    """(v, head, dist) of ``pred(v, pred)`` (pred null for heads), cycles cut at their least vertex.

    A vertex at distance d reaches its head in log2(d) rounds; only vertices that haven't go on, and every round
    settles some vertex as long as any vertex of a chain is left. What is left then lies on cycles.
    """
    head = F.col("pred").isNull()
    start = lambda p: p.select("v", F.coalesce("pred", "v").alias("ptr"), F.when(head, 0).otherwise(1).cast("bigint").alias("dist"), F.least("v", "pred").alias("least"), head.alias("done"))
    left = lambda df: df.agg(F.count_if(~F.col("done"))).first()[0]
    state = stored(start(pred))
    settled, n = state.where("done"), left(state)
    while n:
        open_ = state.where(~F.col("done"))
        state = stored(_doubled(open_, settled.unionByName(open_)))
        now = left(state)
        if now == n:
            break
        settled, n = settled.unionByName(state.where("done")), now
    finished = settled.select("v", F.col("ptr").alias("head"), "dist")
    if not n:
        return finished
    # cycles: the least vertex of each spreads in as many rounds; its own predecessor is then forgotten
    ring = stored(pred.join(state.where(~F.col("done")).select("v").hint("merge"), "v", "left_semi"))
    state = stored(start(ring))
    while True:
        again = stored(_doubled(state, state))
        moved = again.select("v", F.col("least").alias("now")).join(state.select("v", "least").hint("merge"), "v").where(F.col("now") != F.col("least"))
        state = again
        if not moved.limit(1).count():
            break
    opened = ring.join(state.select("v", "least").hint("merge"), "v").select("v", F.when(F.col("v") != F.col("least"), F.col("pred")).alias("pred"))
    return finished.unionByName(_ranked(stored(opened)))


def eligible_edges(graph: ColoredGraph, ratio: float | None = None) -> tuple[DataFrame, DataFrame, Form]:
    """(vertices(v), edges(u, v), form) of the path problem.

    Vertices branch neither way in the whole graph. With a ratio they are in at least m = trunc(ratio * genomes)
    genomes, and an edge's two k-mers have at least m genomes in common.
    """
    form = Form(graph.k)
    v = form.of(F.col("kmer")).alias("v")
    plain = vertex_degrees(graph.vertices().select(v), form).where((F.col("indegree") < 2) & (F.col("outdegree") < 2)).select("v")
    m = 0 if ratio is None else int(ratio * graph.n_genomes())
    if m <= 0:
        plain = cut(plain)
        return plain, vertex_edges(plain, form), form
    sets = cut(graph.kmers().where(F.col("n_colors") >= m).select(v, "colors").join(plain, "v", "left_semi"))
    e = vertex_edges(sets.select("v"), form)
    a, b = sets.select(F.col("v").alias("u"), F.col("colors").alias("cu")), sets.select("v", F.col("colors").alias("cv"))
    both = e.join(a, "u").join(b, "v").where(F.size(F.array_intersect("cu", "cv")) >= m)
    return sets.select("v"), both.select("u", "v"), form


def simple_paths(graph: ColoredGraph, ratio: float | None = None) -> DataFrame:
    """(head, path, n_kmers): maximal chains of non-branching k-mers (with a ratio: the core ones).

    A lone vertex is a path of length k; a cycle is one path that begins at its least k-mer. A path's text is
    one value and so one row's size, whatever the plan.
    """
    if ratio is None and 2 <= graph.k <= 31:
        from .compact import sequence_paths

        found = sequence_paths(graph.vertices().select(F.col("kmer").alias("seq")), graph.k)
        return found.select(F.substring("path", 1, graph.k).alias("head"), "path", "n_kmers")
    vertices, e, form = eligible_edges(graph, ratio)
    ranked = _ranked(cut(vertices.join(e.select("v", F.col("u").alias("pred")), "v", "left")))
    steps = ranked.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("dist", form.last(F.col("v")).alias("c")))).alias("x"))
    letters = F.translate(F.array_join(F.transform(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda s: s["c"].cast("string")), ""), "0123", "ACGT")
    return steps.withColumn("head", form.text(F.col("head"))).select("head", F.concat("head", letters).alias("path"), F.size("x").alias("n_kmers"))


def connected_components(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, component): the least vertex that each vertex of ``vertices(v)`` is linked to by ``pairs(a, b)``.

    Alternating large and small stars: minima per vertex are combined on the map side and joined back, so a
    vertex with a third of all links is a skewed join at most, never a collected group. About log(n) rounds.
    """
    one = pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    links, print_ = cut(one), None
    while True:
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("w")).unionByName(links.select(F.col("hi").alias("u"), F.col("lo").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("w") > F.col("u")).select(F.col("m").alias("lo"), F.col("w").alias("hi"))
        large = large.where(F.col("lo") != F.col("hi")).distinct()
        large = cut(large)
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        near = large.join(low, "hi")
        small = near.select(F.least("m", "lo").alias("lo"), F.greatest("m", "lo").alias("hi")).unionByName(low.select(F.col("m").alias("lo"), "hi"))
        links = cut(small.where(F.col("lo") != F.col("hi")).distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).first())
        if now == print_:
            break
        print_ = now
    root = links.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("component"))
    return vertices.join(root, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


LOCAL_EDGES = 1 << 20  # edges that a task contracts at once
SEED_LETTERS = 11  # words of this length choose where an edge is contracted


def _place(mid: Column, form: Form) -> Column:
    """The least hash of a (k-1)-mer's words: neighbouring (k-1)-mers mostly have the same, so chains mostly stay together."""
    m = min(SEED_LETTERS, form.k - 1)
    at = range(form.k - 1 - m + 1)
    word = (lambda i: F.shiftright(mid, 2 * i).bitwiseAND(F.lit((1 << 2 * m) - 1).cast("bigint"))) if form.packed else (lambda i: F.substring(mid, i + 1, m))
    hashes = [F.xxhash64(word(i)) for i in at]
    return F.least(*hashes) if len(hashes) > 1 else hashes[0]


def _contracted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges (a, b), in chunks: every vertex with the least vertex that the chunk's edges link it to."""

    def roots(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        a, b = (t.column(c).to_numpy() for c in ("a", "b"))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(ids))
        while len(x):
            lx, ly = label[x], label[y]
            apart = lx != ly
            x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
            np.minimum.at(label, lx, ly)
            np.minimum.at(label, ly, lx)
            while not np.array_equal(up := label[label], label):
                label = up
        return pa.RecordBatch.from_arrays([pa.array(ids, t.schema.field("a").type), pa.array(ids[label], t.schema.field("a").type)], names=["v", "root"])

    held, rows = [], 0
    for batch in stream:
        held.append(batch)
        rows += batch.num_rows
        if rows >= LOCAL_EDGES:
            yield roots(held)
            held, rows = [], 0
    if rows:
        yield roots(held)


def graph_components(kmers: DataFrame, k: int) -> DataFrame:
    """(kmer, component): weakly connected components of the graph that the k-mers induce; named by their least k-mer.

    Edges that lie close together on a chain are brought together by a word that their (k-1)-mers share and contracted
    where they are; only what the contracted pieces have in common goes through the rounds of :func:`connected_components`.
    """
    form = Form(k)
    v = cut(kmers.select(form.of(F.col("kmer")).alias("v")).distinct())
    mid = F.col("mid")
    e = vertex_edges(v, form).select(F.col("u").alias("a"), F.col("v").alias("b"), form.tail(F.col("u")).alias("mid"))
    kind = "BIGINT" if form.packed else "STRING"
    near = e.withColumn("place", _place(mid, form)).repartition("place").select("a", "b").mapInArrow(_contracted, f"v {kind}, root {kind}")
    stars = cut(near)
    lowest = cut(stars.groupBy("v").agg(F.min("root").alias("root"), F.max("root").alias("most")))
    several = lowest.where(F.col("root") < F.col("most")).select("v", F.col("root").alias("a"))
    links = stars.join(several, "v").where(F.col("root") != F.col("a")).select("a", F.col("root").alias("b"))
    links = cut(links.distinct())
    roots = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    named = connected_components(links, roots).withColumnRenamed("v", "root")
    whole = v.join(lowest.select("v", "root"), "v", "left").join(named, "root", "left")
    return whole.select(form.text(F.col("v")).alias("kmer"), form.text(F.coalesce("component", "root", "v")).alias("component"))


def bfs_levels(kmers: DataFrame, k: int, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(kmer, level): steps from the nearest seed along edges in either direction, for what is reached.

    Seeds and vertices with more than one way in or out are stations; the chains between them are ranked once, in
    log2(length) rounds, and walked in one step each, so rounds are needed only from station to station.
    """
    form = Form(k)
    v = cut(kmers.select(form.of(F.col("kmer")).alias("v")).distinct())
    seed = v.join(seeds.select(form.of(F.col("kmer")).alias("v")).distinct(), "v", "left_semi").withColumn("seed", F.lit(True))
    e = cut(vertex_edges(v, form).where(F.col("u") != F.col("v")))
    deg = vertex_degrees(v, form).join(seed, "v", "left")
    station = cut(deg.where((F.col("indegree") > 1) | (F.col("outdegree") > 1) | F.col("seed").isNotNull()).select("v", F.coalesce("seed", F.lit(False)).alias("seed")))
    at = lambda c: station.select(F.col("v").alias(c), F.lit(True).alias(f"s{c}"))
    marked = cut(e.join(at("u"), "u", "left").join(at("v"), "v", "left").select("u", "v", F.coalesce("su", F.lit(False)).alias("su"), F.coalesce("sv", F.lit(False)).alias("sv")))
    inner = marked.where(~F.col("su") & ~F.col("sv"))
    links = inner.select("v", F.col("u").alias("pred"))
    rank = cut(_ranked(cut(v.join(station.select("v"), "v", "left_anti").join(links, "v", "left"))))
    length = rank.groupBy("head").agg(F.max("dist").alias("far"))
    # where a chain touches stations: ahead of its head and behind its last vertex
    ahead = marked.where(F.col("su") & ~F.col("sv")).join(rank, "v").select("head", F.col("u").alias("a"))
    last = rank.join(length, "head").where(F.col("dist") == F.col("far")).select(F.col("v").alias("u"), "head", "far")
    behind = marked.where(~F.col("su") & F.col("sv")).join(last, "u").select("head", "far", F.col("v").alias("b"))
    through = ahead.join(behind, "head").select("a", "b", (F.col("far") + 2).alias("w"))
    direct = marked.where(F.col("su") & F.col("sv")).select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1).cast("bigint").alias("w"))
    one = through.unionByName(direct)
    ways = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.min("w").alias("w")))
    best = cut(station.where("seed").select("v", F.lit(0).cast("bigint").alias("level")))
    front = best
    while True:  # stations: shortest ways, round by round
        told = front.join(ways, F.col("v") == F.col("a")).groupBy("b").agg(F.min(F.col("level") + F.col("w")).alias("level")).select(F.col("b").alias("v"), "level")
        better = told.join(best.select("v", F.col("level").alias("had")), "v", "left").where(F.col("had").isNull() | (F.col("level") < F.col("had")))
        front = cut(better.select("v", "level"))
        if front.isEmpty():
            break
        best = cut(best.unionByName(front).groupBy("v").agg(F.min("level").alias("level")))
    from_head = ahead.join(best.withColumnRenamed("v", "a"), "a").groupBy("head").agg(F.min("level").alias("x"))
    from_last = behind.join(best.withColumnRenamed("v", "b"), "b").groupBy("head").agg(F.min("level").alias("y"))
    inside = rank.join(length, "head").join(from_head, "head", "left").join(from_last, "head", "left")
    inside = inside.select("v", F.least(F.col("x") + 1 + F.col("dist"), F.col("y") + 1 + F.col("far") - F.col("dist")).alias("level")).where(F.col("level").isNotNull())
    out = best.unionByName(inside)
    out = out if most is None else out.where(F.col("level") <= most)
    return out.select(form.text(F.col("v")).alias("kmer"), F.col("level").cast("int").alias("level"))
