import pytest
from pyspark.sql import functions as F

from kmerloom import cli
from kmerloom.operators import graph as g
from kmerloom.operators import search, traverse
from kmerloom.operators.graph import ColoredGraph
from kmerloom.sources import readers, sinks
from kmerloom.streaming.append import append_stream, stored_pairs

TOY = ["ACGGTCATTGCAAGCTTACG", "ACGGTCATTGGAAGCTTACG", "ACGGTCATTGCAATTTCGGA"]


@pytest.fixture(scope="module")
def toy(spark):
    return ColoredGraph.from_sequences(spark.createDataFrame([(f"g{i}", s) for i, s in enumerate(TOY)], "genome_name string, seq string"), 9)


def col(df, *names):
    return sorted(tuple(r) if len(names) > 1 else r[0] for r in df.select(*names).collect())


def test_counts_and_partitions(toy):
    counts = toy.counts().cache()
    assert counts.count() == 28 and toy.kmer_colors.count() == 36
    assert col(g.core(counts, 3), "kmer") == ["ACGGTCATT", "CGGTCATTG"]
    assert (g.dispensable(counts, 3).count(), g.singleton(counts).count()) == (26, 22)
    assert sum(r.n_kmers for r in g.spectrum(counts).collect()) == 28
    assert toy.statistics().first() == (28, 36, 3, 9)


def test_degrees(toy):
    d = search.degrees(toy.vertices(), 9).cache()
    assert col(search.branching(d), "kmer", "indegree", "outdegree") == [("AAGCTTACG", 2, 0), ("CGGTCATTG", 1, 2), ("TCATTGCAA", 1, 2)]
    total = d.agg(F.sum("indegree"), F.sum("outdegree")).first()
    assert total[0] == total[1] == search.edges(toy.vertices(), 9).count()
    q = toy.kmer_colors.sparkSession.createDataFrame([(0, "CGGTCATTG"), (1, "CGGTCATTG"), (2, "AAAAAAAAA"), (3, "NN")], "query_id long, kmer string")
    assert search.branching(search.query_degrees(q, toy.vertices(), 9)).count() == 2


def test_neighbors(spark, toy):
    chosen = spark.createDataFrame([("CGGTCATTG",)], "kmer string")
    there = search.neighbors(chosen, toy.vertices(), 9).where("present")
    assert col(there, "pos", "neighbor") == [(0, "ACGGTCATT"), (5, "GGTCATTGC"), (6, "GGTCATTGG")]
    assert search.predecessors(chosen, toy.vertices(), 9).count() == search.successors(chosen, toy.vertices(), 9).count() == 4


def test_paths(toy):
    assert col(traverse.simple_paths(toy), "path") == ["ACGGTCATT", "CATTGCAAGCTTAC", "CATTGCAATTTCGGA", "GGTCATTGCA", "GGTCATTGGAAGCTTAC"]
    assert col(traverse.simple_paths(toy, 0.67), "path") == ["ACGGTCATT", "GGTCATTGCA"]
    assert col(traverse.simple_paths(toy, 1.0), "path") == ["ACGGTCATT"]


def test_cycles_and_loops(spark):
    ring = "ACGTTGCAGTCC"  # every window of the ring once
    seqs = [("r", ring + ring[:8]), ("loop", "A" * 12)]
    graph = ColoredGraph.from_sequences(spark.createDataFrame(seqs, "genome_name string, seq string"), 9)
    got = col(traverse.simple_paths(graph), "path", "n_kmers")
    least = min((ring + ring)[i : i + 9] for i in range(12))
    at = (ring + ring).index(least)
    assert got == sorted([((ring * 3)[at : at + 20], 12), ("A" * 9, 1)])
    assert len(set(col(traverse.graph_components(graph.vertices(), 9), "component"))) == 2


def test_components_and_levels(spark, toy):
    n = lambda df: len(set(col(traverse.graph_components(df, 9), "component")))
    assert (n(toy.vertices()), n(toy.covering([0, 1])), n(toy.covering([2, 0]))) == (1, 2, 1)
    assert toy.covering([]).count() == 0
    levels = traverse.bfs_levels(toy.vertices(), 9, spark.createDataFrame([("ACGGTCATT",)], "kmer string"))
    assert levels.count() == 28 and levels.agg(F.max("level")).first()[0] == 11


def test_components_against_brute_force(spark):
    import random

    rng = random.Random(3)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(7, i) for i in range(200, 260)]
    vertices = sorted({x for p in pairs for x in p} | {999})
    label = {v: v for v in vertices}
    for _ in vertices:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = traverse.connected_components(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(v,) for v in vertices], "v long"))
    assert {r.v: r.component for r in got.collect()} == label


@pytest.mark.parametrize(
    "seq, canonical, want",
    [
        ("ACGGTCATTGCAAG", False, [{0, 1, 2}, {0, 2}, {0}]), ("ACGGTCATTGCAAG", True, [{0, 2}, {0}, set()]), ("ACGGTCATTGNAAG", False, [{0, 1, 2}, set(), set()]),
        ("ACGGTCATTGNAAG", True, [set()] * 3), ("CTTGCAATGACCGT", False, [set()] * 3), ("CTTGCAATGACCGT", True, [{0, 2}, {0}, set()]), ("ACG", False, [set()] * 3),
        (None, False, [set()] * 3),
    ],
)
def test_containment(spark, toy, seq, canonical, want):
    q = spark.createDataFrame([(0, seq)], "query_id long, seq string")
    got = [{r.genome_id for r in search.sequence_containment(toy, q, t, canonical).collect()} for t in (0.3, 0.5, 1.0)]
    assert got == want


def test_thresholds_and_prefixes_raise(spark, toy):
    q = spark.createDataFrame([(0, "A")], "query_id long, seq string")
    for t in (0, 1.01):
        with pytest.raises(ValueError):
            search.sequence_containment(toy, q, t)
    for p in ("", "ACGTACGTAC", "ACN"):
        with pytest.raises(ValueError):
            g.prefix_match(toy.vertices(), p, 9)
    assert col(g.prefix_match(toy.vertices(), "ttg", 9), "kmer") == ["TTGCAAGCT", "TTGCAATTT", "TTGGAAGCT"]
    assert col(g.prefix_match(toy.vertices(), "ACGG", 9), "kmer") == ["ACGGTCATT"]
    for k in (0, 127):
        with pytest.raises(ValueError):
            g.valid_k(k)
    with pytest.raises(ValueError):
        g.valid_k(10, strict=True)


def test_presence(spark, toy):
    q = spark.createDataFrame([(0, "acggucauu"), (1, "TTTTTTTTT"), (2, "ACX"), (3, "ACGGTCATT")], "query_id long, kmer string")
    m = search.presence_matrix(search.kmer_presence(toy, q), [0, 1, 2])
    assert sorted(map(tuple, m.collect())) == [(0, 1, 1, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 1, 1)]


def test_changes(spark, toy):
    kmers = lambda *x: spark.createDataFrame([(k,) for k in x], "kmer string")
    more = toy.add_genome("g3", kmers("AAAAAAAAA", "aaaaaaaaa")).extend_last_genome(kmers("ACGGTCATT"))
    assert more.n_genomes() == 4 and more.kmer_colors.count() == 38
    assert toy.add_genome("empty", kmers("A").limit(0)).n_genomes() == 4
    with pytest.raises(Exception, match="not a 9-mer"):
        toy.add_genome("bad", kmers("ACG")).kmer_colors.count()
    with pytest.raises(ValueError):
        ColoredGraph.empty(spark, 9).extend_last_genome(kmers("ACGGTCATT"))
    with pytest.raises(ValueError):
        toy.add_colors(kmers("ACGGTCATT"), [7])
    assert toy.add_colors(kmers("ACGGTCATT", "TTTTTTTTT"), [0, 1]).kmer_colors.count() == 38
    assert toy.subset(kmers("ACGGTCATT", "TTTTTTTTT")).kmer_colors.count() == 3
    assert toy.subset(kmers("ACGGTCATT", "TTTTTTTTT"), with_colors=False).kmer_colors.count() == 2
    merged = toy.merge(ColoredGraph.from_sequences(spark.createDataFrame([("g2", TOY[0]), ("g9", TOY[1])], "genome_name string, seq string"), 9))
    assert merged.n_genomes() == 4 and {r.genome_name for r in merged.genomes.collect()} == {"g0", "g1", "g2", "g9"}
    state = g.set_marks(g.with_marks(toy.vertices()), kmers("ACGGTCATT"), 3)
    assert sorted(map(tuple, g.mark_counts(state).collect())) == [(0, 27), (3, 1)]
    with pytest.raises(ValueError):
        g.set_marks(state, kmers("A"), 4)
    dictionary, links = toy.color_dictionary()
    assert dictionary.agg(F.sum("n_kmers")).first()[0] == 28 and links.join(dictionary, "color_id").count() == 28


def test_files_and_command_line(spark, tmp_path):
    paths = []
    for i, s in enumerate(TOY):
        p = tmp_path / f"g{i}.txt"
        p.write_text("\n".join([s[j : j + 9].lower() + " 12" for j in range(12)] + ["ACG", "ACGTNACGT", ""]))
        paths.append(str(p))
    (tmp_path / "list").write_text("\n".join(paths[:2]) + "\n")
    (tmp_path / "more").write_text(paths[2] + "\n")
    queries = tmp_path / "queries.txt"
    queries.write_text("ACGGTCATTGCAAG\r\nTTTTTTTTTTTT\n")
    (tmp_path / "asked").write_text(f"{queries}\n")
    args = ["build", "9", "kmers", str(tmp_path / "list"), str(tmp_path / "graph"), "-add_genomes", "kmers", str(tmp_path / "more"), str(tmp_path / "graph2"),
            "-query_sequences", "0.5", "non_canonical", str(tmp_path / "asked"), "-extract_kmers", "kmers_comp", str(tmp_path / "packed"),
            "-query_branching", "kmers", str(tmp_path / "more"), "-extract_kmers", "kmers", str(tmp_path / "text")]
    said = cli.run(spark, args)
    assert said[0] == said[2] == "28 k-mers" and "1 branching" not in said[1]
    back = ColoredGraph.empty(spark, 9).add_files([str(tmp_path / "packed")], packed=True)
    assert back.kmer_colors.count() == 28
    with pytest.raises(Exception, match="packed for k = 9"):
        ColoredGraph.empty(spark, 18).add_files([str(tmp_path / "packed")], packed=True).kmer_colors.count()
    lines = [r.value for r in spark.read.text(str(tmp_path / "queries.csv")).collect()]
    assert sorted(lines) == ["0,1,0,1", "1,0,0,0", 'query_id,"g0.txt","g1.txt","g2.txt"']
    assert sinks.write_paths(traverse.simple_paths(ColoredGraph.load(spark, str(tmp_path / "graph2"))), str(tmp_path / "paths")) == 17


def test_fasta_in_splits(spark, tmp_path):
    rng = __import__("random").Random(1)
    want, text = [], "\n"
    for i in range(400):
        seq = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 30, 700])))
        want.append((f"s{i}", "a b\x0cc" if i % 3 else None, seq))
        text += f">s{i}" + ("\t a b\x0cc " if i % 3 else "") + "\r\n" * (i % 2) + "\n" * (1 - i % 2) + "\n".join(seq[j : j + 50] for j in range(0, len(seq), 50)) + "\n"
    (tmp_path / "x.fa").write_text(text, newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = readers.fasta(spark, str(tmp_path / "x.fa"))
        assert rows.rdd.getNumPartitions() > 5
        assert sorted(map(tuple, rows.select("name", "comment", "seq").collect())) == sorted(want, key=lambda r: r[0])
        (tmp_path / "lines").write_text("\n".join(f"l{i}" * (i % 7 + 1) for i in range(5000)) + "\n")
        got = [(r.query_id, r.seq) for r in readers.sequences(spark, str(tmp_path / "lines")).collect()]
        assert sorted(got) == [(i, f"l{i}" * (i % 7 + 1)) for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_packed_in_pieces(spark, tmp_path):
    kmers = spark.createDataFrame([("".join("ACGT"[(i >> 2 * j) & 3] for j in range(9)),) for i in range(3000)], "kmer string").repartition(3)
    assert sinks.write_packed(kmers, 9, str(tmp_path / "p q")) == 3000 == sinks.write_packed(kmers, 9, str(tmp_path / "p q"))
    for piece in (1 << 22, 100):
        got = readers.kmer_packed(spark, str(tmp_path / "p q"), 9, piece)
        assert sorted(r.kmer for r in got.collect()) == sorted(r.kmer for r in kmers.collect())
    one = got.where(F.col("path").endswith("part-00000")).orderBy("pos")
    assert [r.pos for r in one.collect()] == list(range(one.count()))
    assert sinks.write_packed(kmers.limit(0), 9, str(tmp_path / "none")) == 0


def test_fastx(spark, tmp_path):
    f = tmp_path / "x.fq"
    f.write_text(">a\tfirst\nACGT\nAC\n@b\nACGT\n+\nII@I\n@c x y\nAC\n+\nI\n")
    got = sorted(map(tuple, readers.fastx(spark, str(f)).select("name", "comment", "seq", "qual").collect()))
    assert got == [("a", "first", "ACGTAC", None), ("b", None, "ACGT", "II@I"), ("c", "x y", "AC", None)]


def test_prefix_pages(toy):
    v, got, last = toy.vertices(), [], None
    while page := [r.kmer for r in g.prefix_page(v, "T", 9, 2, last).collect()]:
        got, last = got + page, page[-1]
    assert got == sorted(col(g.prefix_match(v, "T", 9), "kmer")) and len(got) > 4
    assert all(x > 0 for x in toy.color_bytes().first())


def test_stream_append(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("ACG", 0), ("ACG", 0), ("CGT", 1)], "kmer string, genome_id int").write.parquet(str(src))
    rows = spark.readStream.schema("kmer string, genome_id int").parquet(str(src))
    append_stream(rows, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([("CGT", 1), ("CGT", 2)], "kmer string, genome_id int").write.mode("append").parquet(str(src))
    append_stream(rows, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, stored_pairs(spark, str(tmp_path / "out")).collect())) == [("ACG", 0), ("CGT", 1), ("CGT", 2)]
