import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, against_sql
from pyspark.sql import functions as F

from kmerloom import session
from kmerloom.llm import color_sets, distinct, eliasfano, near_dup, overlap, queries, seen, spans, topk

SQL = [n for n in queries.ORACLES if not n.startswith(("p9", "p10"))]


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    against_sql(spark, name, queries.QUERIES[name], queries.ORACLES[name], DATA / "sf0.001")


def windows(s):
    return {s[i : i + 9] for i in range(len(s) - 8) if set(s[i : i + 9]) <= set("ACGT")}


def edited(rng, s):
    t = list(s)
    for _ in range(rng.randint(0, 5)):
        i = rng.randrange(len(t))
        t[i : i + rng.randint(0, 1)] = rng.choices("ACGT", k=rng.randint(0, 2))
    return "".join(t)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    seqs = {None, "", "ACGT", "ACGTACGTA", "A" * 9, "A" * 40, "AC" * 30, "ACG" * 20, "N" * 50, "ACGTACGTAN"}
    for _ in range(60):
        s = "".join(rng.choices("ACGT", k=rng.choice([9, 10, 12, 20, 45, 100, 150])))
        seqs |= {s, *(edited(rng, s) for _ in range(3)), s[len(s) // 3 :] + s[: len(s) // 3]}
    repeat = "".join(rng.choices("ACGT", k=60))  # a piece that a third of all sequences share
    seqs |= {repeat + "".join(rng.choices("ACGT", k=60)) for _ in range(60)}
    df = spark.createDataFrame([(s, 1) for s in seqs] * 2, "seq string, set_id int")
    numbered = near_dup.number_sequences(df.select("seq"))
    text = {r.set_id: r.seq for r in numbered.collect()}
    assert sorted(text) == list(range(len(text)))
    got = [tuple(sorted((r.a, r.b))) for r in near_dup.similar_pairs(numbered).collect()]
    sets = {i: windows(s) for i, s in text.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_salted_keys_lose_nothing(spark, monkeypatch):
    rng = random.Random(6)
    base = "".join(rng.choices("ACGT", k=120))
    seqs = [edited(rng, base) for _ in range(60)]
    monkeypatch.setattr(near_dup, "SALT_ROWS", 7)
    numbered = near_dup.number_sequences(spark.createDataFrame([(s,) for s in seqs], "seq string"))
    sets = {r.set_id: windows(r.seq) for r in numbered.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert {tuple(sorted((r.a, r.b))) for r in near_dup.similar_pairs(numbered).collect()} == want


@pytest.mark.parametrize("most", [2, 5])
def test_salted_deletions_meet_whole_segments(spark, monkeypatch, most):
    rng, seqs = random.Random(0), set()
    for _ in range(40):  # short sequences at all similarities: few segments, and often one meeting only
        base = "".join(rng.choices("ACGT", k=rng.randint(12, 30)))
        for _ in range(14):
            t = base[rng.randint(0, len(base) // 4) : len(base) - rng.randint(0, len(base) // 4)]
            t += "".join(rng.choices("ACGT", k=rng.randint(0, len(t) // 4)))
            seqs.add(t)
    monkeypatch.setattr(near_dup, "SALT_ROWS", most)
    numbered = near_dup.number_sequences(spark.createDataFrame([(s,) for s in sorted(seqs)], "seq string"))
    sets = {r.set_id: windows(r.seq) for r in numbered.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert {tuple(sorted((r.a, r.b))) for r in near_dup.similar_pairs(numbered).collect()} == want


def test_near_duplicates_of_nothing(spark):
    numbered = near_dup.number_sequences(spark.createDataFrame([], "seq string"))
    assert near_dup.similar_pairs(numbered).count() == 0


def brute_spans(records, length, alphabet=None):
    where = {}
    for i, t in records:
        for p in range(len(t or "") - length + 1):
            if alphabet is None or set(t[p : p + length]) <= set(alphabet):
                where.setdefault(t[p : p + length], set()).add((i, p))
    marked = {}
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            for i, p in places:
                marked.setdefault(i, set()).update(range(p, p + length))
    out = set()
    for i, m in marked.items():
        for p in sorted(m):
            if p - 1 not in m:
                n = 1
                while p + n in m:
                    n += 1
                out.add((i, p, n))
    return out


@pytest.mark.parametrize("length", [1, 5, 24, 48])
def test_spans_against_brute_force(spark, length):
    rng = random.Random(length)
    common = ["".join(rng.choices("ACGTé", k=rng.randint(10, 120))) for _ in range(6)]
    records = [(i, "".join(rng.choice([rng.choice(common), "".join(rng.choices("ACGTN𝔸", k=rng.randint(0, 30)))]) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    records += [(100, None), (101, ""), (102, common[0] * 2), (103, common[0] * 2)]
    df = spark.createDataFrame([(i, t, 0) for i, t in records], "rec_id long, text string, pos int")
    for alphabet in (None, "ACGT"):
        got = [tuple(r) for r in spans.shared_spans(df, length, alphabet).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_spans(records, length, alphabet)
    assert spans.shared_spans(df.limit(0), length).count() == 0


def test_spans_in_many_chunks(spark, monkeypatch):
    """A piece that a third of the records hold, in chunks and partitions of a few places each."""
    monkeypatch.setattr(spans, "PLACES", 50)
    monkeypatch.setattr(spans, "FLUSH", 200)
    monkeypatch.setattr(spans, "PART_LETTERS", 300)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("ACGT", k=n))
    hot = text(40)
    records = [(i, text(rng.randint(0, 30)) + (hot[rng.randint(0, 9) :] if i % 3 == 0 else "") + text(10)) for i in range(90)]
    got = [tuple(r) for r in spans.shared_spans(spark.createDataFrame(records, "rec_id long, text string").repartition(5), 24).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(records, 24) and len(got) >= 30


def test_elias_fano():
    rng = np.random.default_rng(1)
    for bits, n in ((10, 0), (10, 1), (10, 900), (40, 5000), (64, 3000), (58, 1)):
        values = np.unique(rng.integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True))
        ef = eliasfano.EliasFano(values, bits)
        assert (ef.decode() == values).all()
        probes = np.r_[values, rng.integers(0, 2**bits - 1, 2000, dtype=np.uint64, endpoint=True), np.array([0, 2**bits - 1], np.uint64)]
        assert (ef.contains(probes) == np.isin(probes, values)).all()
        if n > 1000:
            assert ef.nbytes() * 8 / len(values) < bits - np.log2(len(values)) + 6
    growing, all_ = eliasfano.SeenSet(30), np.zeros(0, np.uint64)
    for _ in range(12):
        new = np.setdiff1d(np.unique(rng.integers(0, 2**30, 700, dtype=np.uint64)), all_)
        growing.add(new)
        all_ = np.union1d(all_, new)
    assert growing.contains(all_).all() and len(growing.runs) < 8


def test_seen_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([1, None]), rng.choice("abcdefghij") if rng.random() < 0.5 else f"k{rng.randrange(3000)}") for i in range(3000)]
    rows += [(i, 1, "hot") for i in range(3000, 4500)] + rng.choices(rows, k=300) + [(None, 1, "x")]
    rng.shuffle(rows)
    first = {}
    for i, g, k in rows:
        if i is not None:
            first[g, k] = min(first.get((g, k), i), i)
    want = {i for i, g, k in rows if i is not None and i > first[g, k]}
    df = spark.createDataFrame(rows, "id long, g int, k string").repartition(5)
    got = seen.seen_before(df, F.col("id"), F.col("g"), F.col("k"))
    assert {r.id for r in got.where("seen").collect()} == want
    assert {r.id for r in got.collect()} == {i for i, _, _ in rows if i is not None}
    rough = {r.id for r in seen.seen_before(df, F.col("id"), F.col("g"), F.col("k"), bits=16).where("seen").collect()}
    assert rough >= want and len(rough - want) <= 3 * seen.expected_wrong(4500, 3000, 16) + 10
    assert seen.seen_before(df.limit(0), F.col("id"), F.col("k")).count() == 0
    with pytest.raises(ValueError):
        seen.seen_before(df, F.col("id"), F.col("k"), bits=8)


def test_stored_index_goes_on_where_it_stopped(spark, tmp_path):
    """Batch after batch, from a folder that is opened anew, the answers are those of one pass; the rows of earlier batches aren't read."""
    rng = random.Random(12)
    rows = [(i, rng.choice(["hot", None, f"k{rng.randrange(1500)}"])) for i in range(4000)] + [(17, "hot"), (None, "x")]
    df = lambda r: spark.createDataFrame(r, "id long, k string").repartition(3)
    want = {r.id for r in seen.seen_before(df(rows), F.col("id"), F.col("k")).where("seen").collect()}
    seen.SeenIndex.create(spark, str(tmp_path / "i"), 2000)
    got, answered = set(), 0
    for a, b in ((0, 900), (900, 900), (900, 1000), (1000, 4000)):
        part = [r for r in rows if r[0] is not None and a <= r[0] < b]
        out = seen.SeenIndex(spark, str(tmp_path / "i")).append(df(part), F.col("id"), F.col("k"))
        got |= {r.id for r in out.where("seen").collect()}
        answered += out.select("id").distinct().count()
    index = seen.SeenIndex(spark, str(tmp_path / "i"))
    assert got == want and answered == 4000 and index.version == 4
    assert index.n_keys() == len({k for i, k in rows if i is not None})
    assert eliasfano.EliasFano.from_bytes(eliasfano.EliasFano(np.array([3, 9], np.uint64), 20).to_bytes()).decode().tolist() == [3, 9]


def test_runs_that_cross_batches_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(seen, "CHUNK", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, i % 3 if i % 2 else 1000 + i) for i in range(1, 400)] * 2
        df = spark.createDataFrame(rows, "id long, k int")
        got = {r.id for r in seen.seen_before(df, F.col("id"), F.col("k")).where("seen").collect()}
        assert got == set(range(7, 400, 2))  # 1, 3 and 5 are the first of their keys
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_distinct_counts(spark):
    rows = [(g, i % (10 * 4**g)) for g in range(5) for i in range(3000)] + [(None, 1)]
    df = spark.createDataFrame(rows, "g int, h int").repartition(6)
    got = {r.g: r for r in distinct.estimates(distinct.merged(distinct.sketches(df, ["g"], F.col("h")), ["g"])).collect()}
    true = {g: min(3000, 10 * 4**g) for g in range(5)} | {-1: 1}
    assert set(got) == set(true)
    for g, n in true.items():
        assert abs(got[g].estimate / n - 1) < 0.2 and got[g].low < got[g].estimate < got[g].high
    assert sum(got[g].low <= n <= got[g].high for g, n in true.items()) >= 5
    assert distinct.sketches(df.limit(0), ["g"], F.col("h")).count() == 0
    assert distinct.merged(distinct.sketches(df.limit(0), ["g"], F.col("h")), ["g"]).count() == 0


def test_partial_sketches_are_small_and_merge_alike(spark, monkeypatch):
    """However the rows are cut into chunks, the registers are the same; a hot group sends its registers, not its rows."""
    df = spark.createDataFrame([(1, i) for i in range(20000)] + [(2, i % 50) for i in range(5000)], "g int, h int").repartition(2)
    rows = lambda df: {r.g: bytes(r.registers) for r in df.collect()}
    want = rows(distinct.merged(distinct.sketches(df, ["g"], F.col("h"), m=64), ["g"], 64))
    monkeypatch.setattr(distinct, "CHUNK", 3000)
    parts = distinct.sketches(df, ["g"], F.col("h"), m=64)
    size = parts.select(F.sum(F.coalesce(F.octet_length("registers"), F.octet_length("hashes")))).first()[0]
    assert size < 30 * 64 * 8 and parts.where("g = 2 AND hashes IS NULL AND octet_length(registers) <> 512").count() == 0
    assert rows(distinct.merged(parts, ["g"], 64)) == rows(distinct.united(parts, ["g"], 64)) == want
    assert distinct.registers_for(0.045) == 512 and distinct.registers_for(0.01) == 16384
    fine = distinct.estimates(distinct.merged(distinct.sketches(df, ["g"], F.col("h"), m=4096), ["g"], 4096), m=4096).collect()
    assert all(abs(r.estimate / {1: 20000, 2: 50}[r.g] - 1) < 0.08 for r in fine)


def test_union_of_sketches_is_the_sketch_of_the_union():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 900, dtype=np.uint64)
    one = lambda x: distinct.sketch(np.zeros(len(x), np.int64), x, 1)
    assert np.array_equal(np.minimum(one(h[:600]), one(h[300:])), one(np.unique(h)))
    assert np.isclose(distinct.gamma_quantile(0.5), distinct.M - 1 / 3, rtol=1e-4)


def test_top_k_with_ties_nulls_and_few_values(spark):
    values = [b"a"] * 9 + [b"b"] * 5 + [b"c"] * 5 + [b"d"] * 5 + [bytes([x]) for x in range(200, 250)] + [None] * 30
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value binary, row_hash long")
    got = [(bytes(r.value), r.n_rows) for r in topk.most_frequent(df, 3).collect()]
    assert got == [(b"a", 9), (b"b", 5), (b"c", 5)]
    assert topk.most_frequent(df.where("value = X'61'"), 3).count() == 1 and topk.most_frequent(df.limit(0), 3).count() == 0


def test_dictionary_entries(spark):
    df = spark.createDataFrame([(0, 1, b"aabb", 2), (1, 2, b"ccc", 3), (2, 2, None, 3), (3, None, b"x", 1)], "elem_id int, last_index long, annot_array binary, size_annot int")
    assert sorted((r.pos, bytes(r.entry)) for r in color_sets.dictionary_entries(df).collect()) == [(0, b"aa"), (1, b"bb"), (2, b"ccc")]


def test_overlaps(spark):
    rng = random.Random(9)
    rows = [(0, f"{'ACGT'[i % 4]}{i}", rng.sample(range(6), rng.randint(1, 4)) + ([7, 7] if i % 3 == 0 else []), 1) for i in range(900)]
    rows += [(0, rows[i][1].lower(), rows[i][2], 2) for i in range(50)] + [(0, None, [1], 1), (0, "X", None, 1), (0, "Y", [], 1), (0, "A0z", [20, 21], 1)]
    df = spark.createDataFrame(rows, "graph_id int, kmer string, colors array<int>, n int")
    sets = {}
    for _, k, colors, _ in rows:
        for s in (colors or []) if k else []:
            sets.setdefault(s, set()).add(k.upper().replace("U", "T"))
    ids = overlap.identifier_sets(df)
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= min(len(sets[a]), len(sets[b]))}
    for rate in (1.0, 0.5, 0.05):
        assert {tuple(r) for r in overlap.sharing_at_least_half(ids, rate).collect()} == want
    est = {(r.a, r.b): r for r in overlap.estimated_overlaps(ids, 0.5).collect()}
    true = {k: len(sets[k[0]] & sets[k[1]]) for k in est}
    assert sum(r.low <= true[k] <= r.high for k, r in est.items()) >= 0.9 * len(est)
    exact = overlap.estimated_overlaps(ids, 1.0).collect()
    assert all(r.low == r.high == r.estimate == len(sets[r.a] & sets[r.b]) for r in exact)
    assert overlap.sharing_at_least_half(overlap.identifier_sets(df.limit(0)), 1.0).count() == 0


def test_groups_cover_all_reads(spark):
    d = str(DATA / "sf0.001")
    groups = queries.p1_groups(spark, d).cache()
    pairs = queries.p1_found(spark, d)
    g = {r.read_id: r.group_id for r in groups.collect()}
    assert len(g) == groups.count() and all(g[r.read_id_a] == g[r.read_id_b] for r in pairs.collect())
    assert len({*g.values()}) < len(g)


def test_every_record_has_a_share(spark, tmp_path):
    a = "".join(random.Random(8).choices("ACGT", k=60))
    reads_ = [(1, a), (2, a[:50] + "T"), (3, "ACGT"), (4, ""), (5, None)]
    files = [(1, "x" * 30), (2, None), (3, "x" * 30 + "y")]
    stamped = spark.createDataFrame(reads_, "read_id long, read string").selectExpr("*", "1 AS occ_count", "timestamp'2024-01-01' AS loaded_at", "timestamp'2024-01-01' AS seen_at")
    stamped.write.parquet(f"{tmp_path}/read_counts.parquet")
    spark.createDataFrame(files, "genome_id int, filename string").write.parquet(f"{tmp_path}/genomes.parquet")
    got = {(r.rec_kind, r.rec_id): r for r in queries.p2_shared_share(spark, str(tmp_path)).collect()}
    assert set(got) == {*(("read", i) for i, _ in reads_), *(("file", i) for i, _ in files)}
    for k in [("read", 3), ("read", 4), ("read", 5), ("file", 2)]:
        assert (got[k].shared_chars, got[k].n_spans, got[k].share) == (0, 0, 0.0)
    assert sum(r.share > 0 for r in got.values()) >= 3


def test_rows_of_sets_are_bounded_for_any_number_of_partitions():
    """At most 58 bytes a row: a set's sketch travels once a partition that it has rows in, not with all of its bundle."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("ACGT", k=150)) for _ in range(1500)]
    n = np.ones(near_dup.UNIVERSE, np.int64)
    batch = pa.RecordBatch.from_pydict({"set_id": list(range(len(texts))), "seq": texts})
    per_read = {}
    for parts in (8, 128, 3600, 30000):
        got = list(near_dup._rows(n, n, len(texts), np.zeros(near_dup.UNIVERSE, bool), parts)(iter([batch])))
        for b in got:
            b.validate(full=True)
        rows = sum(len(k) // 4 for b in got for k in b.column("keys").to_pylist())
        size = sum(b.column(c).nbytes for b in got for c in b.schema.names)
        assert sum(len(k) for b in got for k in b.column("sketches").to_pylist()) <= 40 * rows
        per_read[parts] = size / len(texts)
    assert per_read[128] < 5 * per_read[8] and per_read[30000] < 1.6 * per_read[3600] < 1.6 * 64 * rows / len(texts)
    print(per_read, rows / len(texts))


@pytest.mark.parametrize("parts", [8, 128, 3600])
def test_rows_of_sets_take_few_bytes(tmp_path, parts):
    """Sketches are written once, whatever the number of partitions, and a segment's keys travel as one row (1.4 to 9.5 KB a read before)."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("ACGT", k=150)) for _ in range(4000)]
    n = np.ones(near_dup.UNIVERSE, np.int64)
    batch = pa.RecordBatch.from_pydict({"set_id": list(range(len(texts))), "seq": texts})
    got = list(near_dup._rows(n, n, len(texts), np.zeros(near_dup.UNIVERSE, bool), parts, str(tmp_path))(iter([batch])))
    size = sum(len(x) for b in got for c in ("keys", "roles", "ids", "sizes", "sketches") for x in b.column(c).to_pylist())
    assert size + sum(p.stat().st_size for p in tmp_path.iterdir()) < 360 * len(texts)
    size, sketch = near_dup._sketches_of(np.array([3, 70, 3999]), str(tmp_path))
    assert (sketch == near_dup.Sets([texts[i] for i in (3, 70, 3999)], near_dup.segment_table()).sketches()).all() and (size > 130).all()


def test_sketches_travel_where_the_folder_cannot_be_opened(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "_shared_folder", lambda spark: None)
    test_near_duplicates_against_brute_force(spark)


def test_interim_tables_are_deleted(spark, tmp_path, monkeypatch):
    """Of its shared files p1 leaves those that its result is read from."""
    monkeypatch.setattr(near_dup, "checkpoint_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(session, "checkpoint_dir", lambda spark: str(tmp_path))
    assert queries.p1_found(spark, str(DATA / "sf0.001")).count() > 0
    assert len(list(tmp_path.iterdir())) == 2 and not [p for p in tmp_path.iterdir() if "sketches" in p.name]


def test_segments_as_32_bits():
    codes, windows, segments = near_dup.code_table().astype(np.int64), near_dup.window_table(), near_dup.segment_table().astype(np.int64)
    assert (windows[segments << 6 | codes] == np.arange(near_dup.UNIVERSE)).all()
    rng = random.Random(4)
    for word in rng.sample(range(4**7), 200):
        mine = codes[segments == word].tolist()
        for z in range(1, min(3, len(mine)) + 1):
            a = rng.sample(mine, z)
            w, got = near_dup._segment_windows(near_dup._segment_key(*(np.array([x]) for x in (word, z, a[0], a[min(1, z - 1)], a[-1]))))
            assert w[0] == word and [int(x[0]) for x in got[:z]] == sorted(a) and len({int(x[0]) for x in got}) == z
