"""Queries over whole graphs against brute force on a small one."""

import random

import pytest

from kmerloom.plans.graph_queries import QUERIES


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """(folder, k -> k-mers by genome, item -> text): eleven sources, every item from one or two of them."""
    rng, d = random.Random(11), tmp_path_factory.mktemp("whole")
    texts = ["".join(rng.choices("ACGT", k=70)) for _ in range(11)]
    texts[10] = texts[10][:30] + texts[0][:40]  # a branch
    texts[9] = texts[9][:35] + texts[1][35:]
    docs = [(f"s{i:02}", "en", t) for i, t in enumerate(texts)]
    items = [(i, t[5:60]) for i, t in enumerate(texts)] + [(11, "ACGT"), (12, "".join(rng.choices("ACGT", k=60)))]
    spark.createDataFrame(docs, "source string, lang string, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return str(d), lambda k: [windows(t, k) for t in texts], dict(items)


def windows(text, k):
    return {text[i : i + k] for i in range(len(text) - k + 1)}


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_matrices_have_every_genome(spark, small):
    d, genomes, items = small
    has = genomes(18)
    want = [(q, p, ",".join(str(int(t[p : p + 18] in g)) for g in has)) for q, t in items.items() for p in range(len(t) - 17)]
    assert rows(QUERIES["kmer_presence_matrix"](spark, d)) == sorted(want)
    assert any(w[2].endswith("1,0") and "1" not in w[2][:16] for w in want)
    has = genomes(9)
    share = lambda t, g: t[:9] != t and 2 * sum(t[p : p + 9] in g for p in range(len(t) - 8)) >= len(t) - 8
    assert rows(QUERIES["sequence_matrix"](spark, d)) == sorted((q, ",".join(str(int(share(t, g))) for g in has)) for q, t in items.items())


def test_every_kmer_has_its_neighbors(spark, small):
    d, genomes, _ = small
    v = set().union(*genomes(27))
    around = lambda x: [*(b + x[:-1] for b in "ACGT"), *(x[1:] + b for b in "ACGT")]
    want = sorted((x, pos, y, y in v) for x in v for pos, y in enumerate(around(x)))
    assert rows(QUERIES["neighbors"](spark, d)) == want
    assert rows(QUERIES["predecessors"](spark, d)) == [w for w in want if w[1] < 4]
    assert rows(QUERIES["successors"](spark, d)) == [w for w in want if w[1] >= 4]
    assert len(want) == 8 * len(v) and any(w[3] for w in want)


def test_levels_go_to_the_end(spark, small):
    d, genomes, _ = small
    v = set().union(*genomes(27))
    after = lambda x: [x[1:] + b for b in "ACGT" if x[1:] + b in v]
    before = lambda x: [b + x[:-1] for b in "ACGT" if b + x[:-1] in v]
    front = {x for x in v if len(after(x)) > 1 or len(before(x)) > 1}
    seen, want = set(), []
    while front:
        want.append((len(want), len(front)))
        seen |= front
        front = {y for x in front for y in after(x) + before(x)} - seen
    assert rows(QUERIES["bfs_levels"](spark, d)) == want and len(want) > 5


def test_components_of_the_whole_graph(spark, small):
    d, genomes, _ = small
    v = set().union(*genomes(27))
    label = {x: x for x in v}
    find = lambda x: x if label[x] == x else find(label[x])
    for x in v:
        for y in (x[1:] + b for b in "ACGT"):
            if y in v and find(x) != find(y):
                a, b = sorted((find(x), find(y)))
                label[b] = a
    assert rows(QUERIES["components"](spark, d)) == sorted((x, find(x)) for x in v)
    sizes = [sum(find(x) == r for x in v) for r in {find(x) for x in v}]
    assert rows(QUERIES["component_count"](spark, d)) == [(len(sizes), max(sizes), len(v))] and len(sizes) > 3


@pytest.mark.parametrize("k", [5, 33])
def test_levels_of_any_seeds(spark, k):
    """Seeds within chains, on rings and at loops, most steps given or not; as text and as numbers."""
    from kmerloom.operators import traverse

    rng = random.Random(k)
    texts = ["".join(rng.choices("ACGT", k=60 if k == 5 else 120)) for _ in range(3)] + ["A" * (k + 3), "ACGTTGCATC" * 9]
    texts.append(texts[0][:50] + texts[1][20:])
    v = sorted(set().union(*(windows(t, k) for t in texts)))
    near = {x: {y for b in "ACGT" for y in (x[1:] + b, b + x[:-1]) if y in set(v) and y != x} for x in v}
    V = spark.createDataFrame([(x,) for x in v], "kmer string")
    for seeds in ([], [texts[2][3 : 3 + k], texts[4][:k], *rng.sample(v, 4)]) if k == 5 else ([texts[2][3 : 3 + k], texts[4][:k]],):
        want, front = {}, set(seeds)
        while front:
            want |= {x: len({*want.values()}) for x in front}
            front = {y for x in front for y in near[x]} - want.keys()
        got = traverse.bfs_levels(V, k, spark.createDataFrame([(x,) for x in seeds], "kmer string"))
        assert {r.kmer: r.level for r in got.collect()} == want
    assert {r.kmer for r in traverse.bfs_levels(V, k, V.limit(1), 1).collect()} <= set(v)


@pytest.mark.parametrize("k, chunk", [(9, 7), (33, 50)])
def test_components_of_contracted_chunks(spark, monkeypatch, k, chunk):
    from kmerloom.operators import traverse

    monkeypatch.setattr(traverse, "LOCAL_EDGES", chunk)
    rng = random.Random(chunk)
    texts = ["".join(rng.choices("ACGT", k=rng.randint(k, 150))) for _ in range(9)] + ["A" * (k + 4), "ACGTTGCATC" * 9]
    texts += [texts[0][-k:] + texts[1][:40], texts[3][20 : 20 + k] + texts[4][-k:]]
    v = set().union(*(windows(t, k) for t in texts))
    label = {x: x for x in v}
    for _ in v:
        before = dict(label)
        for x in v:
            for y in (x[1:] + b for b in "ACGT"):
                if y in v:
                    label[x] = label[y] = min(label[x], label[y])
        if label == before:
            break
    got = traverse.graph_components(spark.createDataFrame([(x,) for x in v] * 2, "kmer string"), k)
    assert {r.kmer: r.component for r in got.collect()} == label and got.count() == len(v)
