import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.operators import compact, traverse
from kmerloom.operators.graph import ColoredGraph


def brute(texts, k):
    """Sorted (path, n_kmers) by walking; a cycle begins at its least k-mer."""
    v = {t[i : i + k] for t in texts for i in range(len(t) - k + 1) if not set(t[i : i + k]) - set("ACGT")}
    after = {x: [x[1:] + c for c in "ACGT" if x[1:] + c in v] for x in v}
    before = {x: [c + x[:-1] for c in "ACGT" if c + x[:-1] in v] for x in v}
    good = {x for x in v if len(after[x]) < 2 and len(before[x]) < 2}
    succ = {x: after[x][0] for x in good if after[x] and after[x][0] in good}
    out, seen = [], set()
    for x in [*sorted(good - set(succ.values())), *sorted(good)]:
        path, n = x, 0
        while x not in seen:
            seen.add(x)
            n, at = n + 1, x
            if at not in succ or succ[at] in seen:
                break
            x = succ[at]
            path += x[-1]
        if n:
            out.append((path, n))
    return sorted(out)


def texts_of(seed, k, n=60):
    """Pieces of one text in which words recur, pieces with other letters, rings and loops."""
    r = random.Random(seed)
    word = lambda m: "".join(r.choice("ACGT") for _ in range(m))
    words = [word(r.randint(k, 3 * k)) for _ in range(8)]
    whole = "".join(r.choice([w, word(2 * k)]) for w in words * 6)
    out = [whole[i : i + r.randint(1, 4 * k)] for i in [r.randrange(len(whole)) for _ in range(n)]]
    ring = word(150)
    return [*out, word(2 * k) + "N" + word(2 * k) + "é" + word(k), ring + ring[: k - 1], (ring := word(6)) * 12, "A" * (k + 5), "C" * k, "", "ACG", word(900), word(k)]


@pytest.mark.parametrize("k", [7, 27, 31])
def test_paths_over_many_buckets(spark, monkeypatch, k):
    monkeypatch.setattr(compact, "BUCKET_BYTES", 300)
    texts = texts_of(k, k)
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "seq string").repartition(3)
    got = sorted(map(tuple, compact.sequence_paths(rows, k).collect()))
    assert got == brute(texts, k)
    assert len(got) > 2


def test_paths_of_projected_texts_and_of_a_graph(spark, monkeypatch):
    monkeypatch.setattr(compact, "BUCKET_BYTES", 300)
    texts = texts_of(5, 9)
    mixed = [("".join(random.Random(i).choice([c.lower(), c + " x", c + "é"]) for c in t),) for i, t in enumerate(texts)]
    bare = ["".join(c for c in t if c in "ACGT") for t in texts]
    rows = spark.createDataFrame(mixed, "seq string")
    assert sorted(map(tuple, compact.sequence_paths(rows, 9, project=True).collect())) == brute(bare, 9)
    graph = ColoredGraph.from_sequences(spark.createDataFrame([("g", t) for t in texts], "genome_name string, seq string"), 9)
    got = traverse.simple_paths(graph)
    assert sorted(map(tuple, got.select("path", "n_kmers").collect())) == brute(texts, 9)
    assert got.where(F.col("head") != F.substring("path", 1, 9)).count() == 0


def test_short_windows_and_no_paths(spark):
    for k, texts in [(2, ["ACG", "TT"]), (3, ["ACGTT", "GGAG", "AAAA"])]:
        assert sorted(map(tuple, compact.sequence_paths(spark.createDataFrame([(t,) for t in texts], "seq string"), k).collect())) == brute(texts, k) != []
    assert compact.sequence_paths(spark.createDataFrame([("ACG",), (None,)], "seq string"), 9).count() == 0


def test_slices_lose_no_window(monkeypatch):
    """A text that is cut into slices gives each window at both its (k-1)-mers."""
    k, texts = 9, texts_of(3, 9)

    def windows():
        held = {}
        for b in compact._spread(k, 5, False)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["seq"])])):
            for place, lengths, letters in zip(*b.to_pydict().values()):
                held.setdefault(place, []).append(compact._windows(lengths, letters, k))
        return {p: np.unique(np.concatenate(x)).tolist() for p, x in held.items()}

    one = windows()
    monkeypatch.setattr(compact, "SLICE", 37)
    assert windows() == one
    sides = {}
    for keys in one.values():
        for x in keys:
            sides[x >> 2] = sides.get(x >> 2, 0) + (x & 3)
    assert set(sides.values()) == {3}
    assert len(sides) == len({t[i : i + k] for t in texts for i in range(len(t) - k + 1) if not set(t[i : i + k]) - set("ACGT")})


def test_rounds_send_nothing_through_the_driver(spark):
    """A round's join used to be broadcast wherever Spark took its input for small, until the driver's memory was full."""
    rows = spark.range(9).select(F.col("id").alias("v"), F.greatest(F.col("id") - 1, F.lit(0)).alias("ptr"), F.lit(1).cast("bigint").alias("dist"), F.col("id").alias("least"), (F.col("id") < 2).alias("done"))
    plan = traverse._doubled(rows.where(~F.col("done")), rows)
    assert plan.count() == 7
    assert "Broadcast" not in plan._jdf.queryExecution().toString()
