import random

from pyspark.sql import functions as F

from kmerloom.functions import codec, colors


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_packing_goldens(spark):
    r = one(
        spark, a=F.hex(codec.pack_bytes(F.lit("ACTTGTCTG"), 9)), b=F.hex(codec.pack_bytes(F.lit("ACGGTCATT"), 9)),
        i=codec.pack_int(F.lit("ACTTGTCTG" * 3)), u=codec.unpack_bytes(F.unhex(F.lit("F4DE02")), 9),
    )
    assert (r.a, r.b, r.i, r.u) == ("F4DE02", "A4C703", 2231879679377118, "ACTTGTCTG")


def test_round_trips(spark):
    rng = random.Random(1)
    for k in (9, 18, 27, 36, 126):
        kmers = ["".join(rng.choices("ACGT", k=k)) for _ in range(20)]
        df = spark.createDataFrame([(x,) for x in kmers], "k string")
        c = F.col("k")
        rc = codec.reverse_complement
        assert df.where(codec.unpack_bytes(codec.pack_bytes(c, k), k) != c).count() == 0
        assert df.where(rc(rc(c)) != c).count() == 0
        assert df.where(codec.canonical(c) != codec.canonical(rc(c))).count() == 0
        if k <= 27:
            assert df.where(codec.unpack_int(codec.pack_int(c), k) != c).count() == 0


def test_windows_of_odd_texts(spark):
    texts = [None, "", "ACGTACGT", "ACGTACGTA", "acgtacgua", "ACGTNACGTACGTA", "A" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    n = {r.i: (r.n, r.w) for r in df.select("i", F.size(codec.kmers(F.col("s"), 9)).alias("n"), codec.n_windows(F.col("s"), 9).alias("w")).collect()}
    assert [n[i] for i in range(7)] == [(0, 0), (0, 0), (0, 0), (1, 1), (1, 1), (6, 6), (22, 22)]


def test_ambiguity_letters_and_mismatches(spark):
    r = one(
        spark, p=codec.unpack_ambiguous(codec.pack_ambiguous(F.lit("acg.TN-rB"))), a=codec.has_ambiguity(F.lit("ACGNT")), b=codec.has_ambiguity(F.lit("ACGU")),
        last=codec.last_non_base(F.lit("ACXGT")), none=codec.last_non_base(F.lit("ACGT")), sw=codec.swap_nibbles(F.lit("ABC")),
        h=codec.hamming(F.lit("ACGT"), F.lit("AGGA")), h2=codec.hamming(F.lit("ACGT"), F.lit("AGGA"), 1), h3=codec.hamming(F.lit("A"), F.lit("AC")),
    )
    assert r.p == "ACGNTNNRB" and r.a and not r.b and r.last == 2 and r.none == -1 and r.sw == "BA0C"
    assert (r.h, r.h2, r.h3) == (2, -1, -1)


def test_minimizer(spark):
    def brute(s, m):
        rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        words = [t[i : i + m] for t in (s, rc) for i in range(len(t) - m + 1)]
        good = [w for w in words if set(w) <= set("ACGT") and not any(3 * b in w for b in "ACGT")]
        return min(good, default=None)

    rng = random.Random(2)
    texts = ["".join(rng.choices("ACGTN", k=rng.randint(0, 40))) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").withColumn("m", codec.minimizer(F.col("s"), 5))
    assert {r.i: r.m for r in df.collect()} == {i: brute(t, 5) for i, t in enumerate(texts)}


def test_color_algebra(spark):
    a, b, c = (F.array(*map(F.lit, x)) for x in ([5, 1, 3, 3], [3, 1, 9], [1, 7]))
    null = F.lit(None).cast("array<int>")
    r = one(
        spark, i=colors.intersection(a, b, c), i1=colors.intersection(a), i0=colors.intersection(), u=colors.union(a, b, c), x1=colors.symmetric_difference(a),
        x2=colors.symmetric_difference(a, b), x3=colors.symmetric_difference(a, b, c), n=colors.count_colors(a), last=colors.last_color(a), has=colors.has_color(a, 3, 4),
        hasnot=colors.has_color(a, 5, 4), cov=colors.covers(a, [3, 1]), none=colors.covers(a, []), k=colors.intersection_count(a, b, 0), un=colors.union(a, null), n0=colors.count_colors(null),
    )
    assert (r.i, r.i1, r.i0, r.u) == ([1], [1, 3, 5], [], [1, 3, 5, 7, 9])
    assert (r.x1, r.x2, r.x3) == ([1, 3, 5], [5, 9], [3, 5, 7, 9])  # of three: union without the intersection, not parity
    assert (r.n, r.last, r.has, r.hasnot, r.cov, r.none, r.k, r.un, r.n0) == (3, 5, True, False, True, False, 1, [1, 3, 5], 0)


def test_annotation_encodings(spark):
    def groups(n, first, more):
        parts = [n & 63]
        while n := n >> 6:
            parts.append(n & 63)
        parts.reverse()
        return [parts[0] << 2 | first] + [p << 2 | more for p in parts[1:]]

    bitmap = bytearray(3)
    for i in (0, 5, 14):
        bitmap[(i + 2) // 8] |= 1 << (i + 2) % 8
    runs = bytes(sum((groups(n, 1, 2) for n in (3, 6, 100, 102)), []))
    ids = bytes(sum((groups(n, 2, 1) for n in (4, 145, 70000)), []))
    df = spark.createDataFrame([(1, bytes(bitmap)), (2, runs), (3, ids), (4, None), (5, b"")], "i int, a binary").withColumn("ids", colors.decode(F.col("a")))
    assert {r.i: r.ids for r in df.collect()} == {1: [0, 5, 14], 2: [3, 4, 5, 6, 100, 101, 102], 3: [4, 145, 70000], 4: None, 5: None}


def test_color_encodings(spark):
    """Every encoding decodes to its set, and the shortest is taken; sets of all shapes and very large ids."""
    import random

    from kmerloom.functions import colors

    rng = random.Random(4)
    sets = [[], None, [0], [5, 6, 7], [63], [64], [4095, 4096], [2**30 - 1], list(range(40, 400)), [0, 2, 4, 6, 8, 10], [7, 7, 3, None]]
    sets += [sorted(rng.sample(range(10 ** rng.randint(1, 6)), rng.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(s,) for s in sets], "s array<int>")
    one = colors.color_list(F.col("s"))
    small = F.coalesce(F.array_max("s"), F.lit(0)) < 10**5  # a bitmap of a very large id is long
    got = df.select(one.alias("s"), colors.decode(colors.encode(F.col("s"))).alias("back"), F.hex(colors.encode(F.col("s"))).alias("e"),
                    F.when(small & (F.size(one) > 0), F.array(*colors.encodings(one))).alias("all")).collect()
    for r in got:
        assert (r.back or []) == r.s
        if r.all:
            assert len(r.e) == min(map(len, r.all)) and r.e in r.all
    every = df.where(small & (F.size(one) > 0)).select(one.alias("s"), F.transform(F.array(*colors.encodings(one)), lambda x: colors.decode(F.unhex(x))).alias("b"))
    assert all(b == r.s for r in every.collect() for b in r.b)


def test_reversed_bits(spark):
    df = spark.createDataFrame([(0,), (1,), (6,), (2**61,), (None,)], "n long")
    assert [r[0] for r in df.select(codec.reverse_bits(F.col("n"), 62)).collect()] == [0, 2**61, 3 << 59, 1, None]
