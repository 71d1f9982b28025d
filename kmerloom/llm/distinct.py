"""Distinct counts by sketches of minimum exponential values.

Each of m registers holds the least of independent Exp(1) values that the distinct identifiers of a set
draw from their hash. Registers of a union are the elementwise minimum, and their sum S is
Gamma(m)-distributed with rate n: (m - 1) / S is unbiased for n with relative standard error
1 / sqrt(m - 2), and quantiles of the gamma distribution give the confidence interval.

An identifier draws its m values in ascending order (exponential spacings, registers in a hashed
permutation) and stops at the largest register, so that nearly all identifiers of a large set stop
after a draw or two.

Sketches are made where the rows are read, in tables of bounded size: a group's state is the list of its
distinct hashes while that is shorter than its registers would be, and the registers from then on. Only these
states are shuffled, so a group that holds a third of all rows costs its registers once a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M = 512  # registers by default
CHUNK = 1 << 19  # rows that a table takes before it hands its states on
_G = 0x9E3779B97F4A7C15


def registers_for(error: float) -> int:
    """The least power of two whose sketches have at most that relative standard error."""
    return 1 << max(4, math.ceil(math.log2(2 + 1 / error**2)))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _register(seed: np.ndarray, j: int, m: int) -> np.ndarray:
    """The j-th register of an identifier's permutation of all m: odd multipliers and shifts are bijections."""
    mask = np.uint64(m - 1)
    p = ((seed | np.uint64(1)) * np.uint64(j) + (seed >> np.uint64(12))) & mask
    p ^= p >> np.uint64(4)
    p = (p * ((seed >> np.uint64(24)) | np.uint64(1)) + (seed >> np.uint64(36))) & mask
    return (p ^ (p >> np.uint64(5))).astype(np.int64)


def _draw(registers: np.ndarray, group: np.ndarray, hashes: np.ndarray) -> None:
    """Minimises the groups' registers with the draws of their identifiers, as one wave."""
    most = registers.max(axis=1)
    seed = _mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    total, at, h = np.zeros(len(hashes)), group, hashes
    m = registers.shape[1]
    for j in range(m):
        u = (_mix(h + np.uint64(_G * (j + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        total = total - np.log1p(-u) / (m - j)
        live = total < most[at]
        if not live.all():
            total, at, h, seed = total[live], at[live], h[live], seed[live]
            if not len(h):
                return
        np.minimum.at(registers, (at, _register(seed, j, m)), total)


def sketch(group: np.ndarray, hashes: np.ndarray, n_groups: int, m: int = M) -> np.ndarray:
    """Registers (n_groups x m) of the identifiers; ``group`` ascending. Waves of growing size keep the bound tight."""
    registers = np.full((n_groups, m), np.inf)
    starts = np.searchsorted(group, np.arange(n_groups))
    rank = np.arange(len(group)) - starts[group]
    lo, hi = 0, 8
    top = int(rank.max(initial=-1))
    while lo <= top:
        wave = (rank >= lo) & (rank < hi)
        _draw(registers, group[wave], hashes[wave])
        lo, hi = hi, hi * 2
    return registers


def _runs(cols: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal rows."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _schema(keys: list[str]) -> str:
    return ", ".join(f"{k} BIGINT" for k in keys) + ", registers BINARY, hashes BINARY"


def _states(keys: list[np.ndarray], registers: list[bytes | None], hashes: list[bytes | None], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(registers, pa.binary()), pa.array(hashes, pa.binary())], names=[*names, "registers", "hashes"])


def _build(names: list[str], m: int):
    """States of the groups of each chunk of rows."""

    def states(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        cols = [t.column(n).to_numpy() for n in (*names, "h")]
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        new = _runs(cols)  # repeated identifiers of a group go first
        cols, h = [c[new] for c in cols[:-1]], cols[-1][new].view(np.uint64)
        starts = _runs(cols)
        size = np.diff(np.r_[starts, len(h)])
        dense = np.flatnonzero(size > m // 2)  # from here on registers are shorter than hashes in practice, and cheaper to merge
        registers, hashes = [None] * len(starts), [None] * len(starts)
        if len(dense):
            take = np.repeat(size > m // 2, size)
            for g, r in zip(dense, sketch(np.repeat(np.arange(len(dense)), size[dense]), h[take], len(dense), m)):
                registers[g] = r.tobytes()
        for g in np.flatnonzero(size <= m // 2):
            hashes[g] = h[starts[g] : starts[g] + size[g]].tobytes()
        return _states([c[starts] for c in cols], registers, hashes, names)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in stream:
            held.append(b)
            rows += b.num_rows
            if rows >= CHUNK:
                yield states(held)
                held, rows = [], 0
        if rows:
            yield states(held)

    return run


def _merge(names: list[str], m: int):
    """Streams states sorted by ``names``; one state of registers a group comes out."""

    def fold(b: pa.RecordBatch, starts: np.ndarray) -> np.ndarray:
        out = np.full((len(starts), m), np.inf)
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, b.num_rows]))
        at = np.flatnonzero(b.column("registers").is_valid().to_numpy(zero_copy_only=False))
        if len(at):
            rows = np.frombuffer(b"".join(b.column("registers").drop_null().to_pylist()), np.float64).reshape(-1, m)
            first = _runs([group[at]])
            out[group[at][first]] = np.minimum.reduceat(rows, first, axis=0)
        listed = b.column("hashes")
        at = np.flatnonzero(listed.is_valid().to_numpy(zero_copy_only=False))
        if len(at):
            texts = listed.drop_null().to_pylist()
            h, of = np.frombuffer(b"".join(texts), np.uint64), np.repeat(group[at], [len(t) // 8 for t in texts])
            out = np.minimum(out, sketch(of, h, len(starts), m))
        return out

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carried = None, None
        for b in stream:
            if not b.num_rows:
                continue
            cols = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
            starts = _runs(cols)
            keys, rows = [c[starts] for c in cols], fold(b, starts)
            if key is not None:
                if key == [int(k[0]) for k in keys]:
                    rows[0] = np.minimum(rows[0], carried)
                else:
                    yield _states([np.array([k]) for k in key], [carried.tobytes()], [None], names)
            if len(starts) > 1:
                yield _states([k[:-1] for k in keys], [r.tobytes() for r in rows[:-1]], [None] * (len(starts) - 1), names)
            key, carried = [int(k[-1]) for k in keys], rows[-1].copy()
        if key is not None:
            yield _states([np.array([k]) for k in key], [carried.tobytes()], [None], names)

    return run


def _typed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(k).cast("bigint"), F.lit(-1).cast("bigint")).alias(k) for k in keys], *[c for c in df.columns if c not in keys])


def sketches(items: DataFrame, keys: list[str], *ident: Column, m: int = M) -> DataFrame:
    """(keys..., registers, hashes): mergeable partial sketches of the distinct identifiers per combination of keys.

    Keys must cast to non-negative whole numbers; nulls become -1. Nothing is shuffled: a combination has a
    state (registers, or the hashes while they are few) per chunk of rows that holds it. Repeated identifiers
    change nothing; rows with a null identifier part count that null as a value. An empty table gives no rows.
    ``m``, a power of two, sets the error (:func:`registers_for`); states of different m don't mix.
    """
    rows = _typed(items.select(*keys, F.xxhash64(*ident).alias("h")), keys)
    return rows.mapInArrow(_build(keys, m), _schema(keys))


def merged(parts: DataFrame, keys: list[str], m: int = M) -> DataFrame:
    """One state of registers per combination of ``keys``; the states of ``parts`` are what is shuffled."""
    states = _typed(parts, keys).select(*keys, "registers", "hashes")
    return states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge(keys, m), _schema(keys))


def united(parts: DataFrame, keys: list[str], m: int = M) -> DataFrame:
    """:func:`merged` of few groups of many states each: merged within tasks first, so that one state a task and group is shuffled."""
    states = _typed(parts, keys).select(*keys, "registers", "hashes")
    return merged(states.sortWithinPartitions(*keys).mapInArrow(_merge(keys, m), _schema(keys)), keys, m)


def gamma_quantile(p: float, m: int = M) -> float:
    """Quantile of the Gamma(m, 1) distribution (Wilson and Hilferty's cube; error below 1e-4 for m >= 100)."""
    z = NormalDist().inv_cdf(p)
    return m * (1 - 1 / (9 * m) + z / (3 * m**0.5)) ** 3


def estimates(sketched: DataFrame, confidence: float = 0.95, m: int = M) -> DataFrame:
    """Replaces the state of merged sketches by estimate, low and high (confidence interval of the distinct count)."""
    lo, hi = gamma_quantile((1 - confidence) / 2, m), gamma_quantile((1 + confidence) / 2, m)

    @F.pandas_udf("double")
    def total(r):
        import numpy as np

        return r.map(lambda x: float(np.frombuffer(x, np.float64).sum()))

    keys = [c for c in sketched.columns if c not in ("registers", "hashes")]
    s = F.col("s")
    return sketched.withColumn("s", total("registers")).select(
        *keys, ((m - 1) / s).alias("estimate"), (lo / s).alias("low"), (hi / s).alias("high")
    )
