"""Whether a record's key occurred at an earlier record, among billions of keys in bounded memory.

Keys are hashed to ``bits`` bits. The top bits choose a hash partition, which is held by one task at a
time as Elias-Fano runs of the remaining bits (about 64 - log2(keys of the partition) + 2 bits a key).
Arrivals come in batches of consecutive order numbers; each batch's keys are probed by successor
search and the new ones merged into the runs, batch after batch within a partition.

A key that holds a third of all rows never reaches one task as such: rows are first combined where they
are read, and of the rows of one key in a chunk only the earliest travels on - the later ones are known
to be seen.

:class:`SeenIndex` keeps the runs in a folder, one a partition: a later batch reads them, not the earlier rows.

Two different keys with one hash make the later one a false "seen"; there are no false "new". Of m
probes against n keys at most about m * n / 2**bits are wrong (:func:`expected_wrong`); of n distinct keys
that arrive one by one, half of n**2 / 2**bits, as only a first occurrence can be answered wrongly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .eliasfano import EliasFano, SeenSet

BATCHES = 16
PART_ROWS = 1 << 17
CHUNK = 1 << 18
_SCHEMA = "id BIGINT, part INT, batch INT, rest BIGINT, known BOOLEAN"


def _combine(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and (part, batch, rest) the earliest row; the other rows are marked as known to be seen."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        id_, part, batch, rest = (t.column(c).to_numpy() for c in ("id", "part", "batch", "rest"))
        order = np.lexsort((id_, rest, batch, part))
        id_, part, batch, rest = id_[order], part[order], batch[order], rest[order]
        first = np.ones(len(id_), bool)
        first[1:] = (part[1:] != part[:-1]) | (batch[1:] != batch[:-1]) | (rest[1:] != rest[:-1])
        least = id_[np.maximum.accumulate(np.where(first, np.arange(len(id_)), 0))]
        keep = first | (id_ != least)  # a row delivered twice isn't its own forerunner
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (id_, part, batch, rest, ~first)], names=["id", "part", "batch", "rest", "known"])

    for b in stream:
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def _decide(universe_bits: int, keep: bool = False):
    """Rows in the order part, known, batch, rest, id: says of each whether its key came before.

    A row with a ``run`` (batch -1) brings the keys that a partition holds already. With ``keep`` the keys that
    each partition holds in the end come out as one run, in rows without an id.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, new, last, least = None, SeenSet(universe_bits), [], None, None
        ended: list[tuple[int, bytes]] = []

        def end() -> None:
            if at is not None and keep:
                seen.add(np.concatenate(new) if new else np.zeros(0, np.uint64))
                ended.append((at[0], seen.whole().to_bytes()))

        def rows(ids: np.ndarray, answers: np.ndarray) -> pa.RecordBatch:
            n, m = len(ids), len(ended)
            out = pa.RecordBatch.from_arrays(
                [pa.array([*ids.tolist(), *[None] * m], pa.int64()) if m else pa.array(ids), pa.array([*answers.tolist(), *[None] * m], pa.bool_()) if m else pa.array(answers),
                 pa.array([None] * n + [p for p, _ in ended], pa.int32()), pa.array([None] * n + [r for _, r in ended], pa.binary())],
                names=["id", "seen", "part", "run"],
            )
            ended.clear()
            return out

        for b in stream:
            part, batch, known = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "batch", "known"))
            id_ = b.column("id").fill_null(0).to_numpy()
            rest = b.column("rest").to_numpy().astype(np.uint64)
            answer, stored = known.copy(), batch < 0
            unit = part.astype(np.int64) << 32 | (batch.astype(np.int64) + 1) << 1 | known
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(unit)]):
                if known[s]:
                    continue
                if at != (here := (int(part[s]), int(batch[s]))):
                    if at is not None and at[0] == here[0]:
                        seen.add(np.concatenate(new) if new else np.zeros(0, np.uint64))
                    else:
                        end()
                        seen = SeenSet(universe_bits)
                    at, new, last, least = here, [], None, None
                if stored[s]:
                    seen.runs += [EliasFano.from_bytes(r) for r in b.column("run").slice(s, e - s).to_pylist()]
                    continue
                r, i = rest[s:e], id_[s:e]
                first = np.r_[last is None or r[0] != last, r[1:] != r[:-1]]
                heads = np.flatnonzero(first)
                before = seen.contains(r[heads])
                new.append(r[heads[~before]])
                run_of = np.cumsum(first) - 1  # -1: goes on with the run of the last chunk
                mins = i[heads]
                seen_head = before
                if not first[0]:
                    mins, seen_head, run_of = np.r_[least[0], mins], np.r_[least[1], before], run_of + 1
                answer[s:e] = seen_head[run_of] | (i > mins[run_of])
                last, least = r[-1], (mins[-1], bool(seen_head[-1]))
            yield rows(id_[~stored], answer[~stored])
        end()
        if ended:
            yield rows(np.zeros(0, np.int64), np.zeros(0, bool))

    return run


def expected_wrong(n_probes: int, n_keys: int, bits: int) -> float:
    """Upper bound of the expected number of false answers."""
    return n_probes * n_keys / 2.0**bits


def _checked(bits: int) -> int:
    if not 16 <= bits <= 64:
        raise ValueError("bits must be from 16 to 64")
    return bits


def _extent(ids: DataFrame) -> tuple[int, int, int]:
    n, low, high = ids.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    return n, low or 0, high or 0


def _answers(ids: DataFrame, extent: tuple[int, int, int], top: int, bits: int, runs: DataFrame | None = None) -> DataFrame:
    """(id, seen, part, run) of ``ids(id, h)``; ``runs(part, run)`` are the keys of earlier batches and, if given, come out with the new ones in them."""
    _, low, high = extent
    span = (high - low) // BATCHES + 1
    batch = F.greatest(F.floor((F.col("id") - F.lit(low)) / F.lit(span)), F.lit(0))
    parted = ids.select(
        "id", F.shiftrightunsigned("h", 64 - top).cast("int").alias("part"), batch.cast("int").alias("batch"),
        F.shiftrightunsigned(F.shiftleft("h", top), top + 64 - bits).alias("rest"),
    )
    combined = parted.mapInArrow(_combine, _SCHEMA)
    # rows that are known to be seen need no partition's memory: they go wherever there is room
    route = F.when(F.col("known"), F.pmod(F.xxhash64("id"), F.lit(1 << top)).cast("int")).otherwise(F.col("part"))
    rows = combined.withColumn("part", route).withColumn("run", F.lit(None).cast("binary"))
    if runs is not None:
        held = runs.select(F.lit(None).cast("bigint").alias("id"), "part", F.lit(-1).alias("batch"), F.lit(0).cast("bigint").alias("rest"), F.lit(False).alias("known"), "run")
        rows = rows.unionByName(held)
    placed = rows.repartition("part").sortWithinPartitions("part", "known", "batch", "rest", "id")
    return placed.mapInArrow(_decide(bits - top, runs is not None), "id BIGINT, seen BOOLEAN, part INT, run BINARY")


def _hashed(rows: DataFrame, order: Column, key: tuple[Column, ...]) -> DataFrame:
    return rows.where(order.isNotNull()).select(order.cast("bigint").alias("id"), F.xxhash64(*key).alias("h"))


def _top(keys: int, bits: int) -> int:
    return min(max(6, math.ceil(math.log2(max(1, keys) / PART_ROWS))), bits - 8)


def seen_before(rows: DataFrame, order: Column, *key: Column, bits: int = 64, sizes: DataFrame | None = None) -> DataFrame:
    """(id, seen): for each row whether a row with the same key has a smaller ``order`` number.

    ``order``: whole numbers >= 0; rows without one are left out. Rows with the same number count as one
    record and may come out once or more often. Null parts of a key compare equal. An empty table gives
    no rows. ``bits`` (16 ... 64) sets the size of the remembered hashes and with it the rate of false
    "seen" answers; the batches and partitions depend on the number of rows only. ``sizes(id)`` may give rows
    that are cheaper to count, of about as many numbers (the table before it is filtered, say).
    """
    bits, ids = _checked(bits), _hashed(rows, order, key)
    extent = _extent(ids if sizes is None else sizes)
    return _answers(ids, extent, _top(extent[0], bits), bits).select("id", "seen")


class SeenIndex:
    """The keys of all batches so far, in a shared folder: one Elias-Fano run a hash partition, some log2(2**bits / keys) + 2 bits a key.

    Each :meth:`append` answers for a batch, whose order numbers must follow those of earlier batches, and merges
    its keys into the runs: it reads the runs and the batch, never the earlier rows. A version is written next
    to the one before and named last, so a failed append changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        """Opens the index in ``folder``."""
        self.spark, self.folder = spark, folder
        last = spark.read.parquet(f"{folder}/versions").orderBy(F.desc("version")).first()
        self.version, self.bits, self.top = last.version, last.bits, last.top

    @classmethod
    def create(cls, spark: SparkSession, folder: str, keys: int, bits: int = 64) -> SeenIndex:
        """An empty index for about ``keys`` keys (their number sets the number of partitions, no more)."""
        top = _top(keys, _checked(bits))
        spark.createDataFrame([], "part INT, run BINARY").write.mode("overwrite").parquet(f"{folder}/0")
        spark.createDataFrame([(0, bits, top)], "version INT, bits INT, top INT").write.mode("overwrite").parquet(f"{folder}/versions")
        return cls(spark, folder)

    def append(self, rows: DataFrame, order: Column, *key: Column) -> DataFrame:
        """(id, seen) of ``rows`` as :func:`seen_before` gives them, earlier batches included."""
        ids = _hashed(rows, order, key)
        runs = self.spark.read.schema("part INT, run BINARY").parquet(f"{self.folder}/{self.version}")
        out = cut(_answers(ids, _extent(ids), self.top, self.bits, runs))
        following = self.version + 1
        out.where(F.col("run").isNotNull()).select("part", "run").write.mode("overwrite").parquet(f"{self.folder}/{following}")
        named = self.spark.createDataFrame([(following, self.bits, self.top)], "version INT, bits INT, top INT")
        named.write.mode("append").parquet(f"{self.folder}/versions")
        self.version = following
        return out.where(F.col("run").isNull()).select("id", "seen")

    def n_keys(self) -> int:
        """Distinct hashes held."""
        head = F.hex(F.reverse(F.substring(F.col("run"), 1, 8)))
        n = self.spark.read.schema("part INT, run BINARY").parquet(f"{self.folder}/{self.version}").select(F.conv(head, 16, 10).cast("bigint").alias("n"))
        return n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
