"""Long exact spans that stand in more than one record.

Anchors are hashed only at positions that lie in a difference cover modulo a period v: for any two
positions there is a shift below v that brings both into the cover, so two equal windows of L letters
share an aligned anchor of L - v + 1 letters. Anchors in two or more records are kept; only around them
the windows of L letters are looked at, matched by fingerprints and extended to maximal runs. No step
pairs records: a span in a third of all records costs rows in proportion to its occurrences.

What several records have in common is found in one shuffle: a chunk of places decides by itself about keys
that two of its records hold, and sends one place of each for the sake of other chunks; places whose key one
record holds are sent in bundles by partition of the keys, and decided there. So a key that a third of all
places have reaches its partition as one place a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .codes import Windows, flat, runs_below

# Perfect difference sets (period, cover).
COVERS = [(1, [0]), (3, [0, 1]), (7, [0, 1, 3]), (13, [0, 1, 3, 9]), (21, [3, 6, 7, 12, 14]), (31, [1, 5, 11, 24, 25, 27])]
FLUSH = 1 << 20  # letters that are hashed at once
PLACES = 1 << 20  # places that a chunk decides about
PART_LETTERS = 1 << 22  # letters a partition of the keys: as many places at most, at some 28 bytes
_BUNDLE = "part INT, w1 BINARY, w2 BINARY, rec BINARY, pos BINARY"


def cover_for(length: int) -> tuple[int, list[int]]:
    """The widest cover that leaves anchors of at least half the window."""
    return [c for c in COVERS if length - c[0] + 1 >= length / 2][-1]


def _blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Records in blocks of about FLUSH letters, as (columns, code points, starts)."""
    for b in stream:
        cols = b.to_pydict()
        sizes = np.cumsum([len(t) for t in cols["text"]])
        cut = np.flatnonzero(np.diff(sizes // FLUSH, prepend=0))
        for s, e in zip([0, *cut], [*cut, b.num_rows]):
            if e > s:
                part = {k: v[s:e] for k, v in cols.items()}
                yield part, *flat(part["text"])


def _usable(codes: np.ndarray, starts: np.ndarray, alphabet: str | None, width: int) -> np.ndarray:
    """Starts of windows that lie within one text and within the alphabet."""
    bad = ~np.isin(codes, np.array([ord(c) for c in alphabet], np.uint32)) if alphabet else np.zeros(len(codes), bool)
    ok = runs_below(bad, width)
    for e in starts[1:-1]:  # no window crosses into the next text
        ok[max(0, e - width + 1) : e] = False
    return ok


def _anchors(length: int, alphabet: str | None):
    period, cover = cover_for(length)
    width = length - period + 1

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Windows(width)
        for cols, codes, starts in _blocks(stream):
            rec = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            pos = np.arange(len(codes)) - starts[rec]
            ok = np.flatnonzero(_usable(codes, starts, alphabet, width))
            ok = ok[np.isin(pos[ok] % period, cover)]
            ids = np.asarray(cols["rec_id"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes(codes)[ok].view(np.int64)), pa.array(np.zeros(len(ok), np.int64)), pa.array(ids[rec[ok]]), pa.array(pos[ok].astype(np.int32))],
                names=["w1", "w2", "rec_id", "pos"],
            )

    return run


def _windows(length: int, alphabet: str | None):
    period, _ = cover_for(length)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Windows(length), Windows(length, seed=2)
        for cols, codes, starts in _blocks(stream):
            ok = _usable(codes, starts, alphabet, length)
            near = np.zeros(len(codes) + 1, np.int32)
            at = np.concatenate([np.asarray(p, np.int64) + s for p, s in zip(cols["at"], starts)])
            np.add.at(near, np.maximum(at - period + 1, 0), 1)
            np.add.at(near, at + 1, -1)
            take = np.flatnonzero(ok & (np.cumsum(near)[: len(ok)] > 0))
            rec = np.searchsorted(starts, take, side="right") - 1
            ids = np.asarray(cols["rec_id"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one(codes)[take].view(np.int64)), pa.array(two(codes)[take].view(np.int64)), pa.array(ids[rec]), pa.array((take - starts[rec]).astype(np.int32))],
                names=["w1", "w2", "rec_id", "pos"],
            )

    return run


def _several(w1: np.ndarray, w2: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, shared): the places sorted by key, where each key begins, and whether two records or more hold it."""
    order = np.lexsort((w2, w1))
    x, y, r = w1[order], w2[order], rec[order]
    starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return order, starts, np.minimum.reduceat(r, starts) < np.maximum.reduceat(r, starts)


def _slices(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The stretches between ``edges`` as byte strings."""
    part = np.ascontiguousarray(data[edges[0] : edges[-1]])
    offsets = ((edges - edges[0]) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(part)])


def _bundled(parts: int):
    """Bundles of places for the partitions of their keys. A place of -1 only stands for its key; a bundle without keys is of places that are decided."""

    def bundles(held: list[pa.RecordBatch], nth: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        w1, w2, rec, pos = (t.column(c).to_numpy() for c in ("w1", "w2", "rec_id", "pos"))
        order, starts, shared = _several(w1, w2, rec)
        known = order[np.repeat(shared, np.diff(np.r_[starts, len(order)]))]
        open_ = order[np.repeat(~shared, np.diff(np.r_[starts, len(order)]))]
        stand_in = order[starts[shared]]
        at = np.r_[open_, stand_in]
        place = np.r_[pos[open_], np.full(len(stand_in), -1, np.int32)].astype(np.int32)
        part = (w1[at].view(np.uint64) % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        at, place, part = at[by_part], place[by_part], part[by_part]
        if len(at):
            edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
            yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]].astype(np.int32)), *(_slices(x[at], edges) for x in (w1, w2, rec)), _slices(place, edges)], names=["part", "w1", "w2", "rec", "pos"])
        if len(known):
            known = known[np.lexsort((pos[known], rec[known]))]
            edges = np.r_[np.arange(0, len(known), 1 << 16), len(known)]
            none = pa.array([None] * (len(edges) - 1), pa.binary())
            route = (np.arange(len(edges) - 1) + nth) % parts
            yield pa.RecordBatch.from_arrays([pa.array(route.astype(np.int32)), none, none, _slices(rec[known], edges), _slices(pos[known].astype(np.int32), edges)], names=["part", "w1", "w2", "rec", "pos"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, nth = [], 0, TaskContext.get().partitionId()
        for b in stream:
            held.append(b)
            rows += b.num_rows
            if rows >= PLACES:
                yield from bundles(held, nth)
                held, rows, nth = [], 0, nth + 1
        if rows:
            yield from bundles(held, nth)

    return run


def _decided(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, pos) of the places whose key two records or more hold, of all bundles of a partition."""

    def joined(batches: list[pa.RecordBatch], name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(b"".join(b.column(name).to_pylist()), kind) for b in batches])

    def places(rec: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rec), pa.array(pos)], names=["rec_id", "pos"])

    open_ = []
    for b in stream:
        keyed = b.column("w1").is_valid()
        done = b.filter(pc.invert(keyed))
        if done.num_rows:
            yield places(joined([done], "rec", np.int64), joined([done], "pos", np.int32))
        if (more := b.filter(keyed)).num_rows:
            open_.append(more)
    if open_:
        w1, w2, rec = (joined(open_, c, np.int64) for c in ("w1", "w2", "rec"))
        pos = joined(open_, "pos", np.int32)
        order, starts, shared = _several(w1, w2, rec)
        held = shared | (np.minimum.reduceat(pos[order], starts) < 0)  # or a chunk has found it shared
        take = order[np.repeat(held, np.diff(np.r_[starts, len(order)]))]
        take = take[pos[take] >= 0]
        yield places(rec[take], pos[take])


def _in_several(places: DataFrame, parts: int) -> DataFrame:
    """(rec_id, pos) of the rows of ``places(w1, w2, rec_id, pos)`` whose key (w1, w2) two records or more hold."""
    sent = places.mapInArrow(_bundled(parts), _BUNDLE).repartitionById(parts, F.col("part"))
    return sent.mapInArrow(_decided, "rec_id BIGINT, pos INT")


def shared_spans(records: DataFrame, length: int, alphabet: str | None = None) -> DataFrame:
    """(rec_id, span_start, span_len): maximal runs of letters within windows of ``length`` that other records hold too.

    ``records(rec_id BIGINT, text STRING)``, one row per rec_id; other columns are ignored. Windows with
    a letter outside ``alphabet`` count as none. Null and short texts have no spans; a repetition within
    one record is no sharing. Windows are identified by two independent 64-bit fingerprints.
    """
    texts = cut(records.where(F.length("text") >= length).select(F.col("rec_id").cast("bigint").alias("rec_id"), "text"))
    letters = texts.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-letters // PART_LETTERS))
    row = "w1 BIGINT, w2 BIGINT, rec_id BIGINT, pos INT"
    common = _in_several(texts.mapInArrow(_anchors(length, alphabet), row), parts)
    # a record's own anchor places: bounded by its own length
    places = common.groupBy("rec_id").agg(F.collect_list("pos").alias("at"))
    around = texts.join(places, "rec_id").mapInArrow(_windows(length, alphabet), row)
    marked = _in_several(around, parts)
    by_start = W.partitionBy("rec_id").orderBy("pos")
    gap = F.col("pos") > F.lag("pos").over(by_start) + length
    runs = marked.withColumn("gap", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("run", F.sum("gap").over(by_start))
    return runs.groupBy("rec_id", "run").agg(
        F.min("pos").alias("span_start"), (F.max("pos") - F.min("pos") + length).alias("span_len")
    ).drop("run")
