"""Evaluation items that stand, wholly or in part, in documents of a corpus.

Set join by prefix filter: the records are the evaluation items' windows of L letters or digits, their
tokens the shingles of q letters. A document contains a window only if it holds all its shingles, so one
necessary token a window - the rarest in the whole corpus - suffices as prefix. The corpus is read twice,
whatever the number of items: once to count the items' shingles, once for the places of the prefix tokens,
which are joined to the items' places. Both passes let only shingles through that a Bloom filter of at most
2^26 bits knows; what it lets through wrongly finds no partner. Of two places that meet, the letters on
either side travel along: windows of the item are verified on them, letter by letter, within the bounds that
the places set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .codes import Windows, letters_and_digits, mix, normalized

LENGTH = 50
SHINGLE = 24
CHUNK = 1 << 20
MOST_BITS = 26  # of the filter's size, as a power of two
BITMAP = 1 << 15  # bits that one row of Spark's bitmap functions has
NOTHING = 0x110000  # no code point


def _kept(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)


class Bloom:
    """Which tokens may be in a set: three bits each, taken from different parts of the token."""

    def __init__(self, log2: int, packed: np.ndarray) -> None:
        self.log2, self.packed, self._bits = log2, packed, None

    @staticmethod
    def places(tokens: np.ndarray, log2: int, i: int) -> np.ndarray:
        return (mix(tokens, 101 + i) >> np.uint64(64 - log2)).astype(np.int64) if i else (tokens & np.uint64((1 << log2) - 1)).astype(np.int64)

    @classmethod
    def of(cls, tokens: DataFrame) -> Bloom:
        """Of ``tokens(token)``. What reaches the driver is bounded by 2^MOST_BITS bits."""
        log2 = min(MOST_BITS, max(16, math.ceil(math.log2(max(1, tokens.count()) * 24))))

        def spots(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in stream:
                t = b.column(0).to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([cls.places(t, log2, i) for i in range(3)])) + 1)], names=["x"])

        x = tokens.select("token").mapInArrow(spots, "x BIGINT")
        rows = x.groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
        packed = np.zeros((1 << log2) // 8, np.uint8)
        for r in rows:  # 4 KB each
            at = (r.b - 1) * BITMAP // 8
            packed[at : at + BITMAP // 8] = np.frombuffer(r.bits, np.uint8)[: len(packed) - at]
        return cls(log2, packed)

    def hits(self, tokens: np.ndarray) -> np.ndarray:
        """Places of the tokens that may be in the set."""
        if self._bits is None:
            self._bits = np.unpackbits(self.packed, bitorder="little").view(bool)
        at = np.flatnonzero(self._bits[self.places(tokens, self.log2, 0)])
        for i in (1, 2):
            at = at[self._bits[self.places(tokens[at], self.log2, i)]]
        return at


def _chunks(stream: Iterator[pa.RecordBatch], kept: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole normalized texts in chunks, apart by a guard of one letter; with the texts' ids by letter."""
    parts, owners, size = [], [], 0
    guard = np.full(1, NOTHING, np.uint32)
    for b in stream:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for i, text in zip(ids, b.column(1).to_pylist()):
            codes = normalized(text, kept)
            parts += [codes, guard]
            owners.append((i, len(codes) + 1))
            size += len(codes) + 1
            if size >= CHUNK:
                yield np.concatenate(parts), np.repeat([i for i, _ in owners], [n for _, n in owners])
                parts, owners, size = [], [], 0
    if parts:
        yield np.concatenate(parts), np.repeat([i for i, _ in owners], [n for _, n in owners])


def _item_shingles(bits: bytes, length: int, q: int):
    """(token, item_id, pos) of every shingle of items of ``length`` letters or more."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, hashes = _kept(bits), Windows(q)
        for b in stream:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes = normalized(text, kept)
                if len(codes) >= length:
                    h = hashes(codes)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), i, np.int64)), pa.array(np.arange(len(h), dtype=np.int32))], names=["token", "item_id", "pos"])

    return run


def _counted(bloom: Bloom, bits: bytes, q: int):
    """(token, n) per chunk of documents of the shingles that pass the filter."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, hashes = _kept(bits), Windows(q)
        for codes, _ in _chunks(stream, kept):
            h = hashes(codes)
            token, n = np.unique(h[bloom.hits(h)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    return run


def _rarest(per_window: int):
    """Of rows (item_id, pos, n, token), sorted: the places that are the rarest of some window, ties by the token."""

    def chosen(item: int, n: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
        rank = np.empty(len(n), np.int64)
        rank[np.lexsort((token, n))] = np.arange(len(n))
        views = np.lib.stride_tricks.sliding_window_view(rank, per_window)
        at = np.unique(np.arange(len(views)) + views.argmin(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), item, np.int64)), pa.array(at.astype(np.int32)), pa.array(token[at])], names=["item_id", "pos", "token"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, ns, tokens = None, [], []
        for b in stream:
            ids, n, token = (b.column(c).to_numpy() for c in ("item_id", "n", "token"))
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
            for s, e in zip(starts, [*starts[1:], len(ids)]):
                if item is not None and ids[s] != item:
                    yield chosen(item, np.concatenate(ns), np.concatenate(tokens))
                    ns, tokens = [], []
                item = int(ids[s])
                ns.append(n[s:e]), tokens.append(token[s:e])
        if item is not None:
            yield chosen(item, np.concatenate(ns), np.concatenate(tokens))

    return run


def _around(codes: np.ndarray, at: np.ndarray, length: int, q: int) -> pa.Array:
    """The letters from ``length - q`` before each place to ``length`` from it on, as bytes."""
    before = length - q
    padded = np.concatenate([np.full(before, NOTHING, np.uint32), codes, np.full(length, NOTHING, np.uint32)])
    rows = np.ascontiguousarray(padded[at[:, None] + np.arange(before + length)])
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * rows.shape[1] * 4), pa.py_buffer(rows)])


def _item_places(bits: bytes, length: int, q: int):
    """(item_id, token, item_letters) of items' chosen places."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _kept(bits)
        for b in stream:
            for i, text, places in zip(*(b.column(c).to_pylist() for c in ("item_id", "text", "places"))):
                codes = normalized(text, kept)
                for s in range(0, len(places), 4096):
                    some = places[s : s + 4096]
                    at = np.array([p["pos"] for p in some], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), i, np.int64)), pa.array([p["token"] for p in some], pa.int64()), _around(codes, at, length, q)],
                        names=["item_id", "token", "item_letters"],
                    )

    return run


def _doc_places(bloom: Bloom, bits: bytes, length: int, q: int):
    """(doc_id, token, doc_letters) of the places in documents that pass the filter."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, hashes = _kept(bits), Windows(q)
        for codes, owner in _chunks(stream, kept):
            h = hashes(codes)
            at = bloom.hits(h)
            for s in range(0, len(at), 4096):
                a = at[s : s + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(owner[a].astype(np.int64)), pa.array(h[a].view(np.int64)), _around(codes, a, length, q)], names=["doc_id", "token", "doc_letters"])

    return run


def _verified(length: int, q: int):
    before = length - q

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                one, two = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(part.num_rows, -1) for c in ("doc_letters", "item_letters"))
                same = (one == two) & (one != NOTHING)
                left = np.logical_and.accumulate(same[:, :before][:, ::-1], axis=1).sum(axis=1)
                right = np.logical_and.accumulate(same[:, before:], axis=1).sum(axis=1)
                ok = (right >= q) & (left + right >= length)
                pairs = np.unique(np.stack([part.column(c).to_numpy()[ok] for c in ("doc_id", "item_id")], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["doc_id", "item_id"])

    return run


def leaked_pairs(documents: DataFrame, benchmark: DataFrame, length: int = LENGTH, q: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id), without repeats: the two texts share ``length`` consecutive letters or digits.

    Texts are lower-cased and every character but Unicode letters and numbers is left out first. Null,
    empty and shorter texts share nothing, rows without an id are left out; empty tables give no rows;
    extra columns are ignored. One plan for any number of items: none of them pass through the driver.
    """
    bits = letters_and_digits()
    texts = lambda df, i: df.where(F.col(i).isNotNull() & (F.length("text") >= length // 3)).select(F.col(i).cast("bigint").alias(i), "text")
    docs, items = texts(documents, "doc_id"), texts(benchmark, "item_id")
    shingles = cut(items.mapInArrow(_item_shingles(bits, length, q), "token BIGINT, item_id BIGINT, pos INT"))
    seen = docs.mapInArrow(_counted(Bloom.of(shingles), bits, q), "token BIGINT, n BIGINT")
    counts = seen.groupBy("token").agg(F.sum("n").alias("n"))
    ranked = shingles.join(counts, "token", "left").select("item_id", "pos", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "token")
    prefix = ranked.repartition("item_id").sortWithinPartitions("item_id", "pos").mapInArrow(_rarest(length - q + 1), "item_id BIGINT, pos INT, token BIGINT")
    prefix = cut(prefix)
    per_item = prefix.groupBy("item_id").agg(F.collect_list(F.struct("pos", "token")).alias("places"))  # an item's own places
    known = items.join(per_item, "item_id").mapInArrow(_item_places(bits, length, q), "item_id BIGINT, token BIGINT, item_letters BINARY")
    found = docs.mapInArrow(_doc_places(Bloom.of(prefix), bits, length, q), "doc_id BIGINT, token BIGINT, doc_letters BINARY")
    met = found.join(known, "token").select("doc_id", "item_id", "doc_letters", "item_letters")
    return met.mapInArrow(_verified(length, q), "doc_id BIGINT, item_id BIGINT").distinct()
