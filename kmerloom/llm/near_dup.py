"""Near-duplicate sequences: set-similarity join by a universe partition and the pigeonhole principle.

A sequence is the set of its distinct 9-base windows. The universe of windows is partitioned into
segments by a function of the window alone: one of its 7-base words, chosen by its lowest-ranked pair of
bases. Neighbouring windows mostly agree on that word, so that segments hold one to three windows of a
sequence, mostly three, whatever its length (a plain hash leaves too many empty or single-window segments
to reach the bound below at a similarity of one half). Being local, this partition serves all size bands
alike; a band enters by the number of units to buy.

Sets of s >= l windows with Jaccard similarity of a half or more differ in at most H = (s + l) // 3
windows. If the larger set gives each of its segments v = 0, 1 or 2 units, H + 1 or more in all, then in
some segment with units the two differ in fewer than v windows: they are equal (v = 1), or equal up to
one deletion on one side (v = 2). So equal segments and one-deletion neighbourhoods are indexed, and
each set buys its units where they cost least, by counted frequencies of keys and windows for its size.

A segment of at most three windows travels as one row, of some 4 bytes when compressed; its key and those of its
deletions are made where rows meet, all rows of a 7-base word in one task.

Short keys often match by chance, so every set has a 320-bit parity sketch, whose number of differing bits
never exceeds the number of differing windows: chance matches die before they leave the task. Sketches are
written to the shared folder once, by the tasks that make the rows, and each task reads those of its sets (where Python
cannot open that folder, they travel with the rows). Sets whose segments hold too few units (tiny or repetitive ones) use the finest partition, one
window a segment. All candidates are verified exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.feather
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, dropped, dropped_table, stored
from .codes import flat, mix, runs_below

K = 9
SHIFT = 2 * K
UNIVERSE = 1 << SHIFT
WORD = 7
SKETCH = 5  # 64-bit words of the parity sketch
BLOCK = 1 << 20
BUNDLE = 1 << 12  # most sets whose rows for one partition travel together
DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}  # sorted numbers as differences
GROUP = 1 << 15  # sets whose rows are sorted and compressed together
BATCH_BYTES = 1 << 26
PARTITION_ROWS = 1 << 22  # rows that a task holds, at 16 bytes each and 52 more for each of their sets
SALT_ROWS = 1 << 21  # a key, or the segments of a word, that may have more rows are split
SHORT = 40
HOT_SHARE = 64  # a window in more than 1 of 64 sets makes its keys expensive


def allowed_difference(s, l):  # noqa: E741
    """Most differing windows of sets of s and l windows with similarity >= 1/2."""
    return (s + l) // 3


# Ranks of the two-base words AA, AC ... TT, found by search among random orders for few
# segments of a single window and many of three.
RANKS = [7, 4, 1, 3, 12, 10, 0, 14, 13, 11, 15, 8, 9, 5, 2, 6]


def _places() -> np.ndarray:
    t = np.arange(UNIVERSE, dtype=np.uint64)
    pairs = np.stack([t >> np.uint64(SHIFT - 4 - 2 * i) & np.uint64(15) for i in range(K - 1)]).astype(np.int64)
    return np.array(RANKS)[pairs].argmin(axis=0) % (K - WORD + 1)


def segment_table() -> np.ndarray:
    """Segment of every window: one of its three 7-base words, chosen by the place (modulo 3) of its lowest-ranked pair of bases."""
    t = np.arange(UNIVERSE, dtype=np.uint64)
    return t >> (2 * (K - WORD - _places())).astype(np.uint64) & np.uint64((1 << 2 * WORD) - 1)


def code_table() -> np.ndarray:
    """Six bits that tell a window from the others of its segment: the place of the word and the two bases beside it."""
    t, place = np.arange(UNIVERSE), _places()
    behind = 2 * (K - WORD - place)
    return (place << 4 | t >> (2 * WORD + behind) << behind | t & ((1 << behind) - 1)).astype(np.uint32)


def window_table() -> np.ndarray:
    """The window at 64 times its segment plus its code."""
    out = np.zeros(64 << 2 * WORD, np.int64)
    out[segment_table().astype(np.int64) << 6 | code_table()] = np.arange(UNIVERSE)
    return out


class Sets:
    """The window sets of a block of sequences, sorted by set, segment and window."""

    def __init__(self, texts: list[str], segments: np.ndarray) -> None:
        codes, starts = flat(texts)
        letter = np.full(128, 4, np.uint8)
        letter[[65, 67, 71, 84]] = [0, 1, 2, 3]
        base = letter[np.minimum(codes, 127)]
        ok = runs_below(base > 3, K)
        for e in starts[1:-1]:
            ok[max(0, e - K + 1) : e] = False
        value = np.zeros(len(ok), np.uint64)
        for j in range(K):
            value = value << np.uint64(2) | base[j : j + len(ok)].astype(np.uint64)
        at = np.flatnonzero(ok)
        owner = np.searchsorted(starts, at, side="right").astype(np.uint64) - np.uint64(1)
        token = value[at]
        packed = owner << np.uint64(40) | segments[token] << np.uint64(SHIFT) | token
        packed.sort()
        packed = packed[np.r_[True, packed[1:] != packed[:-1]]] if len(packed) else packed
        self.n_sets = len(texts)
        self.token = (packed & np.uint64(UNIVERSE - 1)).astype(np.int64)
        self.owner = (packed >> np.uint64(40)).astype(np.int64)
        self.size = np.bincount(self.owner, minlength=self.n_sets)
        new = np.r_[True, (packed[1:] >> np.uint64(SHIFT)) != (packed[:-1] >> np.uint64(SHIFT))] if len(packed) else np.zeros(0, bool)
        self.seg = np.cumsum(new) - 1  # of each window
        self.seg_start = np.flatnonzero(new)
        self.z = np.diff(np.r_[self.seg_start, len(packed)])
        self.seg_owner = self.owner[self.seg_start]
        self.word = (packed[self.seg_start] >> np.uint64(SHIFT) & np.uint64((1 << 2 * WORD) - 1)).astype(np.int64)

    def need(self) -> np.ndarray:
        return allowed_difference(self.size, self.size) + 1

    def units(self) -> np.ndarray:
        return np.bincount(self.seg_owner, np.minimum(self.z, 2), self.n_sets).astype(np.int64)

    def lacking(self) -> np.ndarray:
        """Sets whose segments hold too few units."""
        return (self.units() < self.need()) & (self.size > 0)

    def sketches(self) -> np.ndarray:
        bit = (mix(self.token.astype(np.uint64), 23) % np.uint64(64 * SKETCH)).astype(np.int64)
        out = np.zeros((self.n_sets, SKETCH), np.uint64)
        np.bitwise_xor.at(out, (self.owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        return out


def _blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    for b in stream:
        ids, texts = b.column("set_id").to_numpy(), b.column("seq").to_pylist()
        sizes = np.cumsum([len(t) for t in texts])
        edges = np.flatnonzero(np.diff(sizes // BLOCK, prepend=0))
        for s, e in zip([0, *edges], [*edges, len(texts)]):
            if e > s:
                yield ids[s:e], texts[s:e]


def _frequencies(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per window the sets that hold it and those that hold it alone in its segment; at UNIVERSE the sets and lacking sets."""
    segments, n, alone, sets, lacking = segment_table(), np.zeros(UNIVERSE, np.int64), np.zeros(UNIVERSE, np.int64), 0, 0
    for _, texts in _blocks(stream):
        s = Sets(texts, segments)
        n += np.bincount(s.token, minlength=UNIVERSE)
        alone += np.bincount(s.token[s.seg_start[s.z == 1]], minlength=UNIVERSE)
        sets, lacking = sets + int((s.size > 0).sum()), lacking + int(s.lacking().sum())
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[at, UNIVERSE]), pa.array(np.r_[n[at], sets]), pa.array(np.r_[alone[at], lacking])], names=["token", "n", "alone"]
    )


def _cheapest(owner: np.ndarray, cost: np.ndarray, units: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which purchases each owner makes: the cheapest ones until ``need`` units are there."""
    order = np.lexsort((cost, owner))
    o, u = owner[order], units[order]
    before = np.cumsum(u) - u
    first = np.r_[True, o[1:] != o[:-1]] if len(o) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(first, before, 0)) if len(o) else before
    taken = np.zeros(len(owner), bool)
    taken[order] = before - base < need[o]
    return taken


def _fallback_tokens(n: np.ndarray):
    """The windows that lacking sets probe with: their rarest, as many as they need units."""

    def pick(s: Sets) -> np.ndarray:
        mine = np.flatnonzero(s.lacking()[s.owner])
        return mine[_cheapest(s.owner[mine], n[s.token[mine]], np.ones(len(mine), np.int64), s.need())]

    return pick


def _probed(n: np.ndarray):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, pick = segment_table(), _fallback_tokens(n)
        for _, texts in _blocks(stream):
            s = Sets(texts, segments)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(s.token[pick(s)]))], names=["token"])

    return run


# What a row of a key does: it only probes, it does both (with two units or one), or it is only indexed.
PROBE, BOTH2, BOTH1, INDEX = 0, 1, 2, 3
DELETED, SEGMENT = 4, 8  # a key with one window deleted; a segment's windows and its units instead of a key and a role
_BUNDLE = "part INT, keys BINARY, roles BINARY, ids BINARY, sizes BINARY, sketches BINARY"


def _purchases(s: Sets, n: np.ndarray, alone: np.ndarray, n_sets: int) -> np.ndarray:
    """Units of every segment (0, 1 or 2). A segment's second unit needs two windows and costs no less than its first."""
    rarest = np.minimum.reduceat(n[s.token], s.seg_start)
    # neighbouring windows share all letters but one, so each further window cuts a key's rows to about a quarter
    longer = rarest >> np.minimum(2 * (s.z - 1), 40)
    several = np.where(rarest * HOT_SHARE > n_sets, rarest, longer)
    single = np.add.reduceat(alone[s.token], s.seg_start) + 1  # keys of one window: as many rows as counted
    first = np.where(s.z == 1, single, several)
    second = np.maximum(np.where(s.z == 2, single, several), first)
    more = np.flatnonzero(s.z >= 2)
    owner, cost = np.r_[s.seg_owner, s.seg_owner[more]], np.r_[first, second[more]]
    bought = _cheapest(owner, cost, np.ones(len(owner), np.int64), s.need())
    v = bought[: len(s.z)].astype(np.int64)
    v[more] += bought[len(s.z) :]
    v[s.lacking()[s.seg_owner]] = 0
    return v


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The stretches between ``edges`` as byte strings, without a Python object each."""
    offsets = pa.py_buffer((edges * data.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])


def _rarest(s: Sets, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets that hold each segment's rarest window, and per window those that hold the rarest of its segment's others.

    They bound the rows of a key by the windows that are in it, so that equal keys are salted alike.
    """
    count = n[s.token]
    rarest = np.minimum.reduceat(count, s.seg_start)
    hit = np.flatnonzero(count == rarest[s.seg])
    at = hit[np.r_[True, s.seg[hit[1:]] != s.seg[hit[:-1]]]]  # the first of the rarest, one a segment
    count[at] = np.iinfo(np.int64).max
    left = rarest[s.seg]
    left[at] = np.minimum.reduceat(count, s.seg_start)
    return rarest, left


def _salted(rows: list[np.ndarray], salts: np.ndarray, home: np.ndarray, again: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows with a salt each: the home one, and for rows that probe (``again``) all others as well."""
    home = (mix(home.astype(np.uint64), 53) % salts.astype(np.uint64)).astype(np.int64)
    many = np.flatnonzero((salts > 1) & again)
    at = np.repeat(many, salts[many])
    salt = np.arange(len(at)) - np.repeat(np.cumsum(salts[many]) - salts[many], salts[many])
    at, salt = at[salt != home[at]], salt[salt != home[at]]
    return [np.r_[r, r[at]] for r in rows], np.r_[home, salt]


def _beside(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bases beside the word in the middle one of three neighbouring windows, as its neighbours have them."""
    return (high & 3) << 2 | low >> 2 & 3


def _segment_key(word: np.ndarray, z: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """32 bits that tell a segment and its windows, of codes a, b and c (a is c if z is 1, b is c if z is at most 2).

    Laid out for compression byte by byte: what the middle window has in common with its neighbours is left out.
    """
    low, high = np.minimum(np.minimum(a, b), c), np.maximum(np.maximum(a, b), c)
    middle = np.where(z == 3, a + b + c - low - high, high) ^ _beside(low, high)
    return (word << 18 | middle >> 4 << 16 | (middle & 15) << 12 | (low & 15) << 8 | low >> 4 << 6 | high).astype(np.uint32)


def _segment_windows(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Word and codes that a segment's 32 bits were made of: three codes, of which the last ones are equal if the segment has fewer."""
    key = key.astype(np.int64)
    high, low = key & 63, (key >> 6 & 3) << 4 | key >> 8 & 15
    return key >> 18, [low, ((key >> 16 & 3) << 4 | key >> 12 & 15) ^ _beside(low, high), high]


def _segment_rows(s: Sets, v: np.ndarray, ids: np.ndarray, h: np.ndarray, codes: np.ndarray, word_rows: np.ndarray) -> tuple:
    """(key, word of owner and flags, number that gives the partition) of all segments. Rows of one word meet in one partition, or in one a salt."""
    small = np.flatnonzero(s.z <= 3)
    first, last = s.seg_start[small], s.seg_start[small] + s.z[small] - 1
    key = _segment_key(s.word[small], s.z[small], *(codes[s.token[x]] for x in (first, np.minimum(first + 1, last), last)))
    total = np.add.reduceat(h, s.seg_start)
    large = np.flatnonzero(s.z > 3)
    less = np.flatnonzero(s.z[s.seg] > 3)  # each of their windows deleted once
    units = np.array([INDEX, BOTH1, BOTH2])
    hashed = mix(np.r_[total[large], total[s.seg[less]] - h[less]], 41)
    key = np.r_[key, (hashed & np.uint64(0xFFFFFFFF)).astype(np.uint32)]
    seg = np.r_[small, large, s.seg[less]]
    flags = np.r_[SEGMENT | v[small], units[v[large]], DELETED | np.where(v[s.seg[less]] == 2, BOTH2, INDEX)]
    owner, word = s.seg_owner[seg], s.word[seg]
    (key, owner, flags, word), salt = _salted([key, owner, flags, word], 1 + word_rows[word] // SALT_ROWS, ids[owner], v[seg] > 0)
    return key, owner, flags, mix((word << 32 | salt).astype(np.uint64), 59)


def _window_rows(s: Sets, n: np.ndarray, deep: np.ndarray, probed: np.ndarray, ids: np.ndarray, h: np.ndarray) -> tuple:
    """The same of single windows, the finest partition: ``deep`` ones probe for sets that lack units; the windows probed with are indexed for all sets."""
    at = np.r_[deep, np.flatnonzero(probed[s.token])]
    flags = np.r_[np.full(len(deep), PROBE), np.full(len(at) - len(deep), INDEX)]
    hashed, owner = mix(h[at] + np.uint64(1), 41), s.owner[at]
    (hashed, owner, flags), salt = _salted([hashed, owner, flags], 1 + n[s.token[at]] // SALT_ROWS, ids[owner], flags == PROBE)
    return (hashed & np.uint64(0xFFFFFFFF)).astype(np.uint32), owner, flags, mix(hashed + salt.astype(np.uint64), 59)


def _rows(n: np.ndarray, alone: np.ndarray, n_sets: int, probed: np.ndarray, parts: int, folder: str | None = None):
    """Index and probe rows of all sets, bundled by partition of the keys: with a ``folder`` as :func:`_compressed`, the sketches
    being written there, else as :func:`_carried`. Keys are cut to 32 bits: equal keys by chance are no matter, since sketches
    are compared anyway.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, codes, pick = segment_table(), code_table(), _fallback_tokens(n)
        word_rows = np.bincount(segments.astype(np.int64), n, 1 << 2 * WORD).astype(np.int64)
        sketches, rows, held = [], [], 0
        for ids, texts in _blocks(stream):
            s = Sets(texts, segments)
            if not len(s.token):
                continue
            h = mix(s.token.astype(np.uint64), 31)
            v, sketch = _purchases(s, n, alone, n_sets), s.sketches()
            groups = _segment_rows(s, v, ids, h, codes, word_rows), _window_rows(s, n, pick(s), probed, ids, h)
            key, owner, flags, spot = (np.concatenate(x) for x in zip(*groups))
            part = (spot % np.uint64(parts)).astype(np.int64)
            if not folder:
                yield from _carried(key, owner, flags, part, parts, ids, s.size, sketch)
                continue
            sketches.append((ids, s.size.astype(np.int32), sketch))
            rows.append((key, ids[owner], flags.astype(np.uint8), part, owner + held))
            held += len(ids)
            if held >= GROUP:
                yield _compressed(rows)
                rows, held = [], 0
        if rows:
            yield _compressed(rows)
        if sketches:
            _keep_sketches(folder, sketches)

    return run


_NAMES = ["part", "keys", "roles", "ids", "sizes", "sketches"]
_ROW = 4 + 8 + 1  # bytes of a key, the step from the set's number in the row before, and flags


def _compressed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of a group of sets, a bundle each partition: sorted by set, byte by byte (all first bytes, then all second ones), compressed."""
    key, ids, flags, part, nth = (np.concatenate(x) for x in zip(*rows))
    order = np.argsort(part << 32 | nth)
    key, ids, flags, part = key[order], ids[order], flags[order], part[order]
    edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
    step = np.diff(ids, prepend=0)
    step[edges[:-1]] = 0
    codec, parts = pa.Codec("zstd", 1), part[edges[:-1]]
    columns = [key[:, None].view(np.uint8), step[:, None].view(np.uint8), flags[:, None]]
    packed = [codec.compress(b"".join(c[x:y].T.tobytes() for c in columns), asbytes=True) for x, y in zip(edges, edges[1:])]
    first = np.c_[ids[edges[:-1]], np.diff(edges)].ravel().astype(np.int64)  # number of the first set, rows
    none = _binary(np.zeros(0, np.uint8), np.zeros(len(edges), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(packed, pa.binary()), none, _binary(first, 2 * np.arange(len(edges))), none, none], names=_NAMES)


def _opened(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the set, flags) of compressed rows."""
    codec, out = pa.Codec("zstd", 1), []
    for b in batches:
        for data, first in zip(b.column("keys").to_pylist(), b.column("ids").to_pylist()):
            at, n = np.frombuffer(first, np.int64)
            planes = np.frombuffer(codec.decompress(data, n * _ROW, asbytes=True), np.uint8).reshape(_ROW, n)
            key, step = (np.ascontiguousarray(planes[x:y].T).view(kind)[:, 0] for x, y, kind in ((0, 4, np.uint32), (4, 12, np.int64)))
            out.append((key, at + np.cumsum(step), planes[12]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _carried(key: np.ndarray, owner: np.ndarray, flags: np.ndarray, part: np.ndarray, parts: int, ids: np.ndarray, sizes: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a block, a bundle for each partition and each BUNDLE sets at most.

    A bundle has number, size and sketch (52 bytes) of each of the sets that have rows in it, once, and 4 + 2
    bytes a row: at most 58 bytes a row, however many partitions there are.
    """
    where = owner // BUNDLE * parts + part
    order = np.lexsort((owner, where))
    where, owner = where[order], owner[order]
    edges = np.r_[0, np.flatnonzero(where[1:] != where[:-1]) + 1, len(where)]
    first = np.r_[True, (owner[1:] != owner[:-1]) | (where[1:] != where[:-1])]  # of each set in each bundle
    sets, nth = owner[first], np.cumsum(first) - 1
    set_edges = np.r_[nth[edges[:-1]], len(sets)]
    local = nth - np.repeat(set_edges[:-1], np.diff(edges))
    word = (local << 4 | flags[order]).astype(np.uint16)
    key, at = key[order], where[edges[:-1]] % parts
    size = np.cumsum(np.diff(edges) * 6 + np.diff(set_edges) * (12 + 8 * SKETCH))
    splits = np.flatnonzero(np.diff(size // BATCH_BYTES, prepend=0))
    for x, y in zip([0, *splits], [*splits, len(at)]):
        if y > x:
            e, g = edges[x : y + 1], set_edges[x : y + 1]
            held = sets[g[0] : g[-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[x:y].astype(np.int32)), _binary(key[e[0] : e[-1]], e - e[0]), _binary(word[e[0] : e[-1]], e - e[0]), _binary(ids[held].astype(np.int64), g - g[0]),
                 _binary(sizes[held].astype(np.int32), g - g[0]), _binary(sketch[held].ravel(), (g - g[0]) * SKETCH)],
                names=_NAMES,
            )


def _keep_sketches(folder: str, kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """A task's sketches (52 bytes a set) as one file; it appears whole, and a repeated task puts the same in its place."""
    ids, size, sketch = (np.concatenate(x) for x in zip(*kept))
    order = np.argsort(ids)
    words = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * SKETCH), len(ids), [None, pa.py_buffer(np.ascontiguousarray(sketch[order]))])
    table = pa.table({"id": ids[order].astype(np.int64), "size": size[order], "sketch": words})
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    written = f"{path}/.{uuid.uuid4()}"
    with fs.open_output_stream(written) as out:
        pa.feather.write_feather(table, out, compression="lz4")
    task = TaskContext.get()
    fs.move(written, f"{path}/{task.partitionId() if task else 0}.arrow")


def _sketches_of(ids: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and sketches of the sets with these sorted numbers."""
    size, sketch, n = np.zeros(len(ids), np.int32), np.zeros((len(ids), SKETCH), np.uint64), 0
    fs, path = pa.fs.FileSystem.from_uri(folder)
    for info in fs.get_file_info(pa.fs.FileSelector(path)):
        if info.base_name.startswith("."):
            continue
        with fs.open_input_file(info.path) as f, pa.ipc.open_file(f) as parts:
            for i in range(parts.num_record_batches):
                b = parts.get_batch(i)
                there = b.column("id").to_numpy()
                lo, hi = np.searchsorted(ids, [there[0], there[-1]], side="left") + [0, 1]
                at = np.searchsorted(there, ids[lo:hi])
                hit = np.flatnonzero(there[np.minimum(at, len(there) - 1)] == ids[lo:hi])
                words = b.column("sketch")
                words = np.frombuffer(words.buffers()[1], np.uint64).reshape(-1, SKETCH)[words.offset : words.offset + len(words)]
                size[lo + hit], sketch[lo + hit] = b.column("size").to_numpy()[at[hit]], words[at[hit]]
                n += len(hit)
    if n != len(ids):
        raise RuntimeError(f"sketches of {len(ids) - n} of {len(ids)} sets are missing or double in {folder}")
    return size, sketch


def _expanded(key: np.ndarray, units: np.ndarray, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, key, flags) of the keys of segments that travelled as their windows: whole ones, then those with one window deleted."""
    word, codes = _segment_windows(key)
    z = 1 + (codes[0] != codes[1]).astype(np.int64) + (codes[1] != codes[2])
    h = [mix(windows[word << 6 | c].astype(np.uint64), 31) for c in codes]
    low = lambda total: (mix(total, 41) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    total = h[0] + np.where(z > 1, h[1], np.uint64(0)) + np.where(z > 2, h[2], np.uint64(0))
    yield np.arange(len(key)), low(total), np.array([INDEX, BOTH1, BOTH2])[units]
    for z_of, at in ((3, np.flatnonzero(z == 3)), (2, np.flatnonzero((z == 2) & (units == 2)))):  # what is left of two windows only probes
        for x in h[:z_of]:
            flags = np.where(units[at] == 2, BOTH2, INDEX) if z_of == 3 else np.full(len(at), PROBE)
            yield at, low(total[at] - x[at]), DELETED | flags


class _Part:
    """All rows of a partition, sorted by key and, within a key, by the sets' size and number."""

    def __init__(self, batches: list[pa.RecordBatch], folder: str | None = None) -> None:
        def joined(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(b"".join(b.column(name).to_pylist()), kind) for b in batches])

        if folder:
            key, ids, flags = _opened(batches)
            ids, owner = np.unique(ids, return_inverse=True)
            size, sketch = _sketches_of(ids, folder)
        else:
            rows = np.concatenate([pc.binary_length(b.column("keys")).to_numpy() for b in batches]) // 4
            sets = np.concatenate([pc.binary_length(b.column("ids")).to_numpy() for b in batches]) // 8
            ids, word, key = joined("ids", np.int64), joined("roles", np.uint16), joined("keys", np.uint32)
            owner, flags = np.repeat(np.cumsum(sets) - sets, rows) + (word >> 4), word & 15
            size, sketch = joined("sizes", np.int32), joined("sketches", np.uint64).reshape(-1, SKETCH)
        order = np.lexsort((ids, size))
        rank = np.empty(len(ids), np.uint64)
        rank[order] = np.arange(len(ids), dtype=np.uint64)
        self.ids, self.size, self.sketch = ids[order], size[order], np.ascontiguousarray(sketch[order])
        rank = rank[owner]

        def packed(key: np.ndarray, rank: np.ndarray, flags: np.ndarray) -> np.ndarray:
            flags = flags.astype(np.uint64)
            return key.astype(np.uint64) << np.uint64(32) | (flags & np.uint64(DELETED)) << np.uint64(29) | rank << np.uint64(2) | flags & np.uint64(3)

        plain, whole, windows = np.flatnonzero(flags < SEGMENT), np.flatnonzero(flags >= SEGMENT), window_table()
        pieces = [packed(key[plain], rank[plain], flags[plain])]
        for k in range(0, len(whole), BLOCK):
            at = whole[k : k + BLOCK]
            pieces += [packed(x, rank[at[i]], f) for i, x, f in _expanded(key[at], flags[at] & 3, windows)]
        row = np.concatenate(pieces)
        del pieces
        row.sort()
        key = row >> np.uint64(32)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.starts, self.ends = new, np.r_[new[1:], len(row)]
        self.of = ((row >> np.uint64(2)) & np.uint64((1 << 29) - 1)).astype(np.int32)  # place of the row's set
        self.deleted, self.role = (row & np.uint64(1 << 31)) > 0, (row & np.uint64(3)).astype(np.uint8)
        before = np.r_[0, np.cumsum(~self.deleted)]
        self.whole = before[self.ends] - before[self.starts]  # rows of whole segments; they come first in a run

    def _found(self, a: np.ndarray, b: np.ndarray, near: bool) -> np.ndarray:
        """Of pairs of rows, a's of whole segments: those that may meet and that the sketches let through, as one number each.

        The larger set must have bought the meeting and the other one be indexed. ``near``: the sketches are compared already.
        """
        turned = self.of[a] < self.of[b]
        x, y = np.where(turned, b, a), np.where(turned, a, b)
        sx, sy = self.of[x], self.of[y]
        ok = (sx > sy) & (self.role[x] != INDEX) & (self.role[y] != PROBE) & (2 * self.size[sy] >= self.size[sx])
        ok &= ~self.deleted[y] | (self.role[x] == BOTH2)
        sx, sy = sx[ok], sy[ok]
        if not near:
            d = np.bitwise_count(self.sketch[sx] ^ self.sketch[sy]).sum(axis=1, dtype=np.int32)
            ok = d <= allowed_difference(self.size[sx], self.size[sy])
            sx, sy = sx[ok], sy[ok]
        return sx.astype(np.int64) << 32 | sy

    def pairs(self) -> Iterator[np.ndarray]:
        """Pairs of rows with one key of which one is of a whole segment: two deletions never decide."""
        sizes = self.ends - self.starts
        short = np.flatnonzero((sizes > 1) & (sizes <= SHORT) & (self.whole > 0))
        shape = sizes[short] * (SHORT + 1) + self.whole[short]
        for one in np.unique(shape):  # runs of one shape all at once
            s = self.starts[short[shape == one]]
            i, j = np.triu_indices(one // (SHORT + 1), 1)
            i, j = i[i < one % (SHORT + 1)], j[i < one % (SHORT + 1)]
            step = max(1, (BLOCK // 4) // len(i))
            for k in range(0, len(s), step):
                at = s[k : k + step, None]
                yield self._found((at + i).ravel(), (at + j).ravel(), False)
        for r in np.flatnonzero((sizes > SHORT) & (self.whole > 0)):
            start, end, middle = int(self.starts[r]), int(self.ends[r]), int(self.starts[r] + self.whole[r])
            sets = self.of[start:end]
            words, size = np.ascontiguousarray(self.sketch[sets].T), self.size[sets]
            step = min(256, max(16, (1 << 17) // (end - start)))
            for k in range(start, middle, step):
                m, e = k - start, min(k + step, middle) - start
                d = np.bitwise_count(words[0, m:e, None] ^ words[0, m:]).astype(np.uint16)
                for w in range(1, SKETCH):
                    d += np.bitwise_count(words[w, m:e, None] ^ words[w, m:])
                i, j = np.nonzero(d <= allowed_difference(size[m:e, None], size[m:]))
                later = i < j
                if later.any():
                    yield self._found(k + i[later], k + j[later], True)


def _meet(folder: str | None):
    """Candidate pairs of a partition. The number of partitions follows the number of rows, and salts bound the rows of a key or word."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in stream if b.num_rows]
        if not batches:
            return
        part = _Part(batches, folder)
        found, held, n = np.zeros(0, np.int64), [], 0
        for p in part.pairs():
            held.append(p)
            n += len(p)
            if n > BLOCK:
                found, held, n = np.unique(np.concatenate([found, *held])), [], 0
        found = np.unique(np.concatenate([found, *held]))
        if len(found):
            a, b = part.ids[found >> 32], part.ids[found & 0xFFFFFFFF]
            order = np.lexsort((b, a))  # for the file that they are written to
            yield pa.RecordBatch.from_arrays([pa.array(a[order]), pa.array(b[order])], names=["a", "b"])

    return run


def _verify(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates whose window sets have at least half of their union in common."""
    segments = np.zeros(UNIVERSE, np.uint64)  # plain sets
    for b in stream:
        for k in range(0, b.num_rows, 4096):
            c = b.slice(k, 4096)
            one, two = Sets(c.column("seq_a").to_pylist(), segments), Sets(c.column("seq_b").to_pylist(), segments)
            both = np.concatenate([o.owner << SHIFT | o.token for o in (one, two)])
            both.sort()
            common = np.bincount(both[1:][both[1:] == both[:-1]] >> SHIFT, minlength=c.num_rows)
            ok = (3 * common >= one.size + two.size) & (common > 0)
            yield pa.RecordBatch.from_arrays(
                [c.column("a").filter(pa.array(ok)), c.column("b").filter(pa.array(ok)), pa.array(common[ok]), pa.array((one.size + two.size - common)[ok])],
                names=["a", "b", "common", "union"],
            )


def _numbered(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by text and read: each read once a text, the place of the text in the partition, and the text itself in its first row only."""
    part, i, text, read = TaskContext.get().partitionId(), -1, None, None
    for b in stream:
        if not b.num_rows:
            continue
        seq, reads = b.column("seq"), b.column("read_id")
        new = np.r_[seq[0].as_py() != text, pc.not_equal(seq[1:], seq[:-1]).to_numpy(zero_copy_only=False)]
        other = np.r_[reads[0].as_py() != read, pc.not_equal(reads[1:], reads[:-1]).to_numpy(zero_copy_only=False)]
        place = i + np.cumsum(new)
        i, text, read = int(place[-1]), seq[-1].as_py(), reads[-1].as_py()
        own = pc.if_else(pa.array(new), seq, pa.scalar(None, seq.type))
        kept = pa.RecordBatch.from_arrays([pa.array(np.full(len(new), part, np.int32)), pa.array(place), reads, b.column("whole"), own], names=["part", "i", "read_id", "whole", "seq"])
        yield kept.filter(pa.array(new | other))


def number_members(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(read_id, set_id, whole) and (set_id, seq) of ``texts(read_id, seq)``: distinct non-null texts of 9 letters or more,
    numbered 0, 1, 2 ... without gaps, and the reads that have them (whole: the text has a window without non-bases).

    Texts are shuffled once and written out once.
    """
    rows = texts.where((F.length("seq") >= K) & F.col("read_id").isNotNull()).select("read_id", F.col("seq").rlike("[ACGT]{9}").alias("whole"), "seq")
    rows = rows.repartition("seq").sortWithinPartitions("seq", "read_id")
    raw = stored(rows.mapInArrow(_numbered, "part INT, i BIGINT, read_id BIGINT, whole BOOLEAN, seq STRING"))
    counts = {r[0]: r[1] + 1 for r in raw.groupBy("part").agg(F.max("i")).collect()}  # one row a partition
    offsets = [0]
    for p in range(max(counts, default=0)):
        offsets.append(offsets[-1] + counts.get(p, 0))
    offset = F.element_at(F.array(*[F.lit(o).cast("bigint") for o in offsets]), F.col("part") + 1)
    numbered = raw.select("read_id", (offset + F.col("i")).alias("set_id"), "whole", "seq")
    return numbered.select("read_id", "set_id", "whole"), numbered.where(F.col("seq").isNotNull()).select("set_id", "seq")


def number_sequences(sequences: DataFrame) -> DataFrame:
    """(set_id, seq): distinct non-null sequences of 9 letters or more, numbered 0, 1, 2 ... without gaps; written out once."""
    return number_members(sequences.select(F.lit(0).cast("bigint").alias("read_id"), "seq"))[1]


def _shared_folder(spark: SparkSession) -> str | None:
    """A new folder below the shared one, if Python can open it there."""
    folder = f"{checkpoint_dir(spark)}/sketches-{uuid.uuid4()}"
    try:
        pa.fs.FileSystem.from_uri(folder)
    except (pa.ArrowException, OSError):
        return None
    return folder


def similar_pairs(numbered: DataFrame) -> DataFrame:
    """(a, b, common, union) for every pair of sequences of ``numbered(set_id, seq)`` whose sets of distinct
    9-base windows (windows with a non-base left out) have at least half of their union in common.

    Exact: no pair is lost, none is wrong. Sequences without windows are similar to none. Each pair comes
    once, in either order.
    """
    n, alone = np.zeros(UNIVERSE, np.int64), np.zeros(UNIVERSE, np.int64)
    counted = stored(numbered.mapInArrow(_frequencies, "token BIGINT, n BIGINT, alone BIGINT").groupBy("token").agg(F.sum("n"), F.sum("alone")))
    n_sets = lacking = 0
    for token, x, y in counted.collect():  # at most 4^9 + 1 rows
        if token == UNIVERSE:
            n_sets, lacking = x, y
        else:
            n[token], alone[token] = x, y
    dropped_table(counted)
    probed = np.zeros(UNIVERSE, bool)
    if lacking:
        windows = stored(numbered.mapInArrow(_probed(n), "token BIGINT").distinct())  # at most 4^9 rows
        probed[[r[0] for r in windows.collect()]] = True
        dropped_table(windows)
    # a set has about as many rows as windows
    parts = max(1, -(-int(n.sum() * 1.3) // PARTITION_ROWS), int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    folder = _shared_folder(numbered.sparkSession)
    rows = numbered.mapInArrow(_rows(n, alone, n_sets, probed, parts, folder), _BUNDLE)
    met = stored(rows.repartitionById(parts, F.col("part")).mapInArrow(_meet(folder), "a BIGINT, b BIGINT"), **DELTAS)
    pairs = stored(met.distinct())
    dropped_table(met)
    if folder:
        dropped(numbered.sparkSession, folder)
    one = numbered.select(F.col("set_id").alias("a"), F.col("seq").alias("seq_a"))
    two = numbered.select(F.col("set_id").alias("b"), F.col("seq").alias("seq_b"))
    texts = pairs.join(one, "a").join(two, "b").select("a", "b", "seq_a", "seq_b")
    return texts.mapInArrow(_verify, "a BIGINT, b BIGINT, common BIGINT, union BIGINT")
