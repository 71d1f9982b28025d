"""Non-branching paths of all windows of texts: contracted where windows meet, then joined at the borders.

A window (k letters) stands at two (k-1)-mers. Runs of neighbouring (k-1)-mers whose least word is the same go to one
bucket as packed letters, with the windows at both sides; so a bucket has all windows at its (k-1)-mers, and numpy
chains them there. Only windows between two buckets (one in some eight) and the pieces that end at them are joined in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .search import Form
from .traverse import _ranked

WORD = 9  # letters of the words that choose a bucket
SLICE = 2 << 20  # bytes of text that a task reads, and letters that it cuts into runs, at once
BUCKET_BYTES = 4 << 20  # bytes of text a bucket: what a task contracts at once
WINDOWS = 2 << 20  # windows that are held before they are made distinct
CODES = np.full(256, 4, np.uint8)
CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)
PROJECTED = CODES.copy()
PROJECTED[np.frombuffer(b"acgt", np.uint8)] = range(4)
LETTERS = np.frombuffer(b"ACGT", np.uint8)


def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """The number of every n letters of a row of letters (0 to 3), n at most 31."""

    def wide(x: np.ndarray, letters: int) -> np.ndarray:
        return x.astype(np.uint8 if letters <= 4 else np.uint16 if letters <= 8 else np.uint32 if letters <= 16 else np.uint64, copy=False)

    size = max(0, len(codes) - n + 1)
    out, have, power, at = None, 0, codes, 1
    while True:
        if n & at:
            if out is None:
                out = power
            else:  # power is put in front of what there is
                m = min(len(power), len(out) - at)
                out = (wide(power[:m], have + at) << (2 * have)) | wide(out[at : at + m], have + at)
            have += at
        if 2 * at > n:
            return out[:size].astype(np.uint64)
        power = (wide(power[:-at], 2 * at) << (2 * at)) | wide(power[at:], 2 * at)
        at *= 2


def _places(codes: np.ndarray, k: int, buckets: int) -> np.ndarray:
    """The bucket of every (k-1)-mer: by the least hash of its words."""
    m = min(WORD, k - 1)
    h = _rolled(codes, m).astype(np.uint32) * np.uint32(0x9E3779B1)
    h = (h ^ (h >> 15)) * np.uint32(0x85EBCA77)
    h ^= h >> 13
    words, span = k - m, 1
    n = len(codes) - k + 2
    while 2 * span <= words:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    h = np.minimum(h[:n], h[words - span : words - span + n])
    return (((h * np.uint32(0xC2B2AE3D)) >> 5) % np.uint32(buckets)).astype(np.int32)


def _runs(codes: np.ndarray, k: int, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, lengths, letters) of runs of (k-1)-mers of a row of letters in which 4 parts texts.

    A length is followed by two bits: whether the first window's first (k-1)-mer, and the last one's second, are in other buckets.
    """
    if len(codes) < k:
        return
    broken = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(codes > 3, out=broken[1:])
    codes = codes & 3
    window = broken[k:] == broken[:-k]
    mid = broken[k - 1 :] == broken[: -(k - 1)]
    place = _places(codes, k, buckets)
    on = window & (place[1:] == place[:-1])  # the next (k-1)-mer is in the same run
    s = np.flatnonzero(mid & np.concatenate([[True], ~on]))
    e = np.flatnonzero(mid & np.concatenate([~on, [True]]))
    around = np.concatenate([[False], window, [False]])
    left, right = around[s], around[e + 1]
    kept = e - s + left + right > 0
    s, e, left, right = s[kept], e[kept], left[kept], right[kept]
    order = np.argsort(place[s], kind="stable")
    s, e, left, right = s[order], e[order], left[order], right[order]
    here = place[s]
    lengths = e - s + (k - 1) + left + right
    heads = (lengths << 2 | left << 1 | right).astype(np.uint32)
    ends = np.cumsum(lengths)
    first = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]])) if len(here) else []
    for i, j in zip(first, [*first[1:], len(here)]):
        n = lengths[i:j]
        base = ends[i] - lengths[i]
        at = np.arange(ends[j - 1] - base) + np.repeat(s[i:j] - left[i:j] - (ends[i:j] - n - base), n)
        c = codes[at]
        c = np.concatenate([c, np.zeros(-len(c) % 4, np.uint8)])
        yield int(here[i]), heads[i:j].tobytes(), (c[::4] << 6 | c[1::4] << 4 | c[2::4] << 2 | c[3::4]).tobytes()


def _spread(k: int, buckets: int, project: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of texts, runs by bucket. With ``project`` letters other than ACGT (in either case) are left out, else they part the text."""

    def codes_of(batch: pa.RecordBatch) -> np.ndarray:
        texts = batch.column(0).drop_null().cast(pa.large_binary())
        if not len(texts):
            return np.zeros(0, np.uint8)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        codes = (PROJECTED if project else CODES)[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
        at = at[:-1] - at[0]
        if project:
            kept = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(codes < 4, out=kept[1:])
            codes, at = codes[codes < 4], kept[at]
        return np.insert(codes, at, np.uint8(4))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            codes = np.concatenate(held)
            for i in range(0, len(codes), SLICE):  # every window begins in one slice; a slice's last (k-1)-mer is the next one's first
                if rows := list(_runs(codes[i : i + SLICE + k - 1], k, buckets)):
                    place, lengths, letters = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(lengths, pa.binary()), pa.array(letters, pa.binary())], names=["place", "lengths", "letters"])

        held, n = [], 0
        for batch in stream:
            rows = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, rows):
                held.append(codes_of(batch.slice(i, rows)))
                n += len(held[-1])
                if n >= SLICE:
                    yield from cut(held)
                    held, n = [], 0
        if n:
            yield from cut(held)

    return run


def _windows(lengths: bytes, letters: bytes, k: int) -> np.ndarray:
    """Windows of runs, each followed by two bits: whether its first and its second (k-1)-mer are in this bucket."""
    heads = np.frombuffer(lengths, np.uint32)
    n = (heads >> 2).astype(np.int64)
    packed = np.frombuffer(letters, np.uint8)
    codes = np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).reshape(-1)[: n.sum()]
    starts = np.cumsum(n) - n
    last = starts + n - k
    edge = np.zeros(len(codes) + 1, np.int8)
    edge[starts] = 1
    edge[last + 1] = -1
    here = np.full(len(codes), 3, np.uint8)
    here[starts[(heads & 2) > 0]] &= 1
    here[last[(heads & 1) > 0]] &= 2
    size = len(codes) - k + 1
    inside = np.cumsum(edge, dtype=np.int8)[:size] > 0
    return _rolled(codes, k)[inside] << 2 | here[:size][inside]


def _chained(pred: np.ndarray, succ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(head, dist) of vertices with predecessors and successors (-1: none); a cycle begins at its least vertex."""
    ptr, dist = np.where(pred >= 0, pred, np.arange(len(pred))), (pred >= 0).astype(np.int64)
    open_ = np.flatnonzero(pred[ptr] >= 0)
    while len(open_):
        p = ptr[open_]
        to, d = ptr[p], dist[open_] + dist[p]
        ptr[open_], dist[open_] = to, d
        left = open_[pred[to] >= 0]
        if len(left) == len(open_):  # only cycles are left
            break
        open_ = left
    seen: set[int] = set()
    for v in open_.tolist():
        if v not in seen:  # in rising order: the first of a cycle is its least
            at, d = v, 0
            while at not in seen:
                seen.add(at)
                ptr[at], dist[at] = v, d
                at, d = int(succ[at]), d + 1
    return ptr, dist


def _pieces(keys: np.ndarray, k: int) -> pa.Table:
    """(id, opens, last, text, kind): a bucket's chains (kind 0), and its border windows that stand alone (1) or branch here (2).

    A chain is named by its first window; ``opens`` tells that this is a border window, ``last`` is the last one if that is.
    """
    v, has_head, has_tail = keys >> 2, (keys & 2) > 0, (keys & 1) > 0
    hi, ti = np.flatnonzero(has_head), np.flatnonzero(has_tail)
    heads, tails = v[hi] >> 2, v[ti] & np.uint64((1 << 2 * (k - 1)) - 1)
    order = np.argsort(tails, kind="stable")
    ti, tails = ti[order], tails[order]
    lo = np.searchsorted(heads, tails)
    out = np.searchsorted(heads, tails, "right") - lo
    ins = np.searchsorted(tails, heads, "right") - np.searchsorted(tails, heads)
    bad = np.zeros(len(v), bool)
    bad[hi[ins > 1]] = True
    bad[ti[out > 1]] = True
    u, w = ti[out == 1], hi[lo[out == 1]]
    fine = ~bad[u] & ~bad[w]
    u, w = u[fine], w[fine]
    good = np.flatnonzero(~bad)
    rank = np.cumsum(~bad) - 1
    pred, succ = np.full(len(good), -1), np.full(len(good), -1)
    pred[rank[w]], succ[rank[u]] = rank[u], rank[w]
    head, dist = _chained(pred, succ)
    order = np.lexsort((dist, head))
    vs, dist = good[order], dist[order]
    first = np.flatnonzero(dist == 0)
    size = np.diff(np.append(first, len(vs)))
    a, b = vs[first], vs[first + size - 1]
    alone = (size == 1) & ~(has_head[a] & has_tail[a])
    # texts: all letters of the first window, and the last one of each further window
    kept = ~alone
    start = np.cumsum(np.where(kept, size + k - 1, 0)) - np.where(kept, size + k - 1, 0)
    text = np.empty(int((size[kept] + k - 1).sum()), np.uint8)
    for i in range(k - 1):
        text[start[kept] + i] = LETTERS[v[a[kept]] >> np.uint64(2 * (k - 1 - i)) & np.uint64(3)]
    each = np.repeat(kept, size)
    text[(np.repeat(start, size) + dist)[each] + k - 1] = LETTERS[v[vs[each]] & np.uint64(3)]
    offsets = np.append(start[kept], len(text)).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(int(kept.sum()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes())).cast(pa.string())
    number = lambda x: pa.array(v[x].astype(np.int64))
    a, b = a[kept], b[kept]
    names = ["id", "opens", "last", "text", "kind"]
    chains = pa.table([number(a), pa.array(~has_head[a]), pa.array(v[b].astype(np.int64), mask=has_tail[b]), texts, pa.array(np.zeros(len(a), np.int8))], names)
    lone, branching = vs[first[alone]], np.flatnonzero(bad & ~(has_head & has_tail))
    kinds = np.repeat(np.array([1, 2], np.int8), [len(lone), len(branching)])
    n = len(kinds)
    marks = pa.table([number(np.append(lone, branching)), pa.array(np.zeros(n, bool)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(kinds)], names)
    return pa.concat_tables([chains, marks])


def _bucket(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        whole, held, n = np.zeros(0, np.uint64), [], 0
        for lengths, letters in zip(rows.column("lengths"), rows.column("letters")):
            held.append(_windows(lengths.as_py(), letters.as_py(), k))
            n += len(held[-1])
            if n >= max(WINDOWS, len(whole)):
                whole, held, n = np.unique(np.concatenate([whole, *held])), [], 0
        return _pieces(np.unique(np.concatenate([whole, *held])), k)

    return run


def sequence_paths(sequences: DataFrame, k: int, project: bool = False) -> DataFrame:
    """(path, n_kmers): maximal chains of non-branching windows of ``sequences(seq)``, k from 2 to 31.

    A cycle is one path that begins at its least k-mer. With ``project`` the texts are any; their letters A, C, G and T
    (in either case) are read as one sequence, else other letters part it. A path's text is one row.
    """
    if not 2 <= k <= 31:
        raise ValueError(f"k = {k}: from 2 to 31")
    form, seq = Form(k), sequences.select("seq")
    n_bytes = seq.agg(F.sum(F.octet_length("seq"))).first()[0] or 0
    runs = seq.mapInArrow(_spread(k, 1 + n_bytes // BUCKET_BYTES, project), "place INT, lengths BINARY, letters BINARY")
    found = stored(runs.groupBy("place").applyInArrow(_bucket(k), "id BIGINT, opens BOOLEAN, last BIGINT, text STRING, kind TINYINT"))
    c, no, piece = F.col, F.lit(None).cast("bigint"), F.col("kind") == 0
    whole = found.where(piece & ~c("opens") & c("last").isNull()).select("text")
    # each border window has a row from either bucket
    at = lambda v, p, q, bad: F.struct(v.alias("v"), p.alias("p"), q.alias("q"), bad.alias("bad"))
    yes, not_ = F.lit(True), F.lit(False)
    sides = F.array(F.when(~piece | c("opens"), at(c("id"), no, piece, c("kind") == 2)), F.when(c("last").isNotNull(), at(c("last"), c("id"), not_, not_)))
    border = found.select(F.explode(F.array_compact(sides)).alias("x")).select("x.*").groupBy("v").agg(F.max("p").alias("p"), F.max("q").alias("q"), F.max("bad").alias("bad"))
    # what the pieces hear: who comes before, which end branches (1, 2), that another follows (4), that the window is a path (8)
    told = lambda i, pred, bits: F.struct(i.alias("id"), pred.alias("pred"), F.lit(bits).alias("bits"))
    before, behind = c("p").isNotNull(), c("q")
    news = F.array(
        F.when(c("bad") & behind, told(c("v"), no, 1)), F.when(c("bad") & before, told(c("p"), no, 2)), F.when(~c("bad") & before & behind, told(c("v"), c("p"), 0)),
        F.when(~c("bad") & before & behind, told(c("p"), no, 4)), F.when(~c("bad") & ~before & ~behind, told(c("v"), no, 8)),
    )
    heard = border.select(F.explode(F.array_compact(news)).alias("x")).select("x.*").groupBy("id").agg(F.max("pred").alias("pred"), F.bit_or("bits").alias("bits"))
    ends = found.where(piece & (c("opens") | c("last").isNotNull())).select("id", "text").join(heard.hint("merge"), "id", "full").withColumn("bits", F.coalesce("bits", F.lit(0)))
    bit = lambda b: F.when(c("bits").bitwiseAND(F.lit(b)) > 0, F.lit(1)).otherwise(F.lit(0))
    text = F.coalesce(c("text"), form.text(c("id")))
    text = F.substring(text, F.lit(1) + bit(1), F.length(text) - bit(1) - bit(2))
    pieces = stored(ends.select("id", text.alias("text"), "pred", (bit(4) > 0).alias("followed")).where(F.length("text") >= k))
    linked = c("pred").isNotNull() | c("followed")
    ranked = _ranked(stored(pieces.where(linked).select(c("id").alias("v"), "pred")))
    steps = pieces.where(linked).select(c("id").alias("v"), "text").join(ranked.hint("merge"), "v")
    # the texts behind the head's without what they share with the one before
    part = F.struct("dist", F.when(c("dist") == 0, c("text")).otherwise(F.substring(c("text"), F.lit(k + 1), F.length("text"))).alias("t"))
    joined = steps.groupBy("head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "").alias("text"))
    # pieces of a cycle end with the window that they begin with: it counts once, and the least one stands first
    n = F.length("text") - (k - 1)
    ring = (n > 1) & (F.substring("text", 1, k) == F.substring("text", -k, k))
    least = F.array_min(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.substring(c("text"), i, F.lit(k)).alias("kmer"), i.alias("i"))))["i"]
    turned = F.substring(F.concat(c("text"), F.substring(c("text"), F.lit(k + 1), n - 1)), least, F.length("text") - 1)
    joined = joined.select(F.when(ring, turned).otherwise(c("text")).alias("text"))
    return whole.unionByName(pieces.where(~linked).select("text")).unionByName(joined).select(c("text").alias("path"), n.alias("n_kmers"))
