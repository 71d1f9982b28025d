"""Filling fixed-capacity containers with texts measured in tokens, by a grouping genetic algorithm.

Items are spread over blocks of about BLOCK_ITEMS items by a hash, so every block sees the corpus's mix of
lengths and the work grows in proportion to the items. Each block is solved on several islands, each a small
population of packings. A child takes a packing, injects whole well-filled containers of another one,
drops its own containers that hold any of the same items, and puts the displaced items back by best fit,
longest first. After an epoch each island's elite migrates to the next island of its block (one small row
per island is shuffled); in the end the best packing of the block's islands is taken. Then the blocks give up
their emptiest containers, whose items form new blocks and are solved once more: what the cut into blocks
costs is made up for.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

CAPACITY = 2048
BLOCK_ITEMS = 2048
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
CHILDREN = 40  # per island and epoch
POOLED = 8  # every eighth container, the emptiest ones, is solved once more
# Fixed value: the public word pattern that belongs to byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _count_tokens(name: str, pattern: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in stream:
            n = [len(coder.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n"])

    return run


def token_counts(documents: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n): tokens of every non-empty text by the byte-level BPE whose ranks the driver's file ``path`` has.

    The file is shipped to the executors with the job.
    """
    documents.sparkSession.sparkContext.addFile(path)
    docs = documents.where(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_count_tokens(path.rsplit("/", 1)[-1], pattern), "doc_id BIGINT, n BIGINT")


class Packing:
    """Items' containers (0 ... n_bins - 1) and the containers' loads."""

    def __init__(self, bin_of: np.ndarray, sizes: np.ndarray) -> None:
        self.bin_of = np.unique(bin_of, return_inverse=True)[1]
        self.load = np.bincount(self.bin_of, sizes).astype(np.int64)

    def fitness(self, capacity: int) -> float:
        """Mean square of the fill: few, full containers beat many evenly filled ones."""
        return float(((self.load / capacity) ** 2).mean()) if len(self.load) else 1.0


def best_fit(bin_of: np.ndarray, sizes: np.ndarray, order: np.ndarray, capacity: int) -> None:
    """Puts the items of ``order`` (bin_of -1) into the fullest container with room, or a new one; changes ``bin_of``."""
    n = int(bin_of.max(initial=-1)) + 1
    placed = bin_of >= 0
    room = capacity - np.bincount(bin_of[placed], sizes[placed], n).astype(np.int64)
    used = np.unique(bin_of[placed])
    free = sorted(zip(room[used].tolist(), used.tolist()))
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        at = bisect_left(free, (size, -1))
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, n
            n += 1
        bin_of[i] = b
        if left > size:
            insort(free, (left - size, b))


def _by_size(items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return items[np.argsort(-sizes[items], kind="stable")]


def first_packings(sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> list[Packing]:
    """Best fit in descending order, and in orders that noise has disturbed."""
    out = []
    for i in range(POPULATION):
        noisy = sizes * (1 + 0.15 * i * rng.random(len(sizes))) if i else sizes
        bin_of = np.full(len(sizes), -1, np.int64)
        best_fit(bin_of, sizes, np.argsort(-noisy, kind="stable"), capacity)
        out.append(Packing(bin_of, sizes))
    return out


def crossover(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """``a`` with some well-filled containers of ``b`` injected whole; its emptiest containers are opened as well."""
    order = np.argsort(-b.load, kind="stable")
    good = order[: max(1, len(order) // 2)]
    inject = rng.choice(good, size=min(len(good), int(rng.integers(1, 17))), replace=False)
    injected = np.isin(b.bin_of, inject)
    hit = np.zeros(len(a.load), bool)
    hit[a.bin_of[injected]] = True
    worst = np.argsort(a.load, kind="stable")[: int(rng.integers(1, 5))]
    hit[worst] = True
    bin_of = np.where(hit[a.bin_of], -1, a.bin_of)
    bin_of[injected] = len(a.load) + b.bin_of[injected]
    best_fit(bin_of, sizes, _by_size(np.flatnonzero(bin_of < 0), sizes), capacity)
    return Packing(bin_of, sizes)


def evolve(population: list[Packing], sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> list[Packing]:
    """CHILDREN generations; a child that is no worse replaces the worst of the population. Best first."""
    ranked = sorted(population, key=lambda p: -p.fitness(capacity))
    for _ in range(CHILDREN):
        if len(ranked) < 2 or not len(sizes):
            break
        i, j = rng.choice(len(ranked), 2, replace=False)
        ranked.append(crossover(ranked[min(i, j)], ranked[max(i, j)], sizes, capacity, rng))
        ranked = sorted(ranked, key=lambda p: -p.fitness(capacity))[:POPULATION]
    return ranked


def _islands(capacity: int, epoch: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            rows = b.to_pydict()
            out = []
            for block, island, sizes, population, elite in zip(rows["block"], rows["island"], rows["sizes"], rows["population"], rows["elite"]):
                sizes = np.asarray(sizes, np.int64)
                rng = np.random.default_rng([block & 0xFFFFFFFF, island, epoch])
                if population is None:
                    packings = first_packings(sizes, capacity, rng)
                else:
                    packings = [Packing(np.asarray(p), sizes) for p in population]
                    if elite is not None:
                        packings[-1] = Packing(np.asarray(elite), sizes)
                packings = evolve(packings, sizes, capacity, rng)
                out.append([p.bin_of.tolist() for p in packings])
            best = [p[0] for p in out]
            fit = [Packing(np.asarray(p), np.asarray(s, np.int64)).fitness(capacity) for p, s in zip(best, rows["sizes"])]
            yield pa.RecordBatch.from_pydict(
                {"block": rows["block"], "island": rows["island"], "items": rows["items"], "sizes": rows["sizes"], "population": out, "best": best, "fitness": fit},
                schema=_STATE,
            )

    return run


_LIST, _LISTS = pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))
_STATE = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("items", _LIST), ("sizes", _LIST), ("population", _LISTS), ("best", _LIST), ("fitness", pa.float64())])
_STATE_SQL = "block BIGINT, island INT, items ARRAY<BIGINT>, sizes ARRAY<BIGINT>, population ARRAY<ARRAY<BIGINT>>, best ARRAY<BIGINT>, fitness DOUBLE"


def _solved(items: DataFrame, n_items: int, capacity: int, epochs: int, islands: int) -> DataFrame:
    """(item, n_tokens, block, bin, load) of ``items(item, n_tokens)``: each block's best packing."""
    blocks = max(1, -(-n_items // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks).cast("bigint"))
    held = F.array_sort(F.collect_list(F.struct("item", "n_tokens")))  # a block: bounded, whatever the texts
    state = items.groupBy(block.alias("block")).agg(held.alias("x")).select(
        "block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.col("x.item").alias("items"), F.col("x.n_tokens").alias("sizes"),
        F.lit(None).cast("array<array<bigint>>").alias("population"), F.lit(None).cast("array<bigint>").alias("elite"),
    )
    for epoch in range(epochs):
        # as many tasks as there are cores, not as bytes: the state is small and the work on it isn't
        spread = state.repartition(min(blocks * islands, _slots(items) * 3), "block", "island")
        evolved = cut(spread.mapInArrow(_islands(capacity, epoch), _STATE_SQL))
        elites = evolved.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("best").alias("elite"))
        state = evolved.join(elites, ["block", "island"])
    best = evolved.groupBy("block").agg(F.max_by(F.struct("items", "sizes", "best"), F.struct("fitness", -F.col("island"))).alias("b"))
    spots = best.select("block", F.explode(F.arrays_zip("b.items", "b.sizes", "b.best")).alias("p"))
    spots = spots.select("block", F.col("p.items").alias("item"), F.col("p.sizes").alias("n_tokens"), F.col("p.best").alias("bin"))
    loads = spots.groupBy("block", "bin").agg(F.sum("n_tokens").alias("load"))
    return spots.join(loads, ["block", "bin"])


def pack(counts: DataFrame, capacity: int = CAPACITY, epochs: int = EPOCHS, islands: int = ISLANDS) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container, position) of ``counts(doc_id, n)``.

    A text is split only if it is longer than a container, into full pieces and a rest (pieces are
    numbered from 0, ``first_token`` says where each begins). A full piece is a container of its own
    (negative number); containers never hold more than ``capacity`` tokens, and every piece is in
    exactly one. Texts without tokens (null, empty) get no row; an empty table gives none.
    """
    n, c = F.col("n"), F.lit(capacity).cast("bigint")
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / c).cast("bigint") - 1)).alias("piece")
    cut_up = counts.where(n > 0).select("doc_id", "n", piece).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * c).alias("first_token"), F.least(c, n - F.col("piece") * c).alias("n_tokens")
    )
    pieces = cut(cut_up.withColumn("item", F.monotonically_increasing_id()))  # numbered once and for all
    full, rest = pieces.where(F.col("n_tokens") == c), pieces.where(F.col("n_tokens") < c)
    first = _solved(rest.select("item", "n_tokens"), rest.count(), capacity, epochs, islands)
    # a block's containers: bounded; the emptiest ones give up their items
    by_load = W.partitionBy("block").orderBy("load", "bin")
    bins = first.select("block", "bin", "load").distinct().withColumn("nth", F.row_number().over(by_load))
    bins = bins.withColumn("again", F.col("nth") * POOLED <= F.max("nth").over(W.partitionBy("block")) + POOLED - 1).select("block", "bin", "again")
    first = cut(first.join(bins, ["block", "bin"]))
    kept, pool = first.where(~F.col("again")), first.where("again").select("item", "n_tokens")
    second = _solved(pool, pool.count(), capacity, epochs, islands)
    number = (F.col("block") * (1 << 20) + F.col("bin")) * 2
    placed = kept.select("item", number.alias("container")).unionByName(second.select("item", (number + 1).alias("container"))).join(rest, "item")
    ordered = placed.groupBy("container").agg(F.sort_array(F.collect_list(F.struct("n_tokens", "doc_id", "piece", "first_token")), asc=False).alias("x"))
    rows = ordered.select("container", F.posexplode("x").alias("position", "p")).select("p.*", "container", "position")
    cols = ["doc_id", "piece", "first_token", "n_tokens", "container", "position"]
    alone = full.select("doc_id", "piece", "first_token", "n_tokens", (-1 - F.col("item")).alias("container"), F.lit(0).alias("position"))
    return rows.select(*cols).unionByName(alone.select(*cols))


def _slots(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)
