"""Colored k-mer graphs as two relations: genomes(genome_id, genome_name) and kmer_colors(kmer, genome_id)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.colors import encode
from ..session import fits
from ..sources import readers

REGISTRY_BYTES = 16 << 20  # names of at most that size are sent to all tasks
GENOMES, COLORS = "genome_id INT, genome_name STRING", "kmer STRING, genome_id INT"


def valid_k(k: int, strict: bool = False) -> int:
    """k from 1 to 126; ``strict`` asks for a multiple of 9 as well."""
    if not 1 <= k <= 126 or (strict and k % 9):
        raise ValueError(f"k = {k}: from 1 to 126" + ", a multiple of 9" * strict)
    return k


def registry(names: DataFrame) -> DataFrame:
    """genomes of ``names(genome_name)``: ids 0, 1, ... in the order of the names. One row a genome is sorted, no more."""
    distinct = names.where(F.col("genome_name").isNotNull()).select("genome_name").distinct()
    return distinct.select((F.row_number().over(W.orderBy("genome_name")) - 1).alias("genome_id"), "genome_name")


def window_rows(sequences: DataFrame, k: int, *keep: str) -> DataFrame:
    """(keep..., kmer): every k-letter window of ``seq`` without a non-base; shorter and null texts have none."""
    out = sequences.select(*keep, F.explode(codec.kmers(F.col("seq"), k)).alias("kmer"))
    return out.where(codec.is_kmer(F.col("kmer"), k))


@dataclass(frozen=True)
class ColoredGraph:
    """An immutable graph; every change gives a new one."""

    k: int
    genomes: DataFrame
    kmer_colors: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, k: int, strict: bool = False) -> ColoredGraph:
        return cls(valid_k(k, strict), spark.createDataFrame([], GENOMES), spark.createDataFrame([], COLORS))

    @classmethod
    def from_sequences(cls, sequences: DataFrame, k: int) -> ColoredGraph:
        """From ``sequences(genome_name, seq)``: one distinct, combined on the map side, is the only large shuffle."""
        genomes = registry(sequences)
        small = F.broadcast(genomes) if fits(genomes, "genome_name", REGISTRY_BYTES) else genomes
        rows = sequences.join(small, "genome_name")
        return cls(valid_k(k), genomes, window_rows(rows, k, "genome_id").select("kmer", "genome_id").distinct())

    def n_genomes(self) -> int:
        return self.genomes.count()

    def meta(self) -> DataFrame:
        return self.genomes.agg(F.lit(self.k).alias("k"), F.count(F.lit(1)).cast("int").alias("n_genomes"))

    def kmers(self) -> DataFrame:
        """(kmer, colors, n_colors). The array's length is bounded by the number of genomes."""
        sets = self.kmer_colors.groupBy("kmer").agg(F.array_sort(F.collect_set("genome_id")).alias("colors"))
        return sets.withColumn("n_colors", F.size("colors"))

    def counts(self) -> DataFrame:
        """(kmer, n_colors) without the arrays."""
        return self.kmer_colors.groupBy("kmer").agg(F.count(F.lit(1)).cast("int").alias("n_colors"))

    def vertices(self) -> DataFrame:
        return self.kmer_colors.select("kmer").distinct()

    def _checked(self, kmers: DataFrame) -> DataFrame:
        """K-mers in bases; an invalid one raises when it is read."""
        b = codec.bases(F.col("kmer"))
        wrong = F.raise_error(F.concat(F.lit(f"not a {self.k}-mer: "), F.coalesce(F.col("kmer"), F.lit("null"))))
        return kmers.select(F.when(F.coalesce(codec.is_kmer(b, self.k), F.lit(False)), b).otherwise(wrong).alias("kmer"))

    def _with(self, genomes: DataFrame, colors: DataFrame) -> ColoredGraph:
        return replace(self, genomes=self.genomes.unionByName(genomes), kmer_colors=self.kmer_colors.unionByName(colors).distinct())

    def _next_id(self) -> int:
        last = self.genomes.agg(F.max("genome_id")).first()[0]
        return 0 if last is None else last + 1

    def add_genome(self, name: str, kmers: DataFrame) -> ColoredGraph:
        """Registers a genome (also one without k-mers) and inserts its ``kmers(kmer)``; invalid ones raise."""
        i = self._next_id()
        spark = self.genomes.sparkSession
        return self._with(spark.createDataFrame([(i, name)], GENOMES), self._checked(kmers).select("kmer", F.lit(i).alias("genome_id")))

    def extend_last_genome(self, kmers: DataFrame) -> ColoredGraph:
        """Inserts k-mers into the genome that was registered last; a graph without genomes raises."""
        if (i := self._next_id() - 1) < 0:
            raise ValueError("the graph has no genome")
        return replace(self, kmer_colors=self.kmer_colors.unionByName(self._checked(kmers).select("kmer", F.lit(i).alias("genome_id"))).distinct())

    def add_files(self, paths: list[str], packed: bool = False) -> ColoredGraph:
        """One genome a file in the order of the list, named by its base name; invalid lines are skipped."""
        first, spark = self._next_id(), self.genomes.sparkSession
        graph = self
        for i, path in enumerate(paths):
            rows = (readers.kmer_packed if packed else readers.kmer_text)(spark, path, self.k)
            new = spark.createDataFrame([(first + i, path.rstrip("/").rsplit("/", 1)[-1])], GENOMES)
            colors = rows.select("kmer", F.lit(first + i).alias("genome_id"))
            graph = replace(graph, genomes=graph.genomes.unionByName(new), kmer_colors=graph.kmer_colors.unionByName(colors))
        return replace(graph, kmer_colors=graph.kmer_colors.distinct())

    def add_colors(self, kmers: DataFrame, ids: list[int]) -> ColoredGraph:
        """Adds genome ids to k-mers; an id that isn't registered raises."""
        known = {r.genome_id for r in self.genomes.where(F.col("genome_id").isin(ids)).collect()}
        if missing := set(ids) - known:
            raise ValueError(f"genomes that aren't registered: {sorted(missing)}")
        rows = self._checked(kmers).select("kmer", F.explode(F.array(*[F.lit(i) for i in ids])).alias("genome_id"))
        return replace(self, kmer_colors=self.kmer_colors.unionByName(rows).distinct())

    def merge(self, other: ColoredGraph) -> ColoredGraph:
        """Appends the other graph's genomes; its first genome is shared if it is named as this graph's last one."""
        if self.k != other.k:
            raise ValueError("graphs of different k")
        last = self.genomes.orderBy(F.desc("genome_id")).first()
        first = other.genomes.orderBy("genome_id").first()
        shared = last is not None and first is not None and last.genome_name == first.genome_name
        shift = self._next_id() - (1 if shared else 0) - (first.genome_id if first else 0)
        moved = (F.col("genome_id") + shift).cast("int").alias("genome_id")
        new = other.genomes.select(moved, "genome_name")
        if shared:
            new = new.where(F.col("genome_id") > last.genome_id)
        return self._with(new, other.kmer_colors.select("kmer", moved))

    def subset(self, kmers: DataFrame, with_colors: bool = True) -> ColoredGraph:
        """Graph of chosen k-mers: colors copied and all genomes kept, or a single genome 0 with the first name."""
        if with_colors:
            return replace(self, kmer_colors=self.kmer_colors.join(kmers.select("kmer").distinct(), "kmer", "left_semi"))
        first = self.genomes.orderBy("genome_id").limit(1).select(F.lit(0).alias("genome_id"), "genome_name")
        return replace(self, genomes=first, kmer_colors=self._checked(kmers).distinct().select("kmer", F.lit(0).alias("genome_id")))

    def covering(self, ids: list[int]) -> DataFrame:
        """(kmer) whose color set holds all ids: counted per k-mer, no arrays."""
        if not ids:
            return self.vertices().limit(0)
        hits = self.kmer_colors.where(F.col("genome_id").isin(ids)).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
        return hits.where(F.col("n") == len(set(ids))).select("kmer")

    def color_dictionary(self) -> tuple[DataFrame, DataFrame]:
        """(color_id, colors, n_kmers) of the distinct color sets, and (kmer, color_id): a star schema. Ids have 128 bits."""
        sets = self.kmers()
        ident = F.md5(F.array_join("colors", ",")).alias("color_id")
        dictionary = sets.groupBy(ident, "colors").agg(F.count(F.lit(1)).alias("n_kmers"))
        return dictionary, sets.select("kmer", ident)

    def statistics(self) -> DataFrame:
        """Number of k-mers, (kmer, genome) pairs, genomes with k-mers and the largest color set."""
        c = self.counts().agg(F.count(F.lit(1)).alias("n_kmers"), F.coalesce(F.sum("n_colors"), F.lit(0)).alias("n_pairs"), F.coalesce(F.max("n_colors"), F.lit(0)).alias("largest_set"))
        return c.select("n_kmers", F.col("n_pairs").cast("bigint").alias("n_pairs"), "largest_set", F.lit(self.k).alias("k"))

    def color_bytes(self) -> DataFrame:
        """Bytes of all color sets in their shortest encodings, one a k-mer and one a distinct set."""
        sized = self.color_dictionary()[0].select("n_kmers", F.octet_length(encode(F.col("colors"))).cast("bigint").alias("n"))
        return sized.agg(F.coalesce(F.sum(F.col("n") * F.col("n_kmers")), F.lit(0)).alias("per_kmer"), F.coalesce(F.sum("n"), F.lit(0)).alias("per_set"))

    def map_kmers(self, f: Callable, schema: str) -> DataFrame:
        """``f`` over batches of (kmer, colors, n_colors), as pandas frames."""
        return self.kmers().mapInPandas(f, schema)

    def save(self, folder: str) -> None:
        """Genomes, meta and the pairs, ranged and sorted by k-mer so that prefixes and points prune row groups."""
        self.genomes.write.mode("overwrite").parquet(f"{folder}/genomes")
        self.meta().write.mode("overwrite").parquet(f"{folder}/meta")
        self.kmer_colors.repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{folder}/kmer_colors")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> ColoredGraph:
        k = spark.read.parquet(f"{folder}/meta").first().k
        return cls(k, spark.read.parquet(f"{folder}/genomes"), spark.read.parquet(f"{folder}/kmer_colors"))


def prefix_match(kmers: DataFrame, prefix: str, k: int) -> DataFrame:
    """K-mers that start with a prefix of 1 to k bases (pushed down to the scan as a range); anything else raises."""
    p = prefix.upper().replace("U", "T")
    if not 1 <= len(p) <= k or set(p) - set("ACGT"):
        raise ValueError(f"prefix {prefix!r}: from 1 to {k} bases")
    return kmers.where(F.col("kmer").startswith(p))


def prefix_page(kmers: DataFrame, prefix: str, k: int, n: int, after: str | None = None) -> DataFrame:
    """The next ``n`` k-mers that start with a prefix, in order, behind ``after``: the last one of a page resumes the walk."""
    rows = prefix_match(kmers, prefix, k)
    rows = rows if after is None else rows.where(F.col("kmer") > after)
    return rows.orderBy("kmer").limit(n)


def with_marks(kmers: DataFrame) -> DataFrame:
    """State (kmer, flag) with all flags 0."""
    return kmers.select("kmer", F.lit(0).cast("tinyint").alias("flag"))


def set_marks(state: DataFrame, marked: DataFrame, flag: int) -> DataFrame:
    """New state in which the k-mers of ``marked`` have the flag (0 to 3)."""
    if flag not in range(4):
        raise ValueError("flags are 0, 1, 2 and 3")
    hit = marked.select("kmer").distinct().withColumn("hit", F.lit(True))
    return state.join(hit, "kmer", "left").select("kmer", F.when(F.col("hit"), F.lit(flag).cast("tinyint")).otherwise(F.col("flag")).alias("flag"))


def mark_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def core(counts: DataFrame, n_genomes: int | Column) -> DataFrame:
    """K-mers of all genomes."""
    return counts.where(F.col("n_colors") == n_genomes)


def dispensable(counts: DataFrame, n_genomes: int | Column) -> DataFrame:
    """K-mers that some genome lacks; those of a single genome are among them."""
    return counts.where(F.col("n_colors") < n_genomes)


def singleton(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("n_colors") == 1)


def spectrum(counts: DataFrame) -> DataFrame:
    """(n_colors, n_kmers): how many k-mers are in how many genomes."""
    return counts.groupBy("n_colors").agg(F.count(F.lit(1)).alias("n_kmers"))
