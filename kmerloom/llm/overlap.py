"""Overlap sizes between many sets by coordinated identifier sampling.

All sets keep the identifiers whose hash lies below one common threshold, so an identifier is kept by
every set that holds it or by none; co-occurrences among kept identifiers, divided by the sampling
rate, estimate the sizes of the intersections without building any of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 0.25  # share of all identifiers to keep; the relative error of an overlap c is about sqrt((1 - rate) / (c * rate))


def identifier_sets(kmers: DataFrame) -> DataFrame:
    """(graph_id, ident, sets ARRAY<INT>): one row per distinct identifier with its sets, sorted, without repeats.

    Rows with a null k-mer or no sets are left out; rows written twice count once (their sets are united).
    """
    ident = F.translate(F.upper("kmer"), "U", "T")
    rows = kmers.where(F.col("kmer").isNotNull()).select(
        "graph_id", ident.alias("ident"), F.array_sort(F.array_distinct(F.array_compact("colors"))).alias("sets")
    ).where(F.size("sets") > 0).distinct()
    same = rows.groupBy("graph_id", "ident").agg(F.collect_set("sets").alias("all"))
    return same.select("graph_id", "ident", F.array_sort(F.array_distinct(F.flatten("all"))).alias("sets"))


def rate_for(overlap: float, error: float) -> float:
    """The rate at which an overlap of that size gets that relative standard error."""
    return min(1.0, 1 / (1 + overlap * error * error))


def sampled(ids: DataFrame, rate: float) -> DataFrame:
    """Identifiers whose 64-bit hash lies below the common threshold."""
    if rate >= 1:
        return ids
    return ids.where(F.xxhash64("graph_id", "ident") < F.lit(-(2**63) + math.floor(rate * 2**64)))


def _pairs(sets: Column) -> Column:
    """All (a, b), a < b, of a sorted array of set ids: the answer's own cells, combined on the map side; sets, not identifiers, bound their number."""
    return F.flatten(
        F.transform(sets, lambda a: F.transform(F.filter(sets, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )


def cooccurrences(ids: DataFrame) -> DataFrame:
    """(a, b, n): per pair of sets the number of identifiers in both; counted on the map side first."""
    return ids.where(F.size("sets") > 1).select(F.explode(_pairs(F.col("sets"))).alias("ab")).groupBy(
        F.col("ab.a").alias("a"), F.col("ab.b").alias("b")
    ).agg(F.count(F.lit(1)).alias("n"))


def set_sizes(ids: DataFrame) -> DataFrame:
    """(s, size): distinct identifiers per set, exact."""
    return ids.select(F.explode("sets").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("size"))


def _slack(n: Column, rate: float, z: float) -> Column:
    return (F.sqrt((n + z * z) * (1 - rate)) * z + z * z * (1 - rate)) / rate


def estimated_overlaps(ids: DataFrame, rate: float = RATE, z: float = 2.6) -> DataFrame:
    """(a, b, n_sampled, estimate, low, high) of every pair of sets that share a sampled identifier.

    ``low`` and ``high`` enclose the true size with a probability of at least 99 % for z = 2.6 (normal
    approximation of the binomial count, widened by z^2); at rate 1 the counts are exact.
    """
    n = F.col("n")
    return cooccurrences(sampled(ids, rate)).select(
        "a", "b", n.alias("n_sampled"), (n / rate).alias("estimate"),
        F.greatest(n.cast("double"), n / rate - _slack(n, rate, z)).alias("low"), (n / rate + _slack(n, rate, z)).alias("high"),
    )


def interval_check(ids: DataFrame, rate: float = RATE, z: float = 6.5) -> DataFrame:
    """(a, b, shared, within): the exact overlap of every pair of sets that share anything, and whether the estimate's interval holds it.

    A pair without a sampled identifier is estimated as 0 and held against the same bound.
    """
    exact, told = cooccurrences(ids).withColumnRenamed("n", "shared"), estimated_overlaps(ids, rate, z).select("a", "b", "low", "high")
    none = _slack(F.lit(0), rate, z)
    inside = F.col("shared").between(F.coalesce("low", F.lit(0.0)), F.coalesce("high", none))
    return exact.join(told, ["a", "b"], "left").select("a", "b", "shared", inside.alias("within"))


def sharing_at_least_half(ids: DataFrame, rate: float = RATE, z: float = 6.5) -> DataFrame:
    """(a, b) with a < b: sets that share at least half of the identifiers of the smaller one.

    The sample proposes pairs whose upper bound (z = 6.5: below 1e-9 of missing one) reaches half of the
    smaller set. Sets so small that even no sampled co-occurrence would not rule a pair out are
    proposed with all their partners. Proposed pairs, and only those, are counted exactly.
    """
    sizes = set_sizes(ids)
    none_seen = (math.sqrt(z * z * (1 - rate)) * z + z * z * (1 - rate)) / rate
    seen = estimated_overlaps(ids, rate, z).select("a", "b", "high")
    sa, sb = sizes.select(F.col("s").alias("a"), F.col("size").alias("size_a")), sizes.select(F.col("s").alias("b"), F.col("size").alias("size_b"))
    proposed = seen.join(sa, "a").join(sb, "b").where(F.col("high") * 2 >= F.least("size_a", "size_b")).select("a", "b")
    partners = proposed.select(F.col("a").alias("s"), F.col("b").alias("o")).groupBy("s").agg(F.collect_set("o").alias("others"))
    # one row per set that has proposed partners or is small; sets, not identifiers, bound the arrays
    plan = sizes.select("s", (F.col("size") <= 2 * none_seen).alias("small")).join(partners, "s", "left")
    plan = plan.where(F.col("small") | F.col("others").isNotNull())
    s, sets = F.col("s"), F.col("sets")
    with_ = F.when(F.col("small"), F.array_remove(sets, s)).otherwise(F.array_intersect(sets, F.col("others")))
    met = ids.where(F.size("sets") > 1).select(F.explode("sets").alias("s"), "sets").join(plan, "s").select("s", F.explode(with_).alias("o"))
    side = F.col("s") < F.col("o")
    exact = met.groupBy(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).agg(
        F.greatest(F.count_if(side), F.count_if(~side)).alias("n")
    )
    return exact.join(sa, "a").join(sb, "b").where(F.col("n") * 2 >= F.least("size_a", "size_b")).select("a", "b")
