"""Operators on reads: minimizer bins, bounded mismatch counts, ordering by minimizer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec


def minimizer_bins(reads: DataFrame, m: int) -> DataFrame:
    """Adds ``minimizer`` (null without one) and ``bin``, its number (0 without one)."""
    out = reads.withColumn("minimizer", codec.minimizer(F.col("seq"), m))
    return out.withColumn("bin", F.coalesce(codec.pack_int(F.col("minimizer")), F.lit(0).cast("bigint")))


def ordered_by_minimizer(reads: DataFrame, m: int) -> DataFrame:
    """Reads in the order of their minimizers: similar reads come close to each other."""
    return minimizer_bins(reads, m).orderBy("minimizer", "seq")


def mismatches(pairs: DataFrame, most: int) -> DataFrame:
    """Adds ``mismatches``: differing places of ``a`` and ``b``, -1 beyond ``most`` or for unequal lengths."""
    return pairs.withColumn("mismatches", codec.hamming(F.col("a"), F.col("b"), most))


def put_mismatches(reads: DataFrame, changes: DataFrame) -> DataFrame:
    """(read_id, seq): reads with the letters of ``changes(read_id, position, ch)`` put at their places."""
    subs = changes.groupBy("read_id").agg(F.array_sort(F.collect_set(F.struct("position", "ch"))).alias("subs"))
    put = F.aggregate(F.coalesce("subs", F.array().cast("array<struct<position:int,ch:string>>")), F.col("seq"), lambda t, s: F.overlay(t, s["ch"], s["position"] + 1, F.lit(1)))
    return reads.join(subs, "read_id", "left").select("read_id", put.alias("seq"))
