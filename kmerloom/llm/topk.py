"""Most frequent values of a column by exact prefix refinement.

Level by level, rows are counted per prefix of their value's 64-bit hash. A prefix's count bounds the
count of every value below it from above; exact counts of a few witness values bound the k-th largest
count from below. Prefixes that cannot beat that bound are dropped and the others lengthened, until
whole values remain. Nothing is estimated: the result and the counts are exact, and the counters of a
level are at most 2^bits or N / bound, whichever is less, however many distinct values there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

LEVELS = (16, 28)


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("h"), 64 - bits)


def most_frequent(rows: DataFrame, k: int, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(value, n_rows) of the ``k`` most frequent values of ``rows(value BINARY, row_hash BIGINT)``.

    Repeated rows count each time, nulls not at all, equal counts rank by ascending bytes; fewer
    than k distinct values give fewer rows, an empty table none. ``row_hash`` only picks witnesses
    (a pseudo-random row of a prefix most likely holds the prefix's heaviest value); any column will
    do, and a poor one only costs pruning. Only 4k witnesses and one bound reach the driver a level.
    The rows are read once a level, once for the witnesses of each level but the last, and once for the values.
    """
    hashed = rows.where(F.col("value").isNotNull()).select("value", "row_hash", F.xxhash64("value").alias("h"))
    live, bound, witnesses = hashed, 1, []
    for i, bits in enumerate(levels):
        counted = live.groupBy(_prefix(bits).alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.min_by("h", F.xxhash64("row_hash", F.lit(i))).alias("witness")
        )
        counts = cut(counted.where(F.col("n") >= bound))  # else every level would run all levels before it again
        if i + 1 < len(levels):
            top = counts.orderBy(F.desc("n"), "p").limit(4 * k).select("witness")
            witnesses = sorted({*witnesses, *(r.witness for r in top.collect())})
            if not witnesses:
                break
            exact = hashed.where(F.col("h").isin(witnesses)).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
            best = [(r.n, r.h) for r in exact.orderBy(F.desc("n"), "h").limit(4 * k).collect()]
            witnesses = [h for _, h in best]
            bound = max(bound, best[k - 1][0]) if len(best) >= k else bound
        kept = counts.where(F.col("n") >= bound).select("p")
        live = hashed.withColumn("p", _prefix(bits)).join(kept, "p", "left_semi").drop("p")
    out = live.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))
    return out.orderBy(F.desc("n_rows"), F.hex("value")).limit(k)
