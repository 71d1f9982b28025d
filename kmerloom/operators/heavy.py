"""Per-key results where a few keys hold most rows.

Every aggregate used here is algebraic, so Spark's partial hash aggregation combines rows on the map
side in bounded tables (falling back to sorted spills) and only one compact state per key and map
task is shuffled. A key that holds a third of all rows therefore reaches its reducer as as many rows
as there are map tasks: no reducer sees the imbalance, and no salting or sampling is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(df: DataFrame, key: Column, **aggregates: Column) -> DataFrame:
    """One row per non-null ``key`` with its row count ``n_rows`` and the given algebraic aggregates.

    Null keys are left out; repeated rows count each time; an empty table gives no rows. Extra columns
    of ``df`` are pruned before the shuffle whatever their names.
    """
    kept = df.where(key.isNotNull()).groupBy(key.alias("key"))
    return kept.agg(F.count(F.lit(1)).alias("n_rows"), *[c.alias(n) for n, c in aggregates.items()])


def heavy_keys(df: DataFrame, key: Column, percent: int = 2) -> DataFrame:
    """(key, n_rows) of the keys that hold at least ``percent`` % of the rows with a non-null key.

    The comparison is in whole numbers, so a key at exactly the share is in. The total is a scalar
    subquery over the same partial aggregates.
    """
    counts = per_key(df, key)
    total = counts.agg(F.sum("n_rows").alias("total"))
    return counts.where(F.col("n_rows") * 100 >= total.scalar() * percent)
