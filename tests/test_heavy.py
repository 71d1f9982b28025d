import pytest
from conftest import DATA, against_sql
from pyspark.sql import functions as F

from kmerloom.operators.heavy import heavy_keys, per_key
from kmerloom.plans import heavy_queries


def test_share_is_exact_and_nulls_are_out(spark):
    rows = [("a",)] * 2 + [("b",)] * 98 + [(None,)] * 50
    got = heavy_keys(spark.createDataFrame(rows, "key string"), F.col("key"))
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("b", 98)]
    assert heavy_keys(spark.createDataFrame([*rows, ("b",)], "key string"), F.col("key")).count() == 1


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("x", 1, 5)], "k string, n_rows int, key int")
    assert tuple(per_key(df, F.col("k"), top=F.max("key")).first()) == ("x", 1, 5)
    assert heavy_keys(df.limit(0), F.col("k")).count() == 0


@pytest.mark.parametrize("name", heavy_queries.QUERIES)
def test_sql(spark, name):
    against_sql(spark, name, heavy_queries.QUERIES[name], heavy_queries.ORACLES[name], DATA / "sf0.001")
