import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def against_sql(spark, name, query, sql, folder):
    """The query's rows are those of the SQL over the same tables."""
    import duckdb

    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(sql)
    got = query(spark, str(folder))
    assert sorted(got.columns) == sorted(want.columns), name
    cols = ", ".join(sorted(want.columns))
    rows = lambda r: sorted(map(repr, r))
    a = rows(tuple(x) for x in got.selectExpr(*sorted(got.columns)).toPandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None))
    b = rows(con.sql(f"SELECT {cols} FROM want").df().astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None))
    assert a == b, name
