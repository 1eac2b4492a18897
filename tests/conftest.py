import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query and its SQL give the same rows on sf0.001."""

    def check(df, sql):
        cols = sorted(df.columns)
        got = [tuple(r) for r in df.select(*cols).collect()]
        r = duck.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        want = [tuple(x[names.index(c)] for c in cols) for x in r.fetchall()]
        key = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
        assert sorted(got, key=key) == sorted(want, key=key)

    return check
