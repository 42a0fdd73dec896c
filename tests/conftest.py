import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 8)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def rows(records, columns):
    return sorted((tuple(_plain(r[c]) for c in columns) for r in records), key=repr)


@pytest.fixture(scope="session")
def same():
    """Checks a Spark result against DuckDB SQL, columns by name and rows in any order."""

    def check(df, con, sql):
        cols = sorted(df.columns)
        got = con.sql(sql)
        assert sorted(got.columns) == cols
        at = {c: i for i, c in enumerate(got.columns)}
        want = sorted((tuple(_plain(r[at[c]]) for c in cols) for r in got.fetchall()), key=repr)
        assert rows(df.collect(), cols) == want

    return check
