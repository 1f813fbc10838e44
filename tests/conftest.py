import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        path = f"{path}/*" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(frame):
    """Rows of a pandas frame in any order, columns by name, doubles to nine places; whole numbers with nulls are whole numbers."""
    frame = frame[sorted(frame.columns)].convert_dtypes()
    cell = lambda v: round(v, 9) if isinstance(v, float) else v.tolist() if hasattr(v, "tolist") else v
    return sorted(repr(tuple(cell(v) for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same_rows():
    return rows_of
