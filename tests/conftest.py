import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        path = f"{SF}/{name}" + ("/*.parquet" if os.path.isdir(f"{SF}/{name}") else "")
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(columns, rows):
    """Rows as sorted tuples of text, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        return repr(x) if isinstance(x, float) else x.replace(tzinfo=None).isoformat(" ") if hasattr(x, "tzinfo") else str(x)

    return [columns[i] for i in order], sorted(tuple(one(r[i]) for i in order) for r in rows)
