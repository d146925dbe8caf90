import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def oracle():
    """Rows of a DuckDB query over the tables of a folder, as sorted tuples of comparable values."""
    import duckdb

    def run(sql: str, folder: str, columns: list[str]):
        con = duckdb.connect()
        for name in os.listdir(folder):
            at = f"{folder}/{name}"
            con.execute(f"CREATE VIEW {name.split('.')[0]} AS FROM '{at if os.path.isfile(at) else at + '/*.parquet'}'")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(columns)
        return comparable(found.fetchall(), names)

    return run


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)
