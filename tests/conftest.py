import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9) + 0.0
    return tuple(map(normal, value)) if isinstance(value, (list, tuple)) else value


def as_rows(columns, rows):
    """Rows with their columns in order of name, sorted."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    found = [tuple(normal(r[k]) for k in order) for r in rows]
    return sorted(columns), sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="session")
def oracle():
    """sf -> DuckDB connection with the tables as views."""
    import duckdb

    def connect(sf: str):
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for path in Path(DATA, sf).glob("*.parquet"):
            files = f"{path}/*.parquet" if path.is_dir() else str(path)
            con.execute(f"create view {path.stem} as select * from '{files}'")
        return con

    return connect


@pytest.fixture(scope="session")
def same_rows(spark, oracle):
    """Asserts that a query gives its SQL's rows over a scale factor."""

    def check(query, sql: str, sf: str = "sf0.001"):
        df = query(spark, f"{DATA}/{sf}")
        relation = oracle(sf).sql(sql)
        assert as_rows(df.columns, df.collect()) == as_rows(relation.columns, relation.fetchall())

    return check
