import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
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
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(cols, data):
    """Rows as sorted tuples of text, columns by name; 1 and 1.0 are alike."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple("" if r[i] is None else repr(float(r[i])) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in data)


def same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    return rows_of(df.columns, df.collect()) == rows_of(relation.columns, relation.fetchall())
