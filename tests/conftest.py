"""One Spark session for all tests, and comparison with DuckDB."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + (":" + p if (p := os.environ.get("PYTHONPATH")) else "")

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """shuffle partitions few, time zone UTC; what operators store goes to a folder of the test run."""
    own = tmp_path_factory.mktemp("spark")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.local.dir": str(own / "local"), "spark.sql.warehouse.dir": str(own / "warehouse"), "spark.checkpoint.dir": f"file://{own}/shared",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """sf_dir -> a DuckDB connection with its tables as views."""
    made = {}

    def at(sf_dir: str):
        if sf_dir not in made:
            con = made[sf_dir] = duckdb.connect()
            con.execute("SET TimeZone = 'UTC'")
            for t in TABLES:
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return made[sf_dir]

    return at


def _plain(v) -> str:
    if isinstance(v, float):
        return f"{v:.9g}"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if getattr(v, "tzinfo", None):
        v = v.replace(tzinfo=None)
    return str(v)


def same_rows(df, relation) -> None:
    """df holds the rows of a DuckDB relation, columns by name and rows in any order."""
    names = sorted(df.columns)
    have = [c[0] for c in relation.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    a = sorted(tuple(map(_plain, r)) for r in df.select(*names).collect())
    b = sorted(tuple(_plain(r[i]) for i in at) for r in relation.fetchall())
    assert len(a) == len(b)
    assert a == b


@pytest.fixture(scope="session")
def compare(spark, duck):
    """(query, sql, sf_dir): the query's rows are those of the SQL."""

    def check(query, sql: str, sf_dir: str = f"{DATA}/sf0.001") -> None:
        same_rows(query(spark, sf_dir), duck(sf_dir).execute(f"SELECT * FROM ({sql.strip()})"))

    return check
