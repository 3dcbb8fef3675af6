import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("EDGEWISE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from edgewise.session import get_spark

    session = get_spark("edgewise-tests", cores=4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.fixture(scope="session")
def against_sql(spark):
    """Compares a query with its SQL over the smallest tables."""
    import duckdb

    folder = f"{DATA}/sf0.001"
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")

    def compare(query, sql):
        df = query(spark, folder)
        found = con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(found.columns)
        ours = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
        theirs = sorted(repr([_plain(r[found.columns.index(c)]) for c in columns]) for r in found.fetchall())
        assert ours == theirs

    return compare
