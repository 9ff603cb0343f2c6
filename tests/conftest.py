import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quern.session import session

    s = session(4, "4g", **{"spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def same_rows(data):
    """Checks a query's rows against its SQL, in any order; floats to 6 places."""
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")

    def rows(pdf):
        null = lambda x: x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x)
        one = lambda x: "∅" if null(x) else repr(round(float(x), 6) + 0.0) if isinstance(x, float) else str(x)
        names = sorted(pdf.columns)
        return names, sorted(tuple(map(one, r)) for r in pdf[names].itertuples(index=False))

    def check(df, sql):
        assert rows(df.toPandas()) == rows(c.execute(sql).fetchdf())

    return check
