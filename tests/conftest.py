import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return lambda sql: db.sql(sql).df()


@pytest.fixture(scope="session")
def same():
    import numpy as np

    def check(a, b):
        names = sorted(a.columns)
        assert names == sorted(b.columns)
        assert len(a) == len(b)
        # Numbers of either library's type are one; a null is one in both.
        text = lambda v: "null" if v is None or v is np.nan or v != v else f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
        rows = [sorted(tuple(text(v) for v in r) for r in x[names].itertuples(index=False)) for x in (a, b)]
        assert rows[0] == rows[1]

    return check
