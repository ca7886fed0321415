import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from quern.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}{'/*.parquet' if file.is_dir() else ''}'")
    return connection


def plain(value):
    """One form for what Spark and DuckDB give for the same value."""
    import numpy as np
    import pandas as pd

    if isinstance(value, (list, np.ndarray)):
        return [plain(v) for v in value]
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and np.isnan(value)):
        return None
    if isinstance(value, (float, np.floating)) and float(value).is_integer():
        return int(value)
    return str(value).removesuffix(" 00:00:00") if not isinstance(value, (int, np.integer)) or isinstance(value, bool) else int(value)


def same_rows(got, want):
    """Compare two pandas frames as bags of rows, columns by name."""
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = [sorted(repr([plain(v) for v in row]) for row in frame[names].itertuples(index=False, name=None)) for frame in (got, want)]
    assert rows[0] == rows[1]


@pytest.fixture(scope="session")
def check_rows():
    return same_rows
