from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def small():
    return SMALL


def same(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.11g}")
    return value


@pytest.fixture(scope="session")
def against_sql():
    """Compare a DataFrame with SQL that DuckDB runs over the same tables."""
    import duckdb

    def check(df, sql: str, sf_dir: str, **views) -> int:
        db = duckdb.connect()
        db.execute("SET TimeZone = 'UTC'")
        for path in Path(sf_dir).iterdir():
            if path.suffix == ".parquet" and path.stem not in views:
                db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
        for name, table in views.items():
            db.register(name, table)
        cursor = db.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted((tuple(same(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall()), key=repr)
        got = sorted((tuple(same(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
        assert got == want
        return len(got)

    return check
