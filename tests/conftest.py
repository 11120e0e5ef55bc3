from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tracelode.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, **{"spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(spark, query, sql: str, sf_dir: str = "/root/testdata/sf0.001") -> None:
    """The query's rows equal DuckDB's, whatever their order."""
    import duckdb

    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    told = base.execute(sql)
    names = [d[0] for d in told.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    theirs = sorted(tuple(show(r[names.index(c)]) for c in sorted(names)) for r in told.fetchall())
    mine = sorted(tuple(show(r[c]) for c in sorted(names)) for r in df.collect())
    assert mine == theirs
