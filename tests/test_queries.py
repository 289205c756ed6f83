import random

import duckdb
import pytest

from commweave.plans.catalog import QUERIES
from commweave.plans.oracle import ORACLE_SQL

@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Small tables with gaps in their ids and repeated lines."""
    import pandas as pd

    r, at = random.Random(2), tmp_path_factory.mktemp("small")
    lines = [(o * 3, p * 2, s) for o in range(60) for p, s in [(r.randrange(40), r.randrange(6)) for _ in range(r.randint(1, 4))]]
    tables = {
        "lineitem": pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_suppkey"]),
        "orders": pd.DataFrame([(o * 3, r.randrange(12)) for o in range(60)], columns=["o_orderkey", "o_custkey"]),
        "events": pd.DataFrame([(i, pd.Timestamp(2024, 1, 1 + i // 40), r.randrange(20), r.choice(["view", "error", "buy"]), r.uniform(-9, 99)) for i in range(300)], columns=["event_id", "ts", "user_id", "event_type", "value"]).astype({"ts": "datetime64[us]"}),
    }
    db = duckdb.connect()
    for name, rows in tables.items():
        rows.to_parquet(at / f"{name}.parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    return str(at), db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, small, name):
    at, db = small
    found = QUERIES[name](spark, at)
    columns = sorted(found.columns)
    got = sorted(tuple(map(str, r)) for r in found.select(columns).collect())
    assert got == sorted(tuple(map(str, r)) for r in db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())
    assert got


def test_stored_graphs_follow_their_tables(spark, tmp_path):
    import pandas as pd

    from commweave.sources.store import stored

    write = lambda n: pd.DataFrame([(1, p, 0) for p in range(n)], columns=["l_orderkey", "l_partkey", "l_suppkey"]).to_parquet(tmp_path / "lineitem.parquet")
    write(3)
    first = stored(spark, str(tmp_path), "copart")
    assert stored(spark, str(tmp_path), "copart") is first and first.edges.count() == 6
    write(4)
    assert stored(spark, str(tmp_path), "copart").edges.count() == 12


def test_detection_by_joins_equals_its_sql(spark, small):
    from commweave.plans.detect import detect
    from commweave.sources.store import stored

    at, db = small
    found = detect(stored(spark, at, "copart"), one_task=-1)
    assert sorted(map(tuple, found.select("v", "c").collect())) == sorted(db.sql(ORACLE_SQL["detect_communities"]).fetchall())
