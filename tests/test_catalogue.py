"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from tests.conftest import SMALL
from trailmark.plans import body, catalogue, geometry, matching, more  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLE])
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    got = plain(df.collect(), df.columns)
    ran = duck.execute(catalogue.ORACLE[name])
    assert got == plain(ran.fetchall(), [c[0] for c in ran.description])


def test_sliding_windows_reach_every_row(spark):
    seen = catalogue.obs(spark, SMALL).where("global_track_id is not null").selectExpr("min(frame_idx)", "max(frame_idx)").first()
    starts = [r["window_start"] for r in catalogue.QUERIES["q_sliding_windows_whole"](spark, SMALL).select("window_start").distinct().collect()]
    covered = {f for s in starts for f in range(s, s + 32)}
    assert set(range(seen[0], seen[1] + 1)) <= covered


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
