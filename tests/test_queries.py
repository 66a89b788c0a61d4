"""Every query of the core library against its SQL."""

import os

import duckdb
import pytest

from undaflow.plans import catalog
from undaflow.session import local_session

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def spark():
    return local_session(4, 2, **{"spark.sql.codegen.wholeStage": "false"})


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def rows(columns, values):
    """Rows in one order, columns by name; floats to nine digits, as rounding in both engines leaves them equal."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda x: round(float(x), 9) + 0.0 if isinstance(x, float) else x
    return sorted(([plain(v[k]) for k in order] for v in values), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) & set(catalog.oracle_sql())))
def test_equals_sql(spark, db, name):
    got = catalog.queries()[name](spark, DIR)
    want = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    got, want = rows(got.columns, [tuple(r) for r in got.collect()]), rows(columns, want.fetchall())
    assert len(got) == len(want) > 0
    differ = [(a, b) for a, b in zip(got, want) if a != b]
    assert not differ, (len(differ), differ[:3])


#: Many rounds of small jobs; ``test_operators`` checks these clusterings on fewer points.
LONG = {"single_linkage", "hcluster"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - LONG))
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0


def test_recurrence_over_many_blocks(spark):
    """Blocks of 3 need four levels for 100 samples."""
    from undaflow.operators.windows import recurrence

    df = spark.range(100).selectExpr("'s' AS s", "id AS t", "cast(id % 7 AS double) AS b")
    got = {r["t"]: r["y"] for r in recurrence(df, ["s"], "t", "b", 0.9, block=3).collect()}
    y = 0.0
    assert len(got) == 100
    for t in range(100):
        y = t % 7 + 0.9 * y
        assert abs(got[t] - y) < 1e-9
    assert recurrence(df.where("t < 0"), ["s"], "t", "b", 0.9).count() == 0
