"""Every query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from meridian.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(table):
    text = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    names = sorted(table.column_names)
    return names, sorted(zip(*[[text(v) for v in table.column(n).to_pylist()] for n in names]))


def arrow(relation):
    out = relation.arrow()
    return out.read_all() if hasattr(out, "read_all") else out


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, db, name):
    got = rows(plans.queries()[name](spark, sf_dir).toArrow())
    assert got == rows(arrow(db.sql(plans.oracle_sql()[name])))


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_modes_differ(spark):
    """The derived data must tell the three choices apart, else their tests could not fail."""
    at = "/root/testdata/sf0.01"
    picked = [dict(plans.queries()[f"pick_{m}"](spark, at).select("req_id", "point_id").collect()) for m in ("fold", "nearest", "weight_first")]
    assert picked[0].keys() == picked[1].keys() == picked[2].keys()
    assert sum(picked[0][k] != picked[1][k] for k in picked[0]) > 1000
    assert sum(picked[0][k] != picked[2][k] for k in picked[0]) > 1000


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "found" in df.columns
