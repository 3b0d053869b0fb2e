"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def order(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=order)
    if name not in ORACLES:
        assert got
        return
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=order)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["a1_file_inventory", "b4_size_guard", "d1_dedupe_assets", "d1_alternate_sources", "d14_evidence_report",
                                  "e3_match_exact", "g2_union_roots", "j3_apply_evidence"])
def test_content_is_read_once(spark, name):
    """A plan reads whole texts or pages at most once; what is read before lies in a narrow checkpoint."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ReadSchema: struct<[^>]*\b(?:text|html):", plan)) <= 1
