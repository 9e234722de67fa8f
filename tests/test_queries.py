"""Registered queries against DuckDB over the smallest tables."""

import importlib
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
core = importlib.import_module("searchspark.queries")


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9))
    return repr(list(v)) if isinstance(v, (list, tuple)) else str(v)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from read_parquet('{entry.SMALL}/{t}.parquet')")
    return c


@pytest.mark.skipif(not Path(entry.SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, entry.SMALL)
    got = rows(df.columns, df.collect())
    if name in core.oracle_sql():
        want = duck.execute(core.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, want.fetchall())
    else:
        assert got


@pytest.mark.skipif(not Path(entry.SMALL).exists(), reason="no test tables")
def test_hashing_answers_every_fiftieth_vector(spark):
    got, want = ({(r.query_id, r.id) for r in core.queries()[n](spark, entry.SMALL).collect()} for n in ("semantic_lsh", "semantic_topk"))
    ids = {r.vec_id for r in spark.read.parquet(f"{entry.SMALL}/embeddings.parquet").filter("vec_id % 50 = 0").collect()}
    print(f"recall {len(got & want) / len(want):.4f} of {len(want)}")
    assert {q for q, _ in want} == {q for q, _ in got} == ids
    assert len(got & want) >= 0.9 * len(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
