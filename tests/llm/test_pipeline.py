"""The pipeline, stage by stage, and the registered queries."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from searchspark.llm import mixing
from searchspark.plans.staging import stage

SMALL = entry.SMALL


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(stage(f(spark, out[-1], SMALL), "test"))
    return out


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_stages(spark, stages):
    docs, good, single, clean, mixed, packed = stages
    for df in (good, single, clean, mixed):
        assert df.columns == docs.columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    lost = docs.join(good, "doc_id", "left_anti").join(labels, "doc_id").collect()
    assert 0 < good.count() < docs.count() and sum(r.quality for r in lost) <= 1
    assert single.count() < good.count() and single.join(good, "doc_id", "left_anti").count() == 0
    assert clean.count() == single.count()
    assert clean.filter(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.")).count() == 0
    assert clean.filter("n_chars <> length(text)").count() == 0
    want = {r.doc_id: r.taken for r in mixing.mix(clean).collect()}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {d: t for d, t in want.items() if t}
    ids = packed.groupBy("doc_id").agg(F.sum("length").alias("n")).count()
    assert ids == len(got)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_odd_tables(spark, odd, empty, tmp_path):
    odd.limit(0).select("doc_id").withColumns({"quality": F.lit(1), "toxic": F.lit(0)}).write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, empty):
        for _, f in corpus_pipeline.STAGES:
            docs = stage(f(spark, docs, str(tmp_path)), "test")
            docs.count()


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_fingerprints_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            want = c.execute(sql).df()
            got = entry.queries()[name](spark, SMALL).toPandas()
            assert sorted(want.columns) == sorted(got.columns)
            key = lambda df: sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))
            assert key(want) == key(got)
