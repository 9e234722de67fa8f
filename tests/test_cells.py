"""Trained cells against all vectors."""

from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
from searchspark.operators import cells, semantic
from searchspark.sources import fixtures

LARGE = "/root/testdata/sf0.1"
INDEX, QUERY = "id long, embedding array<float>", "query_id long, vector array<float>"


def recall(got, want):
    got, want = ({(r.query_id, r.id) for r in df.collect()} for df in (got, want))
    return len(got & want) / len(want)


def clustered(rows=3_000, groups=40, width=10):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(groups, width))[rng.integers(groups, size=rows)] + 0.1 * rng.normal(size=(rows, width))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.skipif(not Path(LARGE).exists(), reason="no test tables")
def test_recall_and_share_of_pairs(spark):
    index, queries = fixtures.vector_index(spark, LARGE), fixtures.vector_queries(spark, LARGE)
    got = entry.queries()["semantic_cells"](spark, LARGE)
    of = recall(got, semantic.semantic(queries, index, 10))
    trained = cells.fit(index)
    codes = cells.coded(index, trained)
    assert codes.count() == index.count()
    scored = cells.estimated(queries, codes, trained, 100).count() / (queries.count() * index.count())
    print(f"recall {of:.4f}, exact scores for {scored:.4f} of all pairs, {trained.probes} of {len(trained.centres)} cells")
    assert of >= 0.9
    assert scored <= 0.1


def test_clustered_vectors_need_few_cells(spark):
    m = clustered()
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], INDEX)
    queries = spark.createDataFrame([(i, m[i].tolist()) for i in range(0, len(m), 50)], QUERY)
    trained = cells.fit(index)
    assert trained.probes <= len(trained.centres) / 4
    got = cells.semantic_cells(queries, index, cells.coded(index, trained), trained, 10)
    assert recall(got, semantic.semantic(queries, index, 10)) >= 0.9
    wanted = {r.rank: r.semantic_score for r in got.filter("query_id = 0").collect()}
    assert sorted(wanted) == list(range(1, 11)) and wanted == dict(sorted(wanted.items(), key=lambda x: (-x[1], x[0])))


def test_small_tables_are_exact(spark):
    """With fewer rows than estimates are kept for, and all cells looked into, nothing is approximate."""
    vectors = [[1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [0.0, 1.0, 0.0], [0.6, 0.8, 0.0], None, [0.0, 0.0, 1.0]]
    index = spark.createDataFrame(list(enumerate(vectors)), INDEX)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None)], QUERY)
    trained = cells.fit(index, found=1.0)
    trained = cells.Cells(trained.centres, trained.books, len(trained.centres))
    got = cells.semantic_cells(queries, index, cells.coded(index, trained), trained, 3)
    want = semantic.semantic(queries, index, 3)
    assert sorted(map(tuple, got.select("query_id", "id", "semantic_score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "id", "semantic_score", "rank").collect()))


def test_many_queries_go_in_blocks(spark, monkeypatch):
    m = clustered(rows=200)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], INDEX)
    queries = index.selectExpr("id as query_id", "embedding as vector")
    trained = cells.fit(index)
    codes = cells.coded(index, trained)
    whole = sorted(map(tuple, cells.estimated(queries, codes, trained, 5).select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(cells, "BLOCK", 30)
    assert sorted(map(tuple, cells.estimated(queries, codes, trained, 5).select("query_id", "id", "rank").collect())) == whole


def test_empty_tables_and_widths(spark):
    none, asked = spark.createDataFrame([], INDEX), spark.createDataFrame([(1, [1.0])], QUERY)
    trained = cells.fit(none)
    assert cells.semantic_cells(asked, none, cells.coded(none, trained), trained, 3).count() == 0
    assert cells.semantic_cells(asked.limit(0), none, cells.coded(none, trained), trained, 3).count() == 0
    wide = spark.createDataFrame([(1, [1.0, 0.0])], INDEX)
    with pytest.raises(Exception, match="entries"):
        cells.coded(wide, trained).collect()
