"""Texts that the cache lacks, the empty one among them."""

import duckdb

from searchspark import queries


def test_the_empty_text_is_missing_too(spark, tmp_path):
    """Before, documents without a text were left out, which the SQL of the query does not do."""
    docs = [(1, "a\nb", "en", "s", 3), (2, "", "en", "s", 0), (3, None, "en", "s", 0), (4, "\n", "en", "s", 1), (5, "a\nb", "en", "s", 3), (6, "c", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for ids in ([6], [2, 6], []):
        spark.createDataFrame([(i, [1.0], 0) for i in ids], "vec_id bigint, embedding array<float>, label int").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        duck.execute(f"create or replace view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        got = sorted(r.content_hash for r in queries.cache_misses(spark, str(tmp_path)).collect())
        want = sorted(r[0] for r in duck.execute(queries.SQL["cache_misses"]).fetchall())
        assert got == want and len(got) == 4 - len(ids)
    vectors = queries.embed_documents(spark, str(tmp_path)).collect()
    assert {r.id: r.dimensions for r in vectors} == {1: 26, 2: None, 3: None, 4: 26, 5: 26, 6: 26}
