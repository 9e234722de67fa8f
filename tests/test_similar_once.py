"""Vectors that are long to make are made once, however many requests there are."""

from pyspark.sql import functions as F

from searchspark.operators import search, semantic
from searchspark.plans.spec import CollectionSpec


def test_vectors_are_made_once(spark, monkeypatch):
    """Before, the vector of a document was made again for each block of requests and to be counted."""
    monkeypatch.setattr(semantic, "NUMBERS", 60)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b.assign(embedding=[[float(i), 1.0] for i in b["id"]])

    docs = spark.range(40).select("id", F.concat(F.lit("t"), "id").alias("title"))
    index = docs.mapInPandas(count, "id bigint, title string, embedding array<float>").select("id", "embedding")
    spec = CollectionSpec("c", searchable=("title",), semantic=("title",))
    kind = "query_id int, text string, document_id string, page_size int, page_token string"
    asked = spark.createDataFrame([(i, "", str(i), 2, "") for i in range(12)] + [(99, "", "none", 2, "")], kind)
    embed = lambda rows: rows.withColumn("vector", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")))
    got = search.similar(asked, index, spec, embed, named=docs).collect()
    assert sorted((r.query_id, r.rank, r.id, r.total) for r in got if not r.error) == [(i, n, 40 - n, 39) for i in range(12) for n in (1, 2)]
    assert [(r.query_id, r.error) for r in got if r.error] == [(99, "document not found")]
    assert made.value == 40
