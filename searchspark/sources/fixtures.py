"""The test tables as input of the engine: envelopes, posts, queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchspark.plans.spec import CollectionSpec
from searchspark.plans.staging import table

#: Runs unchanged in Spark and DuckDB. Every tenth delivery comes twice; some break a rule.
ENVELOPES_SQL = """
base as (
  select event_type as source_service, cast(event_id as varchar(20)) as event_id,
         case when event_id % 101 = 0 then ' ' else 'profiles' end as collection,
         cast(user_id as varchar(20)) as document_id,
         case when event_id % 97 = 0 then 0
              else cast(floor(event_id/200) as bigint) + cast(floor(value) as bigint) % 7
         end as revision,
         case when event_id % 89 = 0 then 'merge'
              when event_type = 'error' then 'delete' else 'upsert' end as operation,
         case when event_id % 83 = 0 then '{}' when event_id % 79 = 0 then '[1' else props end as document_json,
         case when event_id % 73 = 0 then 'yesterday' when event_id % 2 = 0 then '2024-05-01T10:00:00Z' else '' end as occurred_at,
         event_id as arrival
  from events),
env as (
  select * from base
  union all
  select source_service, event_id, collection, document_id, revision, operation,
         document_json, occurred_at, arrival + 1000000000
  from base where arrival % 10 = 0)
"""

POSTS = CollectionSpec(
    "posts", searchable=("title", "content"), filterable=("lang", "source", "visibility", "tags"), sortable=("id",),
    returnable=("title",), semantic=("title", "content"), semantic_weights={"title": 0.9, "content": 0.5}, embedder="hashing",
)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events of the collection profiles."""
    text = ENVELOPES_SQL.replace("from events", "from {events}").replace("'{}'", "'{{}}'")
    return spark.sql(f"with {text} select * from env", events=table(spark, sf_dir, "events"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: id, title (first line), content, lang, source, tags, visibility."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        F.lit("posts").alias("collection"), F.col("doc_id").cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), "lang", "source",
        F.array("lang", "source").alias("tags"), F.when(F.col("toxic") == 1, "hidden").otherwise("public").alias("visibility"),
    )


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the first words of benchmark texts, one to seven of them, as people ask."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    n = (1 + F.col("item_id") % 7).cast("int")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, F.lit(1), n), " ").alias("query"))


def whole_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: whole benchmark texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def letters(texts: list[str]) -> list[list[float]]:
    """An encoder that SQL can follow: shares of the letters a to z, as a vector of length 1."""
    out = []
    for t in texts:
        counts = [t.count(chr(c)) for c in range(97, 123)]
        length = math.sqrt(sum(n * n for n in counts)) or 1.0
        out.append([n / length for n in counts])
    return out


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, document_id, vector: every fiftieth vector."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector"))


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
