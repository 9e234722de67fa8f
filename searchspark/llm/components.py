"""Connected components of a table of links, by alternating star steps.

Links are re-hung on ever smaller ids until every component is a star around its smallest id.
Each step aggregates before it shuffles and is staged, so nothing is gathered in one place and
lost executors cost one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchspark.plans.staging import stage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


#: Rows of links written to one file.
ROWS_PER_FILE = 200_000


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) to one row per linked id: node, root (the smallest id of its component)."""
    both = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = stage(links.filter("a <> b").select(*both).distinct(), "links")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(current)
    while before[0]:
        files = 1 + before[0] // ROWS_PER_FILE
        current = stage(_small_star(_large_star(current)).coalesce(files), "stars")
        after = mark(current)
        if after == before:
            break
        before = after
    own = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own)
