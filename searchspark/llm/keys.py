"""Keys of document rows, for steps that join a decision back to its row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchspark.plans.staging import stage

LAST = (1 << 63) - 1
#: Characters of a text by which rows of one id are split; a sample of them comes to the driver.
BEGINNING = 64


def keyed(docs: DataFrame) -> DataFrame:
    """_k, doc_id, text (null: empty), _all (the row), with _k different for each row and in the
    order of documents.

    That is doc_id itself where it is unique (null last). Otherwise rows are put in the order of id
    and text, numbered, and staged; an id with many rows is split by the beginnings of its texts.
    """
    key = F.coalesce("doc_id", F.lit(LAST))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all")
    rows = docs.select(key.alias("_k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), row)
    if not rows.groupBy("_k").count().filter("count > 1").limit(1).count():
        return rows
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("_k"), F.substring("text", 1, BEGINNING)).sortWithinPartitions("_k", "text")
    numbered = stage(ordered.withColumn("_n", F.monotonically_increasing_id()), "keyed-rows")
    return numbered.select(F.coalesce("_n", F.lit(LAST)).alias("_k"), "doc_id", "text", "_all")
