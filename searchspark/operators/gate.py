"""Which events apply: decisions by revision, current state, unknown collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchspark.functions.envelope import digest
from searchspark.plans.schemas import APPLIED

DOCUMENT = ["collection", "document_id"]
CONFLICT = "conflicting payload for an applied revision"


def decide(events: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """Adds digest and decision to valid events: new, stale, duplicate or conflict.

    Each event is held against the highest revision applied before it, in this batch (by arrival)
    or earlier (applied, one row per document). Of events with the revision already applied, those
    with the digest that came first are duplicates. A digest that is there already is taken as it is, so that
    documents need not come along.
    """
    keyed = events if "digest" in events.columns else events.withColumn("digest", digest())
    if applied is None:
        state = keyed.withColumns({"_applied": F.lit(None).cast("bigint"), "_known": F.lit(None).cast("string")})
    else:
        known = applied.select(*DOCUMENT, F.col("revision").alias("_applied"), F.col("digest").alias("_known"))
        state = keyed.join(known, DOCUMENT, "left")
    document = Window.partitionBy(*DOCUMENT).orderBy("arrival")
    before = F.max("revision").over(document.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("digest").over(Window.partitionBy(*DOCUMENT, "revision").orderBy("arrival"))
    highest = F.greatest(before, F.col("_applied"))
    winner = F.when(F.col("revision") == F.col("_applied"), F.col("_known")).otherwise(first)
    decision = (
        F.when(highest.isNull() | (F.col("revision") > highest), "new")
        .when(F.col("revision") < highest, "stale")
        .when(F.col("digest") == winner, "duplicate")
        .otherwise("conflict")
    )
    return state.withColumn("decision", decision).drop("_applied", "_known")


def current_state(decided: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """The newest applied revision of each document, deletes included; aggregated before the shuffle."""
    columns = [c.split()[0] for c in APPLIED.split(", ")]
    rows = decided.filter("decision = 'new'").select(*columns, "arrival")
    if applied is not None:
        rows = rows.unionByName(applied.select(*columns).withColumn("arrival", F.lit(-1).cast("bigint")))
    state = F.struct(*(c for c in columns if c not in DOCUMENT))
    newest = F.max_by(state, F.struct("revision", -F.col("arrival")))
    return rows.groupBy(*DOCUMENT).agg(newest.alias("s")).select(*DOCUMENT, "s.*")


def split_known(events: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Events of declared collections, and the rest with a reason."""
    known = F.col("collection").isin(names)
    unknown = events.filter(~known).withColumn("reason", F.concat(F.lit("unknown entity "), "collection"))
    return events.filter(known), unknown
