"""Intake: one status per event, accepted events, refused events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchspark.functions.envelope import canonical_payload, reject_reason, wire_stage

DELIVERY = ["source_service", "event_id"]


@dataclass
class IngestOut:
    """status (event_id, status, message, arrival), accepted envelopes, rejected rows."""

    status: DataFrame
    accepted: DataFrame
    rejected: DataFrame


def judged(events: DataFrame, inbox: DataFrame | None = None) -> DataFrame:
    """Adds reason and status. The first valid delivery of a source's event is accepted, later ones
    and those in the inbox are duplicates, whatever they hold. A column reason that is there already is taken as it is,
    so that documents need not come along."""
    checked = events if "reason" in events.columns else events.withColumn("reason", reject_reason())
    # Refused events are not numbered; their arrival keeps them from meeting in one window.
    refused = F.when(F.col("reason").isNotNull(), F.col("arrival"))
    first = Window.partitionBy(*DELIVERY, refused).orderBy("arrival")
    out = checked.withColumn("_n", F.row_number().over(first))
    if inbox is None:
        out = out.withColumn("_seen", F.lit(False))
    else:
        seen = inbox.select(*DELIVERY).distinct().withColumn("_seen", F.lit(True))
        out = out.join(seen, DELIVERY, "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_seen") | (F.col("_n") > 1), "duplicate").otherwise("accepted")
    return out.withColumn("status", status).drop("_n", "_seen")


def ingest(events: DataFrame, inbox: DataFrame | None = None) -> IngestOut:
    """Validate and deduplicate a batch of envelopes."""
    return outcome(judged(events, inbox))


def outcome(done: DataFrame) -> IngestOut:
    """The three results of judged events."""
    message = F.coalesce("reason", F.lit(""))
    return IngestOut(
        done.select("source_service", "event_id", "arrival", "status", message.alias("message")),
        done.filter("status = 'accepted'").drop("reason", "status"),
        dead_letters(done.filter("status = 'rejected'"), attempts=0),
    )


def dead_letters(rejected: DataFrame, attempts: int, stage: str | None = None) -> DataFrame:
    """Refused events as stored: empty names and revision 0 become null."""
    empty = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return rejected.select(
        *(empty(c) for c in ("source_service", "event_id", "collection", "document_id")),
        F.nullif(F.col("revision"), F.lit(0)).cast("bigint").alias("revision"), canonical_payload().alias("payload"),
        F.lit(attempts).alias("attempts"), "reason", (F.lit(stage) if stage else wire_stage(F.col("reason"))).alias("stage"),
    )


def audit_payloads(decided: DataFrame, inbox: DataFrame) -> DataFrame:
    """Decisions with the payload that the inbox holds for them."""
    return decided.join(inbox.select(*DELIVERY, "payload"), DELIVERY)
