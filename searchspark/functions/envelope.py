"""Change events: wire form, rules, canonical payload, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchspark.plans.schemas import ENVELOPE

# The full form of RFC 3339 date-times, and the messages of the rules.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
NO_OPERATION = "operation is required"
BAD_DOCUMENT = "decode document_json"
NO_EVENT_ID = "event_id is required"
NO_COLLECTION = "collection is required"
NO_DOCUMENT_ID = "document_id is required"
BAD_REVISION = "revision must be greater than zero"
BAD_TIME = "occurred_at must use RFC3339"
NO_DOCUMENT = "document is required for upsert"


def from_wire(raw: DataFrame) -> DataFrame:
    """Envelopes from wire columns: aggregate_id becomes document_id, enum names become operations,
    the source is trimmed, deletes lose their document."""
    op = F.lower(F.regexp_replace(F.coalesce("operation", F.lit("")), "^INDEX_OPERATION_", ""))
    return raw.select(
        F.trim(F.coalesce("source_service", F.lit(""))).alias("source_service"), "event_id",
        F.when(op.isin("upsert", "delete"), op).alias("operation"), "collection",
        F.col("aggregate_id").alias("document_id"), F.coalesce("revision", F.lit(0)).cast("bigint").alias("revision"),
        F.when(op == "upsert", F.col("document_json")).alias("document_json"), "occurred_at", "arrival",
    )


def parse_rfc3339(text: Column) -> Column:
    """The instant, or null for anything else. A comma before the fraction counts as a point."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("."))))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def reject_reason() -> Column:
    """The first rule an envelope breaks, or null. Rules of the wire come first."""
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json("document_json")), F.lit("NONE"))
    upsert, op = F.col("operation") == "upsert", F.coalesce(F.col("operation"), F.lit(""))
    time = F.coalesce(F.col("occurred_at"), F.lit(""))
    return (
        F.when(~op.isin("upsert", "delete"), NO_OPERATION)
        .when(upsert & (kind != "VOID") & ~kind.startswith("OBJECT"), BAD_DOCUMENT)
        .when(_blank("event_id"), NO_EVENT_ID)
        .when(_blank("collection"), NO_COLLECTION)
        .when(_blank("document_id"), NO_DOCUMENT_ID)
        .when(F.coalesce(F.col("revision"), F.lit(0)) <= 0, BAD_REVISION)
        .when((time != "") & parse_rfc3339(time).isNull(), BAD_TIME)
        .when(upsert & kind.isin("VOID", "OBJECT<>"), NO_DOCUMENT)
    )


def wire_stage(reason: Column) -> Column:
    """Where a rule belongs: "wire" or "validate"."""
    return F.when(reason.isin(NO_OPERATION, BAD_DOCUMENT), "wire").when(reason.isNotNull(), "validate")


def canonical_payload() -> Column:
    """JSON with fields in fixed order, keys of the document sorted, empty fields left out."""
    text = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return F.to_json(
        F.struct(
            "event_id", text("source_service"), "operation", "collection", "document_id", "revision",
            F.try_parse_json("document_json").alias("document"), text("occurred_at"),
        )
    )


def digest() -> Column:
    """SHA-256 of the canonical payload."""
    return F.sha2(canonical_payload(), 256)


def decode_payload(df: DataFrame, col: str) -> DataFrame:
    """Envelopes from stored payloads, with reason set for those that do not decode or are not
    valid; a bad row harms no other."""
    fields = ENVELOPE.replace("document_json string, ", "") + ", document string"
    parsed = df.withColumn("_e", F.from_json(col, fields, {"mode": "PERMISSIVE"}))
    names = [f.split()[0] for f in ENVELOPE.split(", ")]
    get = lambda n: F.col(f"_e.{'document' if n == 'document_json' else n}").alias(n)
    out = parsed.select(*(get(n) for n in names))
    return out.withColumn("source_service", F.coalesce("source_service", F.lit(""))).withColumn("reason", reject_reason())


def to_document(df: DataFrame) -> DataFrame:
    """Adds id, _revision, and document: a map of the JSON document's fields without the two reserved
    names, values as JSON kept whole at any depth (VARIANT)."""
    fields = F.try_variant_get(F.try_parse_json("document_json"), "$", "map<string,variant>")
    kept = F.map_filter(fields, lambda k, v: ~k.isin("id", "_revision"))
    return df.withColumns({"id": F.col("document_id"), "_revision": F.col("revision"), "document": kept})
