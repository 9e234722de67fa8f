"""Envelopes, intake and gate."""

import random

import pytest
from pyspark.sql import functions as F

from searchspark.functions import envelope
from searchspark.operators import gate, index, ingest
from searchspark.plans.schemas import APPLIED, ENVELOPE
from searchspark.plans.spec import CollectionSpec
from searchspark.streaming.engine import SearchEngine, apply, stored_payloads

GOOD = ("s", "e1", "upsert", "users", "opaque-1", 42, '{"name":"Ivan"}', "", 1)
NAMES = [c.split()[0] for c in ENVELOPE.split(", ")]


def event(**changes):
    return tuple(changes.get(n, v) for n, v in zip(NAMES, GOOD, strict=True))


@pytest.mark.parametrize(
    ("changes", "reason"),
    [
        ({}, None),
        ({"collection": ""}, envelope.NO_COLLECTION),
        ({"collection": None}, envelope.NO_COLLECTION),
        ({"event_id": "  "}, envelope.NO_EVENT_ID),
        ({"document_id": ""}, envelope.NO_DOCUMENT_ID),
        ({"operation": "delete", "revision": 0}, envelope.BAD_REVISION),
        ({"operation": "delete", "document_json": None}, None),
        ({"operation": None}, envelope.NO_OPERATION),
        ({"document_json": "{}"}, envelope.NO_DOCUMENT),
        ({"document_json": "null"}, envelope.NO_DOCUMENT),
        ({"document_json": "[1]"}, envelope.BAD_DOCUMENT),
        ({"document_json": "{"}, envelope.BAD_DOCUMENT),
        ({"document_json": None}, envelope.BAD_DOCUMENT),
        ({"occurred_at": "2024-01-01"}, envelope.BAD_TIME),
        ({"occurred_at": "2024-13-01T00:00:00Z"}, envelope.BAD_TIME),
        ({"occurred_at": "2024-01-01T00:00:00+02:00"}, None),
        ({"occurred_at": "2024-01-01T00:00:00,5Z"}, None),
        ({"source_service": ""}, None),
    ],
)
def test_rules(spark, changes, reason):
    df = spark.createDataFrame([event(**changes)], ENVELOPE)
    assert df.select(envelope.reject_reason()).first()[0] == reason


def test_wire_form(spark):
    raw = spark.createDataFrame(
        [(" s ", "e", "INDEX_OPERATION_DELETE", "c", "d", 1, "{", "", 1), (None, "e", "other", "c", "d", None, "{}", "", 2)],
        ENVELOPE.replace("document_id", "aggregate_id"),
    )
    first, second = envelope.from_wire(raw).orderBy("arrival").collect()
    assert (first.source_service, first.operation, first.document_json) == ("s", "delete", None)
    assert (second.operation, second.revision) == (None, 0)


def test_digest_is_stable_and_payload_round_trips(spark):
    a, b = event(document_json='{"b":1,"a":2}'), event(document_json='{ "a": 2, "b": 1 }')
    df = spark.createDataFrame([a, b], ENVELOPE)
    assert len({r[0] for r in df.select(envelope.digest()).collect()}) == 1
    stored = df.select(envelope.canonical_payload().alias("payload")).unionByName(spark.createDataFrame([("{broken",)], "payload string"))
    good, bad = stored_payloads(stored)
    assert good.count() == 2 and bad.count() == 1
    assert {r.revision for r in good.collect()} == {42}


def test_documents_keep_nested_values(spark):
    df = spark.createDataFrame([event(document_json='{"id":"no","_revision":9,"a":{"b":[1,"x"]},"s":"t"}')], ENVELOPE)
    r = envelope.to_document(df).select("id", "_revision", F.to_json("document").alias("d")).first()
    assert (r.id, r._revision, r.d) == ("opaque-1", 42, '{"a":{"b":[1,"x"]},"s":"t"}')


def test_first_delivery_wins_over_batches(spark):
    rows = [event(arrival=1, revision=0), event(arrival=2), event(arrival=3, revision=50), event(event_id="e2", arrival=4)]
    out = ingest.ingest(spark.createDataFrame(rows, ENVELOPE))
    assert [r.status for r in out.status.orderBy("arrival").collect()] == ["rejected", "accepted", "duplicate", "accepted"]
    again = ingest.ingest(spark.createDataFrame(rows, ENVELOPE), out.accepted)
    assert again.accepted.count() == 0
    assert out.rejected.first().stage == "validate"


def sequential(events, state):
    """The gate, one event at a time; state: document -> (revision, digest)."""
    out = {}
    for arrival, doc, revision, mark in sorted(events):
        known = state.get(doc)
        if known is None or revision > known[0]:
            state[doc], out[arrival] = (revision, mark), "new"
        elif revision < known[0]:
            out[arrival] = "stale"
        else:
            out[arrival] = "duplicate" if mark == known[1] else "conflict"
    return out


def test_gate_equals_a_sequential_run(spark):
    random.seed(5)
    state, applied = {}, spark.createDataFrame([], APPLIED)
    for batch in range(2):
        rows = [
            event(event_id=str(random.randrange(3)), document_id=str(random.randrange(5)), revision=random.randrange(1, 9), arrival=batch * 1000 + i)
            for i in range(120)
        ]
        random.shuffle(rows)
        df = spark.createDataFrame(rows, ENVELOPE)
        marks = {r.arrival: r.d for r in df.select("arrival", envelope.digest().alias("d")).collect()}
        want = sequential([(r[8], r[4], r[5], marks[r[8]]) for r in rows], state)
        out = apply(df, applied, [CollectionSpec("users")])
        assert {r.arrival: r.decision for r in out.decisions.collect()} == want
        got = {r.document_id: r.revision for r in out.applied.collect()}
        assert got == {d: s[0] for d, s in state.items()}
        assert out.rejected.count() == sum(d == "conflict" for d in want.values())
        applied = spark.createDataFrame(out.applied.collect(), APPLIED)


def test_tombstones_unknown_collections_and_replay(spark, tmp_path):
    engine = SearchEngine(spark, [CollectionSpec("users")], str(tmp_path))
    first = [event(), event(event_id="x", collection="ghosts", arrival=2)]
    second = [event(event_id="e2", operation="delete", revision=43, arrival=3), event(event_id="e3", revision=41, arrival=4)]
    for batch, rows in enumerate((first, second, second)):
        engine.process(spark.createDataFrame(rows, ENVELOPE), min(batch, 1))
    assert engine.index(0).count() == 1
    assert engine.index(1).count() == 0
    assert engine.applied(1).first().revision == 43
    rejected = spark.read.parquet(f"{tmp_path}/rejected/batch_id=0").collect()
    assert [r.reason for r in rejected] == ["unknown entity ghosts"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [event(event_id=str(i), document_id=str(i % 3), revision=1 + i % 5, arrival=i) for i in range(40)]
    spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.parquet(str(tmp_path / "in"))
    engine = SearchEngine(spark, [CollectionSpec("users")], str(tmp_path / "state"))
    source = spark.readStream.schema(ENVELOPE).parquet(str(tmp_path / "in"))
    engine.start(source, str(tmp_path / "check"), availableNow=True).awaitTermination()
    want = apply(spark.createDataFrame(rows, ENVELOPE), spark.createDataFrame([], APPLIED), [CollectionSpec("users")]).applied
    key = lambda df: sorted((r.document_id, r.revision, r.digest) for r in df.collect())
    assert key(engine.applied(0)) == key(want)


def test_index_operations(spark):
    applied = spark.createDataFrame([("a", "1", 5, "upsert", "d", '{"x":"y"}'), ("a", "2", 6, "delete", "d", None)], APPLIED)
    live = index.rebuild(applied)
    assert [r.id for r in live.collect()] == ["1"]
    assert index.audit(applied, live).count() == 0
    assert index.audit(applied, live.withColumn("_revision", F.lit(4).cast("bigint"))).count() == 1
    assert index.retire(live, ["comments"]).count() == 1
    assert index.retire(live, ["a"]).count() == 0
    with_vectors = index.add_embedder(live, "e5")
    assert with_vectors.first().e5 is None
    assert index.add_embedder(with_vectors.withColumn("e5", F.array(F.lit(1.0))), "e5").first().e5 == [1.0]
    assert index.materialize(live, CollectionSpec("a", searchable=("x",))).first().x == "y"


def test_spec_checks():
    with pytest.raises(ValueError):
        CollectionSpec("a", searchable=("x", "x"))
    with pytest.raises(ValueError):
        CollectionSpec(" ")
