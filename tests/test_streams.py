"""Admission by rows and the bounded memory of deliveries."""

import pytest

from searchspark.plans.schemas import ENVELOPE
from searchspark.streaming.engine import event_files, land, stream_dedup


def envelopes(spark, n, start=0):
    return spark.createDataFrame([("s", f"e{i}", "upsert", "posts", f"d{i}", 1, '{"a": 1}', "", i) for i in range(start, start + n)], ENVELOPE)


def passes(spark, path, check):
    sizes = []
    flow = event_files(spark, path, ENVELOPE, files_per_pass=1).writeStream.option("checkpointLocation", check)
    flow.trigger(availableNow=True).foreachBatch(lambda df, _: sizes.append(df.count())).start().awaitTermination()
    return sizes


def test_passes_are_bounded_by_events(spark, tmp_path):
    path, check = str(tmp_path / "in"), str(tmp_path / "check")
    land(envelopes(spark, 25).coalesce(1), path, per_pass=10)
    assert sorted(passes(spark, path, check)) == [5, 10, 10]
    land(envelopes(spark, 7, start=25).coalesce(1), path, per_pass=10)
    assert passes(spark, path, check) == [7]  # what was taken in is not taken again
    with pytest.raises(ValueError, match="one event"):
        land(envelopes(spark, 1), path, per_pass=0)


def test_a_bound_needs_time_and_duration(spark, tmp_path):
    land(envelopes(spark, 1), str(tmp_path / "in"))
    source = event_files(spark, str(tmp_path / "in"), ENVELOPE)
    with pytest.raises(ValueError, match="duration"):
        stream_dedup(source, "seen")
    with pytest.raises(ValueError, match="duration"):
        stream_dedup(source, within="1 hour")
