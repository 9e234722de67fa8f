"""Streams side by side: every event once, passes bounded, a failure raised."""

import threading

import pytest

from searchspark.plans.schemas import ENVELOPE
from searchspark.streaming.engine import land, take_lanes


def test_lanes_take_every_event_once(spark, tmp_path):
    """Before, passes of one stream followed each other, so that their number alone set the time."""
    path, check, schema = str(tmp_path / "in"), str(tmp_path / "check"), spark.createDataFrame([], ENVELOPE).schema
    rows = [("s", f"e{i % 50}", "upsert", "posts", f"d{i % 7}", 1, '{"a": 1}', "", i) for i in range(60)]
    passes, lock, together, most = [], threading.Lock(), [0], [0]

    def take(df, lane, batch):
        with lock:
            together[0] += 1
            most[0] = max(most[0], together[0])
        got = [(r.event_id, r.arrival) for r in df.collect()]
        with lock:
            together[0] -= 1
            passes.append((lane, batch, got))

    land(spark.createDataFrame(rows, ENVELOPE), path, per_pass=5, lanes=3)
    take_lanes(spark, path, schema, check, take)
    assert sorted(a for _, _, got in passes for _, a in got) == list(range(60)) and all(len(got) <= 5 for _, _, got in passes)
    lanes = {}
    for lane, _, got in passes:
        for e, _ in got:
            lanes.setdefault(e, set()).add(lane)
    assert all(len(x) == 1 for x in lanes.values()) and len({lane for lane, _, _ in passes}) > 1 and most[0] > 1
    passes.clear()
    land(spark.createDataFrame([("s", "late", "upsert", "posts", "d", 1, '{"a": 1}', "", 99)], ENVELOPE), path, per_pass=5, lanes=3)
    take_lanes(spark, path, schema, check, take)
    assert [got for _, _, got in passes] == [[("late", 99)]]  # what was taken in is not taken again

    def fail(df, lane, batch):
        raise RuntimeError("lane is broken")

    with pytest.raises(Exception, match="lane is broken"):
        take_lanes(spark, path, schema, str(tmp_path / "other"), fail)
    assert not spark.streams.active
    land(spark.createDataFrame([], ENVELOPE), str(tmp_path / "empty"), lanes=2)
    take_lanes(spark, str(tmp_path / "empty"), schema, str(tmp_path / "third"), fail)
