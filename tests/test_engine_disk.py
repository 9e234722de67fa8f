"""What the engine leaves on disk, and the places of words found without a shuffle."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from searchspark.operators import lexical
from searchspark.plans.schemas import ENVELOPE
from searchspark.plans.spec import CollectionSpec
from searchspark.plans.staging import passing, release, shared_folder, stage
from searchspark.streaming.engine import SearchEngine
from searchspark.streaming.state import ChangeLog

POSTS = CollectionSpec("posts", searchable=("title",), returnable=("title",), semantic=("title",), embedder="e")


def staged(spark):
    return {p.name for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*-*") if p.is_dir()}


def test_a_batch_leaves_no_tables_of_its_own(spark, tmp_path):
    """Before, eight copies of each document stayed for as long as the session, beside three in the index."""
    before = staged(spark)
    engine = SearchEngine(spark, [POSTS], str(tmp_path / "state"), encoder=lambda texts: [[float(len(t)), 1.0] for t in texts], model="m")
    rows = [("s", f"e{i}", "upsert", "posts", f"d{i % 40}", 1 + i // 40, f'{{"title": "word{i % 7} other{i}"}}', "", i) for i in range(50)]
    engine.process(spark.createDataFrame(rows, ENVELOPE), 0)
    engine.process(spark.createDataFrame([("s", "x", "delete", "posts", "d3", 9, None, "", 60), ("s", "y", "upsert", "posts", "d4", 2, '{"title":"b"}', "", 61)], ENVELOPE), 1)
    assert staged(spark) == before
    kept = spark.read.parquet(f"{tmp_path}/state/index/parts/part=0").columns
    assert not {"semantic_text", "_translit"} & {*kept}
    index = {r.id: r for r in engine.index(1).collect()}
    assert set(index) == {f"d{i}" for i in range(40)} - {"d3"} and index["d4"]._revision == 2
    assert index["d4"].semantic_text == "word2 other44" and index["d4"].embedding == [float(len("passage: word2 other44")), 1.0]
    assert index["d4"]._search_text == "word2 other44" and index["d4"]._translit
    assert spark.read.parquet(f"{tmp_path}/state/rejected/batch_id=1").collect()[0].reason == "conflicting payload for an applied revision"


def test_passing_tables_go(spark):
    before = staged(spark)
    with passing(spark):
        first, second, kept = (stage(spark.range(3), label, keep=label == "kept") for label in ("one", "two", "kept"))
        release(first)
        assert second.count() == 3 and len(staged(spark) - before) == 2
    assert len(staged(spark) - before) == 1 and kept.count() == 3
    with pytest.raises(ZeroDivisionError), passing(spark):
        stage(spark.range(3), "lost")
        raise ZeroDivisionError
    assert len(staged(spark) - before) == 1


def test_null_keys_and_wide_tables(spark, tmp_path):
    """Rows of a key that is null give way to newer ones, too; a wide table is written by the tasks as they are."""
    log = ChangeLog(spark, str(tmp_path), "t", ["a", "b"], "a string, b string, v int, w string", buckets=4, fan=3, wide=True)
    for version in range(5):
        log.write(spark.createDataFrame([(None, "x", version, "w"), ("y", f"{version % 2}", version, "w")], "a string, b string, v int, w string"), version)
    assert sorted((r.a or "", r.b, r.v) for r in log.latest(4).collect()) == [("", "x", 4), ("y", "0", 4), ("y", "1", 3)]
    assert log.latest(4, ["v"]).columns == ["a", "b", "v"]
    keys = spark.createDataFrame([("y", "1")], "a string, b string")
    assert [(r.a, r.b, r.v) for r in log.of(4, keys, ["v"]).collect()] == [("y", "1", 3)]


def test_best_places(spark):
    rows = [("posts", "1", "Äpfel b b", "c b a\na"), ("posts", "2", None, "b"), ("posts", "3", "", ""), ("posts", "4", "x", None)]
    docs = spark.createDataFrame(rows, "collection string, id string, title string, content string")
    want = lexical.postings(lexical.token_table(docs, ["title", "content"]))
    for parts in (1, 3):
        got = lexical.best_places(docs.repartition(parts), ["title", "content"])
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert lexical.best_places(docs.filter(F.lit(False)), ["title"]).count() == 0
