"""The engine over batches: state by changed rows, enrichment, vectors, backlog, search."""

import datetime

import pytest
from pyspark.sql import functions as F

from searchspark.operators import embed
from searchspark.plans.schemas import ENVELOPE
from searchspark.plans.spec import CollectionSpec
from searchspark.streaming.engine import SearchEngine
from searchspark.streaming.state import ChangeLog

POSTS = CollectionSpec(
    "posts", searchable=("title",), filterable=("lang",), returnable=("title",), semantic=("title", "body", "n"),
    semantic_weights={"title": 0.9}, embedder="e",
)


def events(spark, *rows, start=0):
    full = [("s", f"e{start + i}", op, "posts", doc, rev, body, "", start + i) for i, (op, doc, rev, body) in enumerate(rows)]
    return spark.createDataFrame(full, ENVELOPE)


def encoder_from(path):
    """Unit vectors by the first letter; fails while the file is there."""

    def encode(texts):
        import os

        if os.path.exists(path) and any("broken" in t for t in texts):
            raise ValueError("out of order")
        return [[1.0, 0.0] if t.split(": ", 1)[1].startswith("a") else [0.0, 1.0] for t in texts]

    return encode


def changes(spark, log, state, batch, times=1):
    rows = [(f"k{(batch * 3 + i) % 10}", batch * 10 + i, i != 2) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, v int, live boolean")
    for _ in range(times):
        log.write(df, batch)
    for k, v, live in rows:
        state.pop(k, None)
        if live:
            state[k] = v


def held(log, batch):
    return {r.k: r.v for r in log.latest(batch).collect()}


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path), "t", ["k"], "k string, v int", buckets=4, fan=3)
    state, seen = {}, {}
    assert held(log, 5) == {}
    # Versions 2, 5, 8 and 9 write nothing, 4 and 10 run twice; merges come at other versions than in a row.
    for batch in range(14):
        if batch not in (2, 5, 8, 9):
            changes(spark, log, state, batch, 2 if batch in (4, 10) else 1)
        seen[batch] = dict(state)
        assert held(log, batch) == state
        keys = spark.createDataFrame([("k1",), ("k3",), ("none",)], "k string")
        assert {r.k: r.v for r in log.of(batch, keys).collect()} == {k: v for k, v in state.items() if k in ("k1", "k3")}
    assert all(held(log, b) == s for b, s in seen.items())
    assert [p["level"] for p in log.parts(13)] == [2, 0] and len(log.parts(13)) <= 2 * 3
    assert spark.read.parquet(f"{tmp_path}/t/parts/part=7").count() == 4


def test_change_log_is_written_again_after_a_loss(spark, tmp_path):
    """A part without a manifest, as a lost driver leaves it, is no part."""
    log, state = ChangeLog(spark, str(tmp_path), "t", ["k"], "k string, v int", buckets=2, fan=2), {}
    changes(spark, log, state, 0)
    before = dict(state)
    commit, log._commit = log._commit, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        changes(spark, log, dict(state), 1)
    assert held(log, 1) == before
    log._commit = commit
    changes(spark, log, state, 1)
    assert held(log, 1) == state and held(log, 0) == before


def test_change_log_vacuum(spark, tmp_path):
    log, state = ChangeLog(spark, str(tmp_path), "t", ["k"], "k string, v int", buckets=2, fan=3), {}
    for batch in range(11):
        changes(spark, log, state, batch)
    files = lambda: len(list((tmp_path / "t" / "parts").iterdir()))
    many = files()
    gone = log.vacuum(kept=1)
    assert gone and files() == many - len(gone) == len(log.parts(10)) <= 2 * 3
    assert held(log, 10) == state and log.versions() == [10] and log.vacuum(kept=1) == []
    changes(spark, log, state, 11)
    assert held(log, 11) == state


def test_change_log_spreads_a_hot_value(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path), "t", ["word", "id"], "word string, id int, v int", buckets=8, dealt_by=["word"], spread=4)
    log.write(spark.range(400).selectExpr("if(id < 300, 'hot', cast(id as string)) as word", "cast(id as int) id", "1 as v"), 0)
    buckets = spark.read.parquet(f"{tmp_path}/t/parts/part=0").filter("word = 'hot'").select("bucket").distinct().count()
    assert buckets == 4
    asked = spark.createDataFrame([("hot",), ("301",)], "word string")
    assert sorted((r.word, r.id) for r in log.of(0, asked).collect()) == sorted([("hot", i) for i in range(300)] + [("301", 301)])


def test_engine_enriches_embeds_and_searches(spark, tmp_path):
    broken = tmp_path / "broken"
    broken.write_text("")
    clock = [datetime.datetime(2024, 1, 1)]
    engine = SearchEngine(spark, [POSTS, CollectionSpec("plain")], str(tmp_path / "state"), encoder=encoder_from(str(broken)), model="m", now=lambda: F.lit(clock[0]))
    engine.process(events(
        spark, ("upsert", "1", 1, '{"title":"Apples run","body":"x","n":3,"lang":"en"}'), ("upsert", "2", 1, '{"title":"broken thing","lang":"en"}'),
        ("upsert", "3", 1, '{"title":"zebra","lang":"de","tags":["Q",{"k":"R"}]}'), ("upsert", "4", 1, '{"n":1}'),
    ), 0)
    rows = {r.id: r for r in engine.index(0).collect()}
    assert rows["1"].semantic_text == "Apples run\nApples run\nx" and rows["1"]._stems == ["x", "en", "appl", "run"]
    assert rows["1"]._search_text == "x en apples run" and rows["3"]._search_text == "de q r zebra"
    assert rows["3"]._translit == "де q р зебра"
    assert {k: r.embedding for k, r in rows.items()} == {"1": [0.0, 1.0], "2": None, "3": [0.0, 1.0], "4": None}
    assert [(r.document_id, r.status, r.attempts) for r in engine.backlog(0).collect()] == [("2", "pending", 0)]
    # A late text is tried again, and fails again; another document changes, one goes.
    engine.process(events(spark, ("upsert", "3", 2, '{"title":"apes","lang":"de"}'), ("delete", "1", 2, None), start=10), 1)
    assert [(r.document_id, r.status, r.attempts) for r in engine.backlog(1).collect()] == [("2", "retry", 1)]
    rows = {r.id: r for r in engine.index(1).collect()}
    assert set(rows) == {"2", "3", "4"} and rows["3"].embedding == [1.0, 0.0]
    # Not due yet, then due and mended: the vector is patched in and nothing else changes.
    broken.unlink()
    engine.process(events(spark, start=20), 2)
    assert engine.backlog(2).count() == 1
    clock[0] += datetime.timedelta(seconds=5)
    for _ in range(2):
        engine.process(events(spark, start=30), 3)
    assert engine.backlog(3).count() == 0
    late = {r.id: r for r in engine.index(3).collect()}["2"]
    assert late.embedding == [0.0, 1.0] and late._search_text == "en broken thing"
    assert engine.audit(3).count() == 0
    built, kept = ({r.id: (r._revision, r._search_text, r.embedding) for r in df.collect()} for df in (engine.rebuild(3), engine.index(3)))
    assert built == kept
    asked = spark.createDataFrame([(1, "broken", "LEXICAL", 0.0, 0, "", True), (2, "ape", "SEMANTIC", 0.0, 0, "", False)], "query_id int, query string, mode string, semantic_weight double, page_size int, page_token string, explain boolean")
    found = engine.search(asked, "posts", 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id, r.revision, r.title, r.matched_fields) for r in found if r.query_id == 1] == [(1, "2", 1, "broken thing", ["title"])]
    assert [(r.item_id, r.score) for r in found if r.query_id == 2] == [("3", 1.0), ("2", 0.0)]
    like = spark.createDataFrame([(7, "", "3", 0, "", False)], "query_id int, text string, document_id string, page_size int, page_token string, explain boolean")
    assert [(r.item_id, r.score) for r in engine.similar(like, "posts", 3).collect()] == [("2", 0.0)]
    with pytest.raises(KeyError):
        engine.search(asked, "nowhere", 3)
    engine.retire(["posts", "absent"])
    assert engine.index(3).count() == 0 and engine.index(2).count() == 3 and engine.postings(3).count() == 0
    # Applied state outlives a collection's retirement; the next batch goes on from it.
    assert engine.applied(3).count() == 4
    engine.process(events(spark, ("upsert", "9", 1, '{"title":"ants"}'), ("upsert", "3", 2, "{}"), start=40), 4)
    assert [r.id for r in engine.index(4).collect()] == ["9"] and engine.inbox(4).count() == 7


def test_repair(spark, tmp_path):
    engine = SearchEngine(spark, [POSTS], str(tmp_path / "state"))
    engine.process(events(spark, *(("upsert", str(i), 1, f'{{"title":"word{i} common"}}') for i in range(12))), 0)
    engine.process(events(spark, ("upsert", "3", 2, '{"title":"changed"}'), ("delete", "4", 2, None), start=20), 1)
    whole = lambda: sorted((r.id, r._revision, r._search_text, tuple(r.embedding)) for r in engine.index(1).collect())
    places = lambda: sorted(map(tuple, engine.postings(1).collect()))
    before, lists = whole(), places()
    assert engine.repair() == 0 and engine.audit(1).count() == 0
    held = engine.index(1)
    lost = held.filter("id in ('1', '2')").withColumn("live", F.lit(False))
    old = held.filter("id = '3'").withColumns({"_revision": F.lit(1).cast("bigint"), "document": F.lit('{"title":"old"}'), "live": F.lit(True)})
    extra = held.filter("id = '5'").withColumns({"id": F.lit("77"), "live": F.lit(True)})
    engine._change_index(lost.unionByName(old).unionByName(extra), 1_001)
    assert whole() != before and places() != lists
    assert {r.id for r in engine.audit(1).collect()} == {"1", "2", "3", "77"}
    assert engine.repair() == 4
    assert whole() == before and places() == lists and engine.audit(1).count() == 0 and engine.repair() == 0


def test_postings_follow_changed_documents(spark, tmp_path):
    engine = SearchEngine(spark, [POSTS, CollectionSpec("plain")], str(tmp_path / "state"))
    engine.process(events(spark, ("upsert", "1", 1, '{"title":"red red bicycle"}'), ("upsert", "2", 1, '{"title":"red car"}')), 0)
    engine.process(events(spark, ("upsert", "1", 2, '{"title":"blue bicycle"}'), ("delete", "2", 2, None), start=9), 1)
    listed = lambda b: sorted((r.token, r.id, r.pos) for r in engine.postings(b).collect())
    assert listed(0) == [("bicycle", "1", 2), ("car", "2", 1), ("red", "1", 0), ("red", "2", 0)]
    assert listed(1) == [("bicycle", "1", 1), ("blue", "1", 0)]


def test_another_model_is_filled_in_by_passes(spark, tmp_path):
    one, two = (lambda v: lambda texts: [v] * len(texts))([1.0, 0.0]), (lambda v: lambda texts: [v] * len(texts))([0.0, 1.0])
    engine = SearchEngine(spark, [POSTS], str(tmp_path / "state"), encoder=one, model="one", per_pass=2)
    engine.process(events(spark, *(("upsert", str(i), 1, f'{{"title":"t{i}"}}') for i in range(5))), 0)
    assert engine.use_model("two", two) == 5 and engine.use_model("two", two) == 0
    left = []
    for batch in range(1, 5):
        engine.process(events(spark, *([("upsert", "0", 2, '{"title":"new"}')] if batch == 1 else []), start=50 * batch), batch)
        left.append((sum(r.embedding == [0.0, 1.0] for r in engine.index(batch).collect()), engine.backlog(batch).count()))
    assert left[-1] == (5, 0) and [n for _, n in left] == sorted((n for _, n in left), reverse=True) and left[0][0] < 5


def test_outdated_backlog_is_closed(spark, tmp_path):
    broken = tmp_path / "broken"
    broken.write_text("")
    engine = SearchEngine(spark, [POSTS], str(tmp_path / "state"), encoder=encoder_from(str(broken)), model="m")
    engine.process(events(spark, ("upsert", "1", 1, '{"title":"broken"}')), 0)
    engine.process(events(spark, ("upsert", "1", 2, '{"title":"whole"}'), start=5), 1)
    assert engine.backlog(1).count() == 0
    assert engine.index(1).first().embedding == [0.0, 1.0]


def test_hashed_vectors_by_default(spark, tmp_path):
    engine = SearchEngine(spark, [POSTS], str(tmp_path / "state"))
    engine.process(events(spark, ("upsert", "1", 1, '{"title":"red bicycle"}'), ("upsert", "2", 1, '{"title":"blue car"}')), 0)
    assert engine.index(0).filter(F.size("embedding") == embed.DIMENSIONS).count() == 2
    like = spark.createDataFrame([(7, "bicycle", None, 0, "")], "query_id int, text string, document_id string, page_size int, page_token string")
    found = engine.similar(like.withColumn("explain", F.lit(False)), "posts", 0).orderBy("rank").collect()
    assert found[0].item_id == "1" and found[0].score > found[1].score


def test_declared_fields_are_stored_by_type(spark, tmp_path):
    kinds = {"n": "bigint", "price": "double", "at": "timestamp", "tags": "array<string>", "ok": "boolean", "a.b": "string"}
    spec = CollectionSpec("posts", searchable=("title",), filterable=(*kinds, "lang", "id"), sortable=("n", "price"), types=kinds)
    engine = SearchEngine(spark, [spec], str(tmp_path / "state"))
    engine.process(events(
        spark, ("upsert", "1", 1, '{"title":"red","n":9,"price":2,"at":"2024-05-01T10:00:00Z","tags":["x","y"],"ok":true,"a.b":"flat","lang":"de"}'),
        ("upsert", "2", 1, '{"title":"red","n":"10","price":1.5,"tags":"x","ok":false,"a":{"b":"deep"},"lang":5}'),
        ("upsert", "3", 1, '{"title":"red","n":2.5,"price":"dear","tags":[1,{"k":"x"},null],"lang":["de"]}'),
        ("upsert", "4", 1, '{"title":"red","n":100,"tags":[]}'), ("upsert", "6", 1, '{"title":"red"}'),
    ), 0)
    ids = lambda batch, **f: sorted(r.id for r in engine.listed("posts", batch, {k.replace("__", "."): v for k, v in f.items()}).collect())
    assert ids(0) == ["1", "2", "3", "4", "6"] and ids(0, id=["2", "9"]) == ["2"] and ids(0, n=[]) == ids(0)
    assert ids(0, n=[9, 10]) == ["1", "2"] and ids(0, n=["x", "100"]) == ["4"] and ids(0, n=[2]) == []
    assert ids(0, price=[2, "1.5"]) == ["1", "2"] and ids(0, ok=["true"]) == ["1"] and ids(0, at=["2024-05-01T12:00:00+02:00"]) == ["1"]
    assert ids(0, tags=["x"]) == ["1", "2"] and ids(0, tags=["1"]) == ["3"] and ids(0, tags=["y", "z"], n=[9]) == ["1"]
    assert ids(0, a__b=["flat"]) == ["1"] and ids(0, a__b=["deep"]) == ["2"] and ids(0, lang=["de"]) == ["1"] and ids(0, lang=["5"]) == ["2"]
    with pytest.raises(ValueError):
        ids(0, title=["red"])
    with pytest.raises(ValueError):
        engine.listed("posts", 0, fields=("title",))
    # Rows of older versions that meet a filter do not count, nor do documents that went; numbers sort as numbers.
    engine.process(events(spark, ("upsert", "1", 2, '{"title":"red","n":30}'), ("delete", "2", 2, None), start=20), 1)
    assert ids(1, n=[9, 10, 30]) == ["1"] and ids(1, lang=["de"]) == [] and ids(0, n=[9]) == ["1"]
    asked = spark.createDataFrame([(1, "red", "LEXICAL", 0.0, 0, "", False)], "query_id int, query string, mode string, semantic_weight double, page_size int, page_token string, explain boolean")
    found = lambda *sort, **f: [r.item_id for r in engine.search(asked, "posts", 1, filters=f or None, sort=list(sort)).orderBy("rank").collect()]
    assert found("n:asc") == ["1", "4", "3", "6"] and found("n:desc") == ["4", "1", "3", "6"] and found("n:asc", n=[30, 100]) == ["1", "4"]
    engine.retire(["posts"])
    assert ids(1) == []


def test_filters_reach_the_files_of_stored_fields(spark, tmp_path):
    spec = CollectionSpec("posts", searchable=("title",), filterable=("n",), types={"n": "bigint"})
    engine = SearchEngine(spark, [spec], str(tmp_path / "state"))
    engine.process(events(spark, *(("upsert", str(i), 1, f'{{"title":"t","n":{i}}}') for i in range(20))), 0)
    engine.process(events(spark, ("upsert", "3", 2, '{"n":4}'), start=50), 1)
    rows = engine.listed("posts", 1, {"n": ["4", "7"]})
    assert sorted(r.id for r in rows.collect()) == ["3", "4", "7"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "In(f0_n, [4,7])" in plan and "document" not in plan


def test_fields_declared_after_documents_came(spark, tmp_path):
    before = SearchEngine(spark, [CollectionSpec("posts", searchable=("title",))], str(tmp_path / "state"))
    before.process(events(spark, *(("upsert", str(i), 1, f'{{"n":{i}}}') for i in range(4))), 0)
    spec = CollectionSpec("posts", searchable=("title",), filterable=("n",), types={"n": "double"})
    engine = SearchEngine(spark, [spec], str(tmp_path / "state"))
    ids = lambda batch: sorted(r.id for r in engine.listed("posts", batch, {"n": ["2.0", 3]}).collect())
    assert ids(0) == ["2", "3"]
    for _ in range(2):
        engine.process(events(spark, ("upsert", "0", 2, '{"n":3}'), ("delete", "3", 2, None), start=9), 1)
        assert ids(1) == ["0", "2"] and ids(0) == ["2", "3"]
    assert engine._fields["posts"].latest(1_000).count() == 3


def test_types_of_fields():
    for types in ({"n": "number"}, {"id": "bigint"}, {"*": "string"}):
        with pytest.raises(ValueError):
            CollectionSpec("posts", types=types)
