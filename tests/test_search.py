"""Text, vectors, search."""

import pytest
from pyspark.sql import functions as F

from searchspark.functions import paging, text
from searchspark.functions.stemmer import stem
from searchspark.operators import embed, lexical, search, semantic
from searchspark.plans.spec import CollectionSpec


def one(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [("щука ёж я", "shchuka yozh ya"), ("privet mir", "привет мир"), ("Объект", "obekt"), ("j q", "j q"), ("", "")],
)
def test_transliterate(spark, given, want):
    assert one(spark, text.transliterate(F.lit(given))) == want


def test_normalize_and_tokens(spark):
    assert one(spark, text.normalize(F.lit("  ﬁ Ａ b\n"))) == "fi a b"
    assert one(spark, text.tokens(F.lit("a-b 1_2 кот"))) == ["a", "b", "1", "2", "кот"]
    assert one(spark, text.unique_non_empty(F.array(F.lit(" A"), F.lit("a"), F.lit(" "), F.lit("b")))) == ["a", "b"]
    assert one(spark, text.all_text(F.lit('{"b":["x",{"c":"y"}],"a":"z","n":1}'))) == "z x y"


def test_stems(spark):
    df = spark.createDataFrame([(1, "Running runs проекты"), (2, "")], "id int, t string")
    got = {r.id: r.stems for r in df.select("id", text.stems(F.col("t"), stem).alias("stems")).collect()}
    assert got == {1: ["run", "проект"], 2: []}


def test_semantic_text(spark):
    c = text.semantic_text({"a": F.lit("x"), "b": F.lit(""), "c": F.lit("y")}, {"a": 0.9})
    assert one(spark, c) == "x\nx\ny"


@pytest.mark.parametrize(
    ("mode", "query", "given", "weight"),
    [
        ("", "кот", 0.0, 0.2), ("", "цветной проект дизайн", 0.0, 0.45),
        ("", "покажи мне яркие проекты про современный дизайн", 0.0, 0.7), ("LEXICAL", "a b c", 0.9, 0.0),
        ("SEMANTIC", "a", 0.3, 1.0), ("", "a", 0.3, 0.3), ("", "a", 1.5, 0.2), ("", '"a b c"', 0.0, 0.2), ("", "  ", 0.0, 0.2),
    ],
)
def test_weights(spark, mode, query, given, weight):
    assert one(spark, paging.effective_weight(F.lit(mode), F.lit(query), F.lit(given))) == weight


def test_pages(spark):
    for offset in (0, 7, 20, 12345):
        assert one(spark, paging.decode_offset(paging.encode_offset(F.lit(offset)))) == offset
    for bad in ("%%%", "abc", "LTU", None):
        assert one(spark, paging.decode_offset(F.lit(bad).cast("string"))) == 0
    assert [one(spark, paging.page_size(F.lit(n))) for n in (-1, 0, 5, 500)] == [20, 20, 5, 100]
    assert [one(spark, paging.backoff_seconds(F.lit(n))) for n in (0, 1, 2, 5, 6, 9)] == [1, 1, 2, 16, 32, 32]
    assert one(spark, paging.matched_fields(F.lit("A"), {"b": F.lit("xa"), "a": F.lit("y")})) == ["b"]
    assert one(spark, paging.matched_fields(F.lit(""), {"b": F.lit("x")})) == []


def test_filters():
    spec = CollectionSpec("c", filterable=("lang",), sortable=("n",))
    with pytest.raises(ValueError):
        search.build_filters({"other": ["x"]}, spec)
    with pytest.raises(ValueError):
        search.parse_sort(["lang:asc"], spec)


def test_encoder_keeps_order_and_survives_blanks(spark):
    df = spark.createDataFrame([("one",), (" ",), ("three",), (None,)], "t string").coalesce(1)
    got = embed.embed_texts(df, "t", lambda ts: [[float(len(t))] for t in ts], batch=1).collect()
    assert [r.vector for r in got] == [[3.0], None, [5.0], None]
    assert got[1].error and not got[0].error


def test_cache_and_backlog(spark):
    cache = spark.createDataFrame([], "content_hash string, model_version string, dimensions int, vector array<float>")
    rows = spark.createDataFrame([("h1", "a b"), ("h1", "a b"), ("h2", "c")], "content_hash string, semantic_text string")
    out, new = embed.embed_cached(rows, cache)
    assert new.count() == 2 and out.count() == 3
    lengths = out.select(F.round(semantic.dot(F.col("vector"), F.col("vector")), 4)).distinct().collect()
    assert [r[0] for r in lengths] == [1.0]
    _, more = embed.embed_cached(rows, new)
    assert more.count() == 0
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], "collection string, document_id string, revision bigint, content_hash string, model_version string, semantic_text string, attempts int, next_attempt_at timestamp, status string, last_error string")
    failed = spark.createDataFrame([("c", "1", 1, "h", "t", None), ("c", "2", 1, "h", "t", None)], "collection string, document_id string, revision bigint, content_hash string, semantic_text string, vector array<float>")
    queue = embed.enqueue_missing(failed, empty, now)
    assert queue.count() == 2
    applied = spark.createDataFrame([("c", "1", 1, "upsert"), ("c", "2", 2, "upsert")], "collection string, document_id string, revision bigint, operation string")
    index = spark.createDataFrame([("c", "1", "x", None), ("c", "2", "y", None)], "collection string, id string, title string, embedding array<float>")
    done = embed.run_backlog(queue, applied, cache, index, now)
    patched = {r.id: (r.title, r.embedding is not None) for r in done.index.collect()}
    assert patched == {"1": ("x", True), "2": ("y", False)}
    assert done.backlog.count() == 0
    retried = embed.retry_or_dead(queue.withColumn("attempts", F.lit(4)), now).first()
    assert (retried.attempts, retried.status) == (5, "dead")


def test_search_whole(spark):
    spec = CollectionSpec("c", searchable=("title", "content"), filterable=("lang",), sortable=("n",))
    unit = [1.0, 0.0]
    rows = spark.createDataFrame(
        [(1, "red bicycle", "fast", "en", 3, unit), (2, "bicicle red", "x", "en", 2, None), (3, "none", "a red old bicycle", "en", 1, [0.0, 1.0]), (4, "red bicycle", "", "de", 1, None)],
        "id bigint, title string, content string, lang string, n int, embedding array<float>",
    )
    kind = "query_id int, query string, mode string, semantic_weight double, page_size int, page_token string, vector array<float>"
    ask = lambda *q, **o: search.search(spark.createDataFrame(list(q), kind), rows, spec, {"lang": ["en"]}, **o).orderBy("rank").collect()
    assert [r.id for r in ask((1, "red bicycle", "LEXICAL", 0.0, 0, "", None))] == [1, 3, 2]
    hybrid = ask((1, "red bicycle", "", 0.5, 0, "", unit))
    assert hybrid[0].id == 1 and all(abs(r.score - r.lexical_score - r.semantic_score) < 1e-6 for r in hybrid)
    fallback = ask((1, "red bicycle", "SEMANTIC", 0.0, 0, "", None))
    assert {(r.effective_mode, r.lexical_fallback, r.weight) for r in fallback} == {("LEXICAL", True, 0.0)}
    page = ask((1, "red bicycle", "LEXICAL", 0.0, 2, "", None))
    assert [r.id for r in page] == [1, 3] and page[0].next_page_token
    rest = ask((1, "red bicycle", "LEXICAL", 0.0, 2, page[0].next_page_token, None))
    assert [(r.id, r.next_page_token) for r in rest] == [(2, "")]
    nothing = ask((1, "zzzz", "LEXICAL", 0.0, 0, "", None), (2, "red", "LEXICAL", 0.0, 5, page[0].next_page_token, None))
    assert sorted((r.query_id, r.rank, r.total, r.effective_mode) for r in nothing if r.rank is None) == [(1, None, 0, "LEXICAL")]
    ordered = ask((1, "red", "LEXICAL", 0.0, 0, "", None), sort=["n:asc"])
    assert [r.id for r in ordered] == [2, 1, 3]
    synonyms = spark.createDataFrame([("cycle", "bicycle")], "word string, synonym string")
    assert [r.id for r in ask((1, "cycle", "LEXICAL", 0.0, 0, "", None), synonyms=synonyms)] == [1, 3]


def test_search_beyond_the_nearest(spark):
    """A hit by words keeps its semantic score, and totals count, however many documents are nearer."""
    spec = CollectionSpec("c", searchable=("title",))
    rows = spark.createDataFrame([(i, "red" if i == 299 else "none", [1.0, 0.0] if i < 299 else [0.5, 0.0]) for i in range(300)], "id bigint, title string, embedding array<float>")
    kind = "query_id int, query string, mode string, semantic_weight double, page_size int, page_token string, vector array<float>"
    ask = lambda *q: search.search(spark.createDataFrame([q], kind), rows, spec).orderBy("rank").collect()
    hit = next(r for r in ask(1, "red", "", 0.5, 100, "", [1.0, 0.0]) if r.id == 299)
    assert (hit.semantic_score, hit.total) == (0.25, 300)
    last = ask(1, "red", "SEMANTIC", 0.0, 100, paging_token(spark, 250), [1.0, 0.0])
    assert [r.rank for r in last] == list(range(251, 301)) and {r.total for r in last} == {300}


def paging_token(spark, offset):
    return one(spark, paging.encode_offset(F.lit(offset)))


def test_similar_and_hashing(spark):
    rows = spark.createDataFrame([(i, [float(i == k) for k in range(4)]) for i in range(4)] + [(9, [0.9, 0.1, 0.0, 0.0])], "id bigint, embedding array<float>")
    asked = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0, 0.0])], "query_id int, document_id bigint, vector array<float>")
    assert [r.id for r in semantic.similar(asked, rows, 1).collect()] == [9]
    exact = semantic.semantic(asked, rows, 2).collect()
    near = semantic.semantic_lsh(asked, rows, 2).collect()
    assert {r.id for r in near} == {r.id for r in exact} == {0, 9}


def test_query_variants(spark):
    q = spark.createDataFrame([(1, "Privet"), (2, "Running проекты"), (3, " "), (4, None)], "query_id int, query string")
    got = {}
    for r in lexical.query_variants(q).orderBy("query_id", "n").collect():
        got.setdefault(r.query_id, []).append(r.variant)
    assert got == {1: ["privet", "привет"], 2: ["running проекты", "run проект", "running proekty", "run proekti"]}
    assert [r.variant for r in lexical.query_variants(q, stemmer=None, transliteration=False).orderBy("query_id").collect()] == ["privet", "running проекты"]


def test_variants_find_the_other_alphabet(spark):
    rows = spark.createDataFrame([("c", 1, "привет мир"), ("c", 2, "privet mir"), ("c", 3, "other")], "collection string, id bigint, title string")
    q = spark.createDataFrame([(1, "privet")], "query_id int, query string")
    tokens = lexical.token_table(rows, ["title"])
    plain = lexical.lexical(q, tokens, 1)
    both = lexical.lexical(q, tokens, 1, variants=lexical.query_variants(q))
    assert {r.id for r in plain.collect()} == {2} and {r.id for r in both.collect()} == {1, 2}


def test_transliteration_against_the_table(spark):
    """Replacing spellings one after the other against reading from left to right, longest first."""
    import random

    random.seed(5)
    table = text.LATIN_TO_CYRILLIC
    longest = sorted(table, key=lambda t: (-len(t), t))

    def slow(t):
        out = ""
        while t:
            k = next((k for k in longest if t.startswith(k)), t[0])
            out, t = out + table.get(k, k), t[len(k) :]
        return out

    latin = ["".join(random.choices("tshczkyouabq j", k=random.randint(1, 12))) for _ in range(3000)]
    cyrillic = ["".join(random.choices("щшчцхжёюяъьыэйабЩЁЪ xq", k=random.randint(1, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in latin + cyrillic], "t string")
    for r in df.select("t", text.lat_to_cyr(F.col("t")).alias("c"), text.cyr_to_lat(F.col("t")).alias("l")).collect():
        assert r.c == slow(r.t)
        lower = text.CYRILLIC_TO_LATIN
        assert r.l == "".join(lower.get(c, lower.get(c.lower(), c) if c.lower() != c else c) for c in r.t)


def test_typos_against_all_pairs(spark):
    import random

    random.seed(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    vocabulary = sorted({"".join(random.choices("abc", k=random.randint(1, 12))) for _ in range(600)} | {"é" * 5, "ééab"})
    asked = sorted({"".join(random.choices("abc", k=random.randint(1, 12))) for _ in range(80)} | {"éééé"} | set(vocabulary[:40]))
    allowed = lambda w: 0 if len(w) < 4 else 1 if len(w) < 8 else 2
    want = {(q, v, d) for q in asked for v in vocabulary if abs(len(q) - len(v)) <= 2 and (d := distance(q, v)) <= allowed(q)}
    words, vocab = spark.createDataFrame([(w,) for w in asked], "qtoken string"), spark.createDataFrame([(w,) for w in vocabulary], "token string")
    got = [tuple(r) for r in lexical.typo_candidates(words, vocab).collect()]
    assert len(got) == len(set(got)) and set(got) == want


SPEC = CollectionSpec("c", searchable=("title", "content"), returnable=("title",), semantic=("title", "content"), semantic_weights={"title": 0.9}, filterable=("lang",), embedder="e")


def lengths_encoder():
    """An encoder of prefixes and lengths; it cannot take the word "broken"."""

    def lengths(texts):
        if any("broken" in t for t in texts):
            raise ValueError("no")
        return [[float(t.startswith("query: ")), float(len(t))] for t in texts]

    return lengths


def test_similar_to_text_and_document(spark):
    rows = spark.createDataFrame([("1", "a", "b", "en", [0.0, 1.0]), ("2", "c", "", "en", [0.0, 3.0]), ("3", "", "", "de", None), ("4", "d", "e", "de", [0.0, 2.0])], "id string, title string, content string, lang string, embedding array<float>")
    asked = spark.createDataFrame([(1, "some text", "", 0, ""), (2, "", "1", 1, ""), (3, " ", "9", 0, ""), (4, None, None, 0, ""), (5, "text", "2", 0, ""), (6, "", "3", 0, "")], "query_id int, text string, document_id string, page_size int, page_token string")
    embed_ = lambda df: embed.embed_texts(df, "text", lengths_encoder())
    got = {}
    for r in search.similar(asked, rows, SPEC, embed_).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score, r.total, r.error, bool(r.next_page_token)))
    assert got[1] == [("2", 27.0, 3, None, False), ("4", 18.0, 3, None, False), ("1", 9.0, 3, None, False)]
    assert got[2] == [("2", 9.0, 2, None, True)]
    assert [x[3] for x in got[3] + got[4] + got[6]] == [search.NOT_FOUND, search.NOTHING_ASKED, search.NOTHING_ASKED]
    assert [x[0] for x in got[5]] == ["4", "1"]
    only = search.similar(asked.filter("query_id = 1"), rows, SPEC, embed_, {"lang": ["de"]}).collect()
    assert [(r.id, r.total) for r in only] == [("4", 1)]


def test_failing_encoder_fails_its_texts_only(spark):
    df = spark.createDataFrame([("one",), ("broken",), ("three",)], "t string").coalesce(1)
    got = {r.t: (r.vector, r.error) for r in embed.embed_texts(df, "t", lengths_encoder(), batch=1).collect()}
    assert got["one"] == ([0.0, 3.0], None) and got["broken"] == (None, "ValueError: no")
