"""Periodic runs, token counts and hard negatives against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from searchspark.llm import negatives, periodic, token_counts

BYTE = public_tokenizers.path("byte_bpe_50k.json")


# 11: periodic runs


def brute_runs(words):
    """All runs by comparing every word with the one a period on, for every period."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        k, alike = 0, [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        while k < len(alike):
            s = k
            while alike[k]:
                k += 1
            n = k - s + q
            if n >= max(6, 4 * q) and not any(all(words[x] == words[x + r] for x in range(s, s + n - r)) for r in range(1, q)):
                out.append((s, n, q))
            k += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, edit=True):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    if edit and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        a, g = (h // 10) % n, h // 10
        if h % 10 == 0:
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def test_runs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 200)
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = [rng.choice(["a", "b", "cc", "é"][: rng.randint(1, 4)]) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 2)):
            at, p, times = rng.randint(0, len(words)), rng.randint(1, 6), rng.randint(2, 7)
            words[at:at] = words[at : at + p] * times
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: tuple(r) for r in periodic.report(df).collect()}
    assert got == {i: brute_row(i, t) for i, t in rows}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in got) > 20 and sum(r[1] > 1 for r in got.values()) > 50


def test_runs_of_odd_documents(spark, odd, empty):
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        if len(r.text or "") < 20_000:
            want[brute_row(r.doc_id, r.text)] += 1
        else:
            words = r.text.split()
            edited = zlib.crc32(str(r.doc_id).encode()) % 10 == 0
            assert set(words) == {"word"} and not edited
            shas = (hashlib.sha256(x.encode()).hexdigest() for x in (f"0,{len(words)},1\n", "word"))
            want[r.doc_id, 1, 0, len(words), 1, 1000 * len(words), *shas] += 1
    assert Counter(map(tuple, periodic.report(odd).collect())) == want
    out = periodic.report(empty)
    assert out.count() == 0
    assert out.dtypes == [(c, "string" if "sha" in c else "bigint") for c in out.columns]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4))
def test_runs_of_few_words(docs):
    got = periodic.find_runs([np.array(d, np.int64) for d in docs])
    assert [[tuple(r) for r in g] for g in got] == [brute_runs(d) for d in docs]


def test_suffix_array_and_common_prefixes():
    rng = random.Random(5)
    docs = [[rng.randrange(3) for _ in range(n)] for n in (1, 40, 7, 60)]
    words, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    begins = np.cumsum(sizes) - sizes
    begin, end = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)
    first = np.repeat(np.arange(4), sizes) * 8 + words + 1
    sa, isa = periodic.suffix_order(first, end, 1)
    ranked = sorted(range(len(words)), key=lambda i: (begin[i], words[i : end[i]].tolist()))
    assert sa.tolist() == ranked and all(sa[isa] == np.arange(len(words)))
    lcp = periodic.common_prefixes(words, sa, isa, begin, end)
    for p, i in enumerate(sa):
        j = sa[p - 1] if p and begin[sa[p - 1]] == begin[i] else None
        n = 0
        while j is not None and max(i, j) + n < end[i] and words[i + n] == words[j + n]:
            n += 1
        assert lcp[p] == n


def test_long_periodic_documents_take_no_square_of_time():
    one, five, fib = np.zeros(200_000, np.int64), np.tile(np.arange(40_000), 5), [[0], [0, 1]]
    while len(fib[-1]) < 100_000:
        fib = [fib[-1], fib[-1] + fib[-2]]
    assert periodic.find_runs([one, five, np.array(fib[-1])]) == [[(0, 200_000, 1)], [(0, 200_000, 40_000)], []]


def test_collapsed_texts(spark, odd):
    rows = [(1, "x  y", "c"), (2, "go on and on and on and on and on.", "c"), (3, None, "c"), (4, "a\n" * 6, "c")]
    df = spark.createDataFrame(rows, "doc_id int, text string, runs string")
    assert sorted(tuple(r) for r in periodic.collapsed(df).collect()) == [
        (1, "x  y", "c"), (2, "go on and on.", "c"), (3, None, "c"), (4, "a", "c"),
    ]
    assert periodic.collapsed(odd).count() == odd.count() and periodic.collapsed(odd).columns == odd.columns


# 12: token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


def n_tokens(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_counts_of_odd_documents(spark, odd, empty, library):
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        n = n_tokens(library, r.text or "")
        want[r.doc_id, len((r.text or "").encode()), n, n > 512] += 1
    out = token_counts.report(odd, BYTE)
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert Counter(map(tuple, out.collect())) == want
    assert token_counts.report(empty, BYTE).count() == 0


PARTS = ["a", "the", " the", "ing", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", " ", "'s", "'", "1", "²", "é", "́", "😀", "中", "!", "...", "<|endoftext|>", "<|endoftext", "|>", "_", "\x7f", "\x00"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=40))
def test_counts_like_the_library(text):
    assert token_counts.counter(BYTE).count(text) == n_tokens(_library(), text)


def _library(known=[]):  # noqa: B006
    return known[0] if known else known.append(Tokenizer.from_file(BYTE)) or known[0]


def test_merging_against_a_plain_loop():
    merges = token_counts.counter(BYTE).merges
    rng = random.Random(1)
    for _ in range(500):
        word = [rng.choice("abeinrstĠ") for _ in range(rng.randint(0, 25))]
        held = word[:]
        while pairs := [(merges.rank[p], i) for i, p in enumerate(zip(held, held[1:], strict=False)) if p in merges.rank]:
            i = min(pairs)[1]
            held[i : i + 2] = [held[i] + held[i + 1]]
        assert merges.length("".join(word)) == len(held)


def test_counts_of_long_tokens(library):
    for c in ("a", "7", "-", "é", " ", "ab"):
        assert token_counts.counter(BYTE).count(c * 50_000) == n_tokens(library, c * 50_000)


def test_counts_need_a_byte_level_file():
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


# 13: hard negatives


def brute_negatives(rows):
    """Rows by plain loops over exact integers."""
    known = []
    for key, (vec_id, vector, label) in enumerate(rows):
        if vector is None or label is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        known.append((key, vec_id, label, [int(np.floor(256 * float(np.float32(x)))) for x in vector]))
    out = Counter()
    by = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    for key, anchor, label, x in known:
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, y, strict=False)), i, k, c == label) for k, i, c, y in known if k != key]
        for s, positive, _, _ in sorted((r for r in scored if r[3]), key=by)[:5]:
            fit = sorted((r for r in scored if not r[3] and 80 * s <= 100 * r[0] <= 100 * s), key=by)[:5]
            out.update((anchor, positive, n, r[1], s, r[0]) for n, r in enumerate(fit, 1))
    return out


KIND = "vec_id bigint, embedding array<float>, label int, key string, score string, x string, rank string"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], KIND)


@pytest.mark.parametrize("block", [1 << 22, 24])
def test_negatives_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK_NUMBERS", block)
    monkeypatch.setattr(negatives, "TILE", 16)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        v = (rng.normal(size=8) + 0.8).round(1 + i % 2).tolist()
        rows.append((i * 10 - 500 if i % 3 else None if i % 30 == 0 else i, v, int(i % 4) if i % 11 else 1))
    rows += [(100, None, 1), (200, [1.0, None], 1), (201, [float("nan")] * 8, 2), (300, [float("inf")], 1), (400, [1.0, 2.0], None)]
    rows += [(500, [], 1), (600, [1.0, 1.0], 1), (700, [0.0] * 8, 1), (2**63 - 1, rows[5][1], 1), (-100, rows[5][1], 2)]
    rows += [rows[10]] * 30 + [rows[40]] * 3 + [(800, rows[10][1], 3), (800, rows[10][1], 3)]
    got = Counter(tuple(r) for r in negatives.mine(table_of(spark, rows).repartition(5)).collect())
    want = brute_negatives(rows)
    assert sum(want.values()) > 100 and got == want


def test_negatives_of_odd_tables(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, None, 1)], [(100, [1.0], 1)], [(100, [], 1), (200, [], 1), (300, [], 2)]):
        out = negatives.mine(table_of(spark, rows))
        assert Counter(map(tuple, out.collect())) == brute_negatives(rows)
        assert [t for _, t in out.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    with pytest.raises(OverflowError):
        negatives.mine(table_of(spark, [(100, [1e20], 1)]))


def test_residues_give_exact_scores():
    rng = np.random.default_rng(4)
    for size, width in ((300, 700), (10**6, 300), (2**27, 64), (3 * 10**8, 40)):
        a, b = (rng.integers(-size, size, (5, width)) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
        primes = negatives.primes_for(max(abs(x) for r in want for x in r))
        got = negatives.scores([negatives.residues(a, p) for p in primes], [negatives.residues(b, p) for p in primes], primes)
        assert got.tolist() == want
    with pytest.raises(OverflowError):
        negatives.primes_for(10**400)


def test_negatives_walk_rows_in_tasks(spark):
    df = spark.range(2000).select(
        F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.sin(k * F.col("id"))).alias("embedding"),
        (F.col("id") % 10).cast("int").alias("label"),
    )
    rows = [(r.vec_id, r.embedding, r.label) for r in df.withColumn("embedding", F.col("embedding").cast("array<float>")).collect()]
    got = Counter(map(tuple, negatives.mine(df.withColumn("embedding", F.col("embedding").cast("array<float>"))).collect()))
    assert got == brute_negatives(rows)
