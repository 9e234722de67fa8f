"""Each operator on odd texts, against brute force or an exact round trip."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from searchspark.llm import jaccard, merkle, mixing, ogg, packing, pii, quality, sketch, substrings, token_files, tokens, toxicity
from searchspark.llm.components import components

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD_LINE = "The quick brown fox jumps over the lazy dog while seven wizards watch from a very old stone bridge near town. " * 3
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df):
    """(doc_id, text) of all rows, in the order of documents."""
    return sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda p: (p[0] is None, p[0] or 0, p[1]))


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# 1: fingerprints


def test_fingerprints(spark, odd, empty):
    docs = pairs(odd)
    got = sorted(merkle.report(odd).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want = Counter()
    for i, (d, t) in enumerate(docs):
        q = len(t) // 4
        want[d, len(t), hashlib.sha256((t[: len(t) - q] + docs[(i + 1) % len(docs)][1][:q]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = defaultdict(set)
    for r, (_, t) in zip(got, docs, strict=True):
        if r.doc_id not in (3, None):
            by_text[t].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert {r.fingerprint for r in got if r.n_chars == len(ODD_LINE)} == {next(iter(by_text[ODD_LINE]))}
    assert merkle.report(empty).count() == 0


def brute_fingerprint(text):
    """The tree by a plain loop over characters."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections, all_leaves = [], set()
    for section in text.split("\n\n"):
        nodes = []
        for paragraph in section.split("\n"):
            leaf_nodes, piece = [], ""
            for c in paragraph:
                if len(piece) == 24:
                    leaf_nodes, piece = [*leaf_nodes, sha(piece)], ""
                piece += c
                if c in ".!?" and len(piece) <= 24:
                    leaf_nodes, piece = [*leaf_nodes, sha(piece)], ""
            leaf_nodes += [sha(piece)] if piece else []
            all_leaves |= {x[:8] for x in leaf_nodes}
            nodes.append(sha(",".join(leaf_nodes)))
        sections.append((sha(",".join(nodes)), nodes))
    upper = ";".join(f"{n[:8]}:{','.join(p[:8] for p in ps)}" for n, ps in sections)
    return f"{sha(','.join(n for n, _ in sections))}|{upper}|{','.join(sorted(all_leaves)[:128])}"


def test_fingerprints_against_a_plain_loop(spark):
    texts = ["", "a", "a.b", "\n", "One. Two!\nThree\n\nFour " + "x" * 60 + ".", "y" * 24 + "." + "z" * 23 + "!", "é😀" * 30 + "\n\n\n."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in merkle.report(df).collect()}
    for i, t in enumerate(texts):
        q, n = len(t) // 4, texts[(i + 1) % len(texts)]
        assert got[i].fingerprint == brute_fingerprint(t)
        edited = t[: len(t) - q] + n[:q]
        assert got[i].edited_fingerprint == brute_fingerprint(edited)
        a, b = ([p.split("\n") for p in x.split("\n\n")] for x in (t, edited))
        places = [f"{s}:{p}" for s in range(max(len(a), len(b))) for p in range(max(len(x[s]) if s < len(x) else 0 for x in (a, b))) if (s >= len(a) or s >= len(b) or p >= len(a[s]) or p >= len(b[s]) or a[s][p] != b[s][p])]
        assert got[i].edit_places == ",".join(places)


def test_fingerprint_order_over_many_ranges(spark):
    rows = [(i * 7 % 1000, f"text {i}. " * (i % 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = dict(rows)
    for r in merkle.report(df).collect():
        t, n = texts[r.doc_id], texts[(r.doc_id + 1) % 1000]
        q = len(t) // 4
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()


def test_edits_are_located(spark):
    a = spark.createDataFrame([(1, "a\nb\n\nc\nd"), (2, "same"), (None, "n"), (3, "x"), (3, "y")], "doc_id int, text string")
    b = spark.createDataFrame([(1, "a\nb\n\nc\nX\ny"), (2, "same"), (None, "m"), (3, "y"), (3, "x"), (4, None)], "doc_id int, text string")
    found = {(r.doc_id, r.section, r.paragraph) for r in merkle.locate_edits(a, b).collect()}
    assert found == {(1, 1, 1), (1, 1, 2), (None, 0, 0), (4, 0, 0)}


def test_alike_texts_have_alike_fingerprints(spark):
    text = " ".join(f"Sentence number {i} says {i * i}." for i in range(60))
    df = spark.range(1).select(
        merkle.fingerprint(F.lit(text)).alias("a"), merkle.fingerprint(F.lit(text.replace("number 7 ", "number seven "))).alias("b"),
        merkle.fingerprint(F.lit("Other words entirely, and more of them.")).alias("c"),
    )
    near, far, same = df.select(merkle.likeness(F.col("a"), F.col("b")), merkle.likeness(F.col("a"), F.col("c")), merkle.likeness(F.col("a"), F.col("a"))).first()
    assert 0.9 < near < 1 and far == 0 and same == 1


# 2: quality


def test_quality(spark, odd, labels, empty):
    out = quality.score(odd, labels, leave_out=())
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert out.filter("keep is null or quality is null or quality < 0 or quality > 1").count() == 0
    kept = quality.good_documents(odd, labels)
    assert kept.columns == odd.columns
    assert quality.good_documents(empty, labels).count() == 0
    assert quality.score(odd, labels.filter("false")).count() == odd.count()


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = quality.report(docs, labels.filter(~held)).join(labels.filter(held).withColumnRenamed("quality", "label"), "doc_id").collect()
    good = [r for r in got if r.label == 1]
    bad = [r for r in got if r.label == 0]
    assert sum(r.keep for r in good) >= 0.98 * len(good)
    assert sum(not r.keep for r in bad) >= 0.85 * len(bad)


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "p", 0.9)] * 200 + [("big", "p", 0.7)] * 200 + [("bad", "p", 0.1)] * 400 + [("small", "p", 0.0)] * 2
    rates = {r.source: r.path_rate for r in quality.site_rates(spark.createDataFrame(rows, "source string, lang string, evidence double"))[0].collect()}
    assert rates["big"] > 0.75 and rates["bad"] < 0.2 and 0 < rates["small"] < 0.5


@pytest.mark.parametrize("seed", range(3))
def test_site_posteriors_against_plain_sums(spark, seed):
    """Nested analysis of variance, posteriors and final odds by loops over the rows."""
    random = np.random.default_rng(seed)
    rows = []
    for h in [None, "a", "b", "c", "d"][: 5 if seed else 1]:
        for p in [None, "x", "y", "z"][: int(random.integers(1, 5)) if seed else 1]:
            rows += [(h, p, float(e)) for e in random.beta(2 + random.integers(0, 6), 2, int(random.integers(1, 30)))]
    df = spark.createDataFrame(rows, "source string, lang string, evidence double")
    by_path, by_host = defaultdict(list), defaultdict(list)
    for h, p, e in rows:
        by_path[h, p].append(e)
        by_host[h].append(e)
    n, mean = len(rows), float(np.mean([e for _, _, e in rows]))
    dev = lambda groups: sum(float(np.sum((np.array(g) - np.mean(g)) ** 2)) for g in groups)
    ssw, ssh = dev(by_path.values()), dev(by_host.values())
    m = sum(sum(len(g) ** 2 for (x, _), g in by_path.items() if x == h) / len(by_host[h]) for h in by_host)
    share = lambda a, b: max(0.0, a / b) if b > 1e-9 else 0.0
    within = share(ssw, n - len(by_path))
    paths = share(ssh - ssw - (len(by_path) - len(by_host)) * within, n - m)
    rest = (len(by_host) - 1) * within + (m - sum(len(g) ** 2 for g in by_path.values()) / n) * paths
    hosts = share(dev([[e for _, _, e in rows]]) - ssh - rest, n - sum(len(g) ** 2 for g in by_host.values()) / n)
    got, v = quality.site_rates(df)
    assert (v.mean, v.within, v.paths, v.hosts) == pytest.approx((mean, within, paths, hosts), abs=1e-9)
    within = max(within, quality.LEAST_WITHIN)
    for r in got.collect():
        assert (r.host_rate, r.path_rate) == pytest.approx(gaussian_rates(rows, r.source, r.lang, mean, within, paths, hosts), abs=1e-9)


def gaussian_rates(rows, host, path, mean, within, paths, hosts):
    """Posterior means of a host's and a path's rate by the joint normal distribution of both with all evidence."""
    if not rows:
        return mean, mean
    h, p, e = zip(*rows, strict=True)
    same_h = np.array([[x == y for y in h] for x in h], float)
    same_p = np.array([[(h[i], p[i]) == (h[j], p[j]) for j in range(len(e))] for i in range(len(e))], float)
    around = np.linalg.solve(hosts * same_h + paths * same_p + within * np.eye(len(e)), np.array(e) - mean)
    with_h = hosts * np.array([x == host for x in h])
    with_p = with_h + paths * np.array([(x, y) == (host, path) for x, y in zip(h, p, strict=True)])
    return mean + with_h @ around, mean + with_p @ around


def test_rates_leave_the_document_out(spark):
    """The rate that each document meets is that of all others, in its path and its host."""
    random = np.random.default_rng(8)
    rows = [(h, p, float(e)) for h, p, n in (("a", "x", 9), ("a", "y", 1), ("b", "x", 4), (None, "x", 3), ("c", None, 1)) for e in random.beta(3, 2, n)]
    df = spark.createDataFrame(rows, "source string, lang string, evidence double")
    sites, v = quality.site_rates(df)
    on = F.col("source").eqNullSafe(F.col("_h")) & F.col("lang").eqNullSafe(F.col("_p"))
    named = sites.select(F.col("source").alias("_h"), F.col("lang").alias("_p"), "n", "s", "weight", "weighted")
    rate = quality.rate_of_others(*map(F.col, ("n", "s", "weight", "weighted", "evidence")), v)
    got = df.join(named, on).withColumn("rate", rate).collect()
    assert len(got) == len(rows)
    for r in got:
        rest = rows[:]
        rest.remove((r.source, r.lang, r.evidence))
        want = gaussian_rates(rest, r.source, r.lang, v.mean, max(v.within, quality.LEAST_WITHIN), v.paths, v.hosts)[1]
        assert r.rate == pytest.approx(want, abs=1e-6)
        if r.source == "c":
            assert r.rate == pytest.approx(v.mean)


# 3: media


def test_ogg_round_trip(odd, empty):
    got = ogg.media_table(odd).collect()
    assert len(got) == odd.count() and ogg.media_table(empty).count() == 0
    want = Counter()
    for d, t in pairs(odd):
        p = ogg.padded(t.encode())
        media = ogg.encode(p)
        want[d, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == want
    assert ogg.with_media(odd).filter("media = 'clash'").count() == 0


def test_ogg_details():
    # Fixed value: CRC of the nine digits with this polynomial, start and end 0, not mirrored.
    assert ogg.page_checksum(b"123456789") == 0x89A1897F
    for n in (1, 64, 254, 255, 256, 999, 1000, 1001, 17_000, 70_000):
        data = bytes(i * 7 % 251 for i in range(n))
        media = ogg.encode(data)
        back, found = ogg.decode(media)
        assert back == data and media == ogg.encode(data)
        assert sum(found.seconds.values()) == pytest.approx(n / ogg.RATE)
        for stream, packets in found.packets.items():
            assert found.times[stream] == pytest.approx(np.cumsum([0, *map(len, packets[1:])]) / ogg.RATE)
        broken = bytearray(media)
        broken[len(media) // 2] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.decode(bytes(broken))
    with pytest.raises(ogg.OggError):
        ogg.decode(media[:-5])


def test_ogg_continued_packets():
    pages = ogg._stream(9, [(b"h" * 10, 0), (b"x" * 40_000, 40_000), (b"y" * 510, 40_510)])
    flags = [p[5] for p in pages]
    assert flags[0] == ogg.FIRST and flags[-1] & ogg.LAST and any(f & ogg.CONTINUED for f in flags)
    assert len(pages[1]) <= 27 + ogg.PAGE_SEGMENTS * 256


# 4 and 9: ids


def ids_of(path, end, docs):
    t = Tokenizer.from_file(path)
    return [(d, t.encode(x, add_special_tokens=False).ids + [end]) for d, x in docs]


def test_packing(odd, empty):
    got = packing.pack(odd, BYTE, end_id=1).collect()
    assert packing.pack(empty, BYTE, end_id=1).count() == 0
    want = Counter((d, crc(i), len(i)) for d, i in ids_of(BYTE, 1, pairs(odd)))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(n * c for (_, _, n), c in want.items()) // 2048)
    unique = {d: i for d, i in ids_of(BYTE, 1, pairs(odd)) if sum(x == d for x, _ in pairs(odd)) == 1}
    for d, ids in unique.items():
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        at = 0
        for r in mine:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in got) == sum(n * c for (_, _, n), c in want.items())


def test_costs_are_balanced():
    random = np.random.default_rng(3)
    lengths = np.sort(random.integers(1, 600, 900))[::-1]
    placed = packing.assign(lengths, 2048)
    used, cost = Counter(), Counter()
    for _, _, n, k, _ in placed:
        used[k] += n
        cost[k] += packing.LINEAR * n + packing.SQUARE * n * n
    assert max(used.values()) <= 2048 and sum(used.values()) == lengths.sum()
    assert len(used) == -(-int(lengths.sum()) // 2048)
    assert max(cost.values()) < 1.15 * min(cost.values()) or len(placed) > len(lengths)


def test_token_files(odd, empty):
    got = token_files.token_files(odd, WORD, end_id=2).orderBy("start").collect()
    want, at = [], 0
    for d, ids in ids_of(WORD, 2, pairs(odd)):
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert token_files.token_files(empty, WORD, end_id=2).count() == 0


@pytest.mark.parametrize(("path", "drops_space"), [(BYTE, False), (WORD, True)])
def test_ids_do_not_depend_on_texts_before(path, drops_space):
    """Pieces put together from a warm cache against the library on whole texts."""
    random = np.random.default_rng(11)
    letters = ["\u0130", "i", "I", "\u0307", "e\u0301", "\u0301", "\u00ad", "\u03a3", "s", "Stra\u00dfe", "\u0e01", "\U0001f600", "x1", "don't", "'s", "\u2019s", "<|endoftext|>", "\ufb01", "\u1e9e", "9"]
    marks, spaces = [".", ",", "!", "?", "...", ":", ";", "-", "", ""], [" ", " ", " ", "\n", "  ", " \n", "\t", "\u00a0"]
    ours, whole = tokens.PieceEncoder(path, drops_space), Tokenizer.from_file(path)
    for _ in range(4000):
        n = random.integers(1, 9)
        word = lambda: "".join(random.choice(letters, random.integers(1, 4)))
        text = "".join(word() + str(random.choice(marks)) + str(random.choice(spaces)) for _ in range(n))
        got = np.frombuffer(ours.encode(text), "<u4").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_keep_extreme_ids_and_refuse_large_ones(spark):
    df = spark.createDataFrame([(-(1 << 63), "a"), (None, "b"), (7, "c d"), ((1 << 53) + 1, "e"), (None, None)], "doc_id bigint, text string")
    got = token_files.token_files(df, WORD, end_id=2).orderBy("start").collect()
    assert [r.doc_id for r in got] == [-(1 << 63), 7, (1 << 53) + 1, None, None]
    packed = packing.pack(df, BYTE, end_id=1)
    assert {r.doc_id for r in packed.collect()} == {-(1 << 63), 7, (1 << 53) + 1, None}
    with pytest.raises(Exception, match="does not fit"):
        token_files.token_files(df, WORD, end_id=70_000)


# 5: substrings


def removed(docs):
    seen, out = set(), Counter()
    for d, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [20_000, 0])
def test_substrings(odd, empty, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    spark = odd.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    got = Counter(tuple(r) for r in substrings.report(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == removed(pairs(odd))
    assert substrings.report(empty).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_frequent_hashes(spark, monkeypatch):
    monkeypatch.setattr(sketch, "STRETCH", 500)
    df = spark.range(4000).withColumn("v", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 100)).repartition(4)
    known, times = sketch.frequent(df, lambda b: [b["v"].to_numpy(np.int64).view(np.uint64)], 100)
    assert known.tolist() == [7] and times.tolist() == [1334]
    assert sketch.found_at(known, np.array([6, 7, 8], np.uint64))[0].tolist() == [False, True, False]
    assert sketch.frequent(df.filter("false"), lambda b: [], 1)[0].tolist() == []


def test_substrings_with_unique_ids(spark):
    random = np.random.default_rng(1)
    pool = ["".join(random.choice(list("abcd "), 140)) for _ in range(12)]
    rows = [(int(i), "".join(pool[j][k:] for j, k in zip(random.integers(0, 12, 4), random.integers(0, 60, 4), strict=True))) for i in random.permutation(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in substrings.report(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == removed(pairs(df))


# 6: mixing


def water(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark, odd, empty):
    rows = [(i, "w " * (1 + i * 37 % 300), f"s{i % 7}" if i % 11 else None) for i in range(3000)]
    for df in (spark.createDataFrame(rows, "doc_id bigint, text string, source string"), odd):
        got, again = mixing.mix(df).collect(), mixing.mix(df).collect()
        key = lambda rs: sorted((repr(r.doc_id), r.size, r.target, r.taken) for r in rs)
        assert key(got) == key(again) and len(got) == df.count()
        sizes, taken, target = Counter(), Counter(), {}
        sources = {(r.doc_id, len(WORDS.findall(r.text or ""))): r.source for r in df.collect()}
        for r in got:
            s = sources[r.doc_id, r.size]
            sizes[s] += r.size
            taken[s] += r.taken
            target[s] = r.target
            assert 0 <= r.taken <= 2 * r.size
        want = water(sizes)
        for s in sizes:
            assert target[s] == pytest.approx(want[s])
            assert abs(taken[s] - target[s]) <= 3 * mixing.BLOCK
    assert mixing.mix(empty).count() == 0
    spaced = [(i, f" a\n\nb{i}  c\t d\n" * (1 + i % 40), f"s{i % 3}") for i in range(500)] + [(900, " \n", "s0"), (901, None, None)]
    original = {d: t for d, t, _ in spaced}
    for r in mixing.mixed_documents(spark.createDataFrame(spaced, "doc_id bigint, text string, source string")).collect():
        assert original[r.doc_id].startswith(r.text) and r.text.strip()
    mixed = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(taken_ for taken_ in [r.taken for r in mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()])


def test_sainte_lague_by_highest_quotients(spark):
    random = np.random.default_rng(2)
    for seats in (0, 1, 5, 40, 1000):
        votes = [int(v) for v in random.integers(0, 900, 12)]
        df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "p int, v bigint, s bigint")
        got = {r.p: r.quota for r in mixing.sainte_lague(df, [], "v", "s", [F.col("p")]).collect()}
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(seats)))[:seats]
        assert got == {i: Counter(i for _, i in quotients)[i] for i in range(12)}


# 7: n-grams


def brute_components(docs, rule):
    sets = []
    for _, t in docs:
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets.append(frozenset(tuple(w[i : i + rule.n]) for i in range(max(1, len(w) - rule.n + 1))) if w else frozenset())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rule.den * len(a & b) >= rule.num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))


def chain(n, step):
    """Texts that change a few words each time, so that neighbours are alike and ends are not."""
    words = [f"w{i}" for i in range(120)]
    out = []
    for k in range(n):
        out.append((1000 + k, " ".join(words)))
        for j in range(step):
            words[(k * step + j) * 7 % 120] = f"n{k}_{j}"
    return out


@pytest.mark.parametrize("rule", [jaccard.Rule(4, 85, 100), jaccard.Rule(), jaccard.Rule(2, 50, 100)])
def test_jaccard(spark, odd, empty, rule):
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(chain(25, 2), "doc_id bigint, text string"))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.cluster(df, rule).collect())
    assert got == brute_components(pairs(df), rule)
    assert jaccard.cluster(empty, rule).count() == 0


def test_jaccard_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "TRIE", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_NODES", 0)
    df = spark.createDataFrame(chain(30, 2), "doc_id bigint, text string")
    rule = jaccard.Rule(4, 85, 100)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.cluster(df, rule).collect())
    assert got == brute_components(pairs(df), rule)


def test_jaccard_of_lone_pairs_in_different_blocks(spark, monkeypatch):
    """Pairs whose shared tokens all lie in many texts of other sizes, and that nothing else is close to."""
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    rows = []
    for passage in range(4):
        words = [f"p{passage}w{i}" for i in range(400)]
        for size in (int(20 * 1.22**k) for k in range(15)):
            rows += [(len(rows) + k, " ".join(words[:size] + [f"end{k}"])) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    rule = jaccard.Rule(4, 85, 100)
    want = brute_components(pairs(df), rule)
    assert len({c for _, _, c in want}) == len(rows) // 2
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.cluster(df, rule).collect())
    assert got == want


def test_one_of_each_group_stays(odd, empty):
    kept = jaccard.deduplicate(odd)
    assert kept.columns == odd.columns and jaccard.deduplicate(empty).count() == 0
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    assert left[6, odd.filter("doc_id = 6").first().text] == 1
    # Two texts of two words are equal; five hold the same line, once or more often.
    assert sum(left.values()) == odd.count() - 6


def test_trie_against_sets():
    random = np.random.default_rng(4)
    base = np.sort(random.integers(0, 1 << 60, 300).astype(np.uint64))[::-1]
    sets = [np.sort(random.choice(base, n, replace=False))[::-1] for n in random.integers(200, 300, 40)]
    rule = jaccard.Rule(4, 85, 100)
    want = [k for k, s in enumerate(sets) if 100 * (i := len(np.intersect1d(s, base))) >= 85 * (len(s) + len(base) - i)]
    assert sorted(jaccard.trie_links(base, sets, rule)) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 8: toxicity


def test_toxicity_on_held_out_rows(spark, odd, empty, labels):
    out = toxicity.classify(odd, labels)
    assert out.count() == odd.count() and toxicity.classify(empty, labels).count() == 0
    assert out.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    random = np.random.default_rng(0)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "so", "ti", "ve") for c in ("n", "l", "st")]
    rows = []
    for i in range(1500):
        bad = i % 6 == 0
        text = list(random.choice(words, 30)) + (["vilest", "gobbling"] if bad else [])
        rows.append((i, " ".join(random.permutation(text)), int(bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = toxicity.classify(df, df.select("doc_id", "toxic").filter("doc_id % 2 = 0")).join(df, "doc_id").filter("held_out").collect()
    assert {r.doc_id for r in got} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)


def test_negative_part_of_the_risk_stays_non_negative():
    """Slopes against differences of the estimated risk; the correction fires exactly below zero."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    is_pos = np.array([True] * 3 + [False] * 5)
    fired = set()
    for seed in range(40):
        z, p = np.random.default_rng(seed).normal(0, 2, 8), 0.4
        positive = lambda z: p * sigmoid(-z[is_pos]).mean()
        negative = lambda z: sigmoid(z[~is_pos]).mean() - p * sigmoid(z[is_pos]).mean()
        slopes, back = toxicity.risk_slopes(sigmoid(z), is_pos, p)
        assert back == (negative(z) < 0)
        fired.add(back)
        risk = (lambda z: -negative(z)) if back else (lambda z: positive(z) + negative(z))  # noqa: B023
        step = lambda i: 1e-6 * np.eye(8)[i]
        assert slopes == pytest.approx([(risk(z + step(i)) - risk(z - step(i))) / 2e-6 for i in range(8)], abs=1e-6)
    assert fired == {True, False}
    texts = ["a bad"] * 40 + ["a fine"] * 60
    weights, b = toxicity.train(texts, np.array([True] * 40 + [False] * 60), 0.3)
    z = {t: b + sum(weights.get(f, 0.0) for f in toxicity.features(set(t.split()))) for t in set(texts)}
    assert z["a bad"] > 0 > z["a fine"]
    assert toxicity.train([], np.array([], dtype=bool), 0.2)[0] == {}


# 10: personal data

FIXED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1]))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_personal_data(spark, odd, empty):
    more = [
        "a@b.c.+d@e.f x@y 😀a@b.co", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255", "+12345678..9 +1 2", "1 " * 9000 + "2" * 9000,
        "4111 1111 1111 1111 +1 (555) 123-4567 4111-1111-1111-1112", "x" * 3000 + "@" + "y.z" * 2000,
    ]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(more)], "doc_id bigint, text string"))
    want = Counter()
    for d, t in pairs(df):
        found = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if valid(k, m.group())] for k, p in FIXED.items()}
        digest = hashlib.sha256(",".join(sum(found.values(), [])).encode()).hexdigest()
        want[d, *(len(found[k]) for k in FIXED), digest] += 1
    got = pii.report(df).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.report(empty).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881"]
    rows = [(i, f"Then the member card: {c} was read.") for i, c in enumerate(cards)] + [(10, "His member card: A-12345 was read, in room 12345."), (11, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert got[10] == "id:17:24" and got[11] == ""
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[10] == "His member card: [id] was read, in room 12345." and clean[11] is None
    assert clean[0] == "Then the member card: [card] was read."


def test_base_spans_of_every_kind_are_seeds(spark):
    """Phone numbers, addresses and spaced cards seed contexts, after signs and line feeds too."""
    phones = [f"Please call {n} now." for n in ("+1 (555) 123-4567", "+1 (555) 123-4568", "+44 20 7946 0958")]
    hosts = [f"log | server ip\n{n} up" for n in ("10.0.0.1", "10.0.0.2", "10.0.0.3")]
    rows = [*phones, *hosts, "Please call 555 1234 77 now.", "log | server ip\nfe80-12-9 up", "Nobody calls 555 1234 77 here."]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert [got[6], got[7], got[8]] == ["id:12:23", "id:16:25", ""]


def brute_contexts(texts):
    """The graph scored by plain loops: spans of the kind id by text."""
    context = r"(?:[^\W\d_]+(?:[^\w]|_){1,4}){1,2}"
    candidate = re.compile(rf"(?<![^\W\d_])({context})((?=[A-Za-z._%@(-]*[0-9])[A-Za-z0-9][A-Za-z0-9._%+@()-]*(?: [0-9(][A-Za-z0-9._%+@()-]*){{0,8}})")
    cut = lambda v: re.sub("[^A-Za-z0-9]+$", "", v)
    named = lambda c: re.sub(r"\s+", " ", c).strip().lower()
    found, edges = [], {}
    for t in texts:
        base = [m for k, p in FIXED.items() for m in re.finditer(p, t) if valid(k, m.group())]
        own = [(named(m[1]), cut(m[2]), m.start(2), m.start(2) + len(cut(m[2]))) for m in candidate.finditer(t)]
        own = [c for c in own if len(c[1]) >= 5 and not any(b.start() < c[3] and c[2] < b.end() for b in base)]
        found.append(own)
        for k, p in FIXED.items():
            end = 0
            for m in re.finditer(p, t):
                if valid(k, m.group()) and (c := re.search(rf"(?:[\W\d_])({context})$", " " + t[end : m.start()][-80:])):
                    edges[named(c[1]), m.group()] = True
                end = m.end()
        for c, v, _, _ in own:
            edges.setdefault((c, v), False)
    trust = defaultdict(float)
    for (_, v), seed in edges.items():
        trust[v] = max(trust[v], float(seed))
    for _ in range(pii.ROUNDS):
        score = {}
        for c in {c for c, _ in edges}:
            own = [trust[v] for x, v in edges if x == c]
            score[c] = sum(own) / (len(own) + 1) if sum(t >= pii.THRESHOLD for t in own) >= pii.SUPPORT else 0.0
        trust = defaultdict(float)
        for (c, v), seed in edges.items():
            trust[v] = max(trust[v], float(seed), score[c])
    return [sorted((a, b) for c, _, a, b in own if score[c] >= pii.THRESHOLD) for own in found]


def test_bootstrapped_spans_against_plain_loops(spark):
    random = np.random.default_rng(8)
    words = ["mail", "call", "ip", "card no", "room", "the", "host |", "id:", "und", "x,", "ref #"]
    values = ["a{0}@b.co", "+1 (555) 123-{0}", "10.0.{1}.7", "4111 1111 1111 1111", "4111111111111111", "AB-{0}", "{0} {0}", "v{1}.{0}", "12", "+{0}", "10.0.999.{1}"]
    texts = []
    for _ in range(150):
        value = lambda: str(random.choice(values)).format(random.integers(1000, 1200), random.integers(1, 9))
        texts.append(" ".join(f"{random.choice(words)} {value()}{random.choice(['', ',', '.', chr(10)])}" for _ in range(random.integers(1, 9))))
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    want = brute_contexts(texts)
    assert sum(map(len, want)) > 20
    for i, spans in enumerate(want):
        mine = [tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s.startswith("id:")]
        assert mine == spans, texts[i]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"u{i}@x.org" for i in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = pii.report(df).first()
    want = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", text))
    assert got.n_email == 3000 and got.spans == want
    assert pii.redact(df).first().text == " ".join(["[email]"] * 3000)


def test_redaction_keeps_columns(odd):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    row = out.filter("doc_id = 9").first()
    assert "[email]" in row.text and "[phone]" in row.text and "[ip]" in row.text and row.n_chars == len(row.text) and row.key == "clash"


@pytest.mark.parametrize("sign", ["7", "a", "%", "+", "é", "a.", "1.", "a@"])
def test_personal_data_in_long_runs_of_equal_signs(spark, sign):
    """A document of a million equal signs takes seconds, one of pairs of signs (up to 12,500 matches) as well."""
    import time

    df = spark.createDataFrame([(1, sign * (1_000_000 if len(sign) == 1 else 50_000))], "doc_id bigint, text string")
    began = time.time()
    assert pii.report(df).count() == 1
    assert time.time() - began < 60


def test_patterns_tried_once_a_run_match_the_same(spark):
    """Against the plain patterns of the contract, in Python, over texts of the signs that matter."""
    import random

    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b1", "@", "@", ".", "_", "%", "+", "-", " ", "1", "22", "é", "a@b.c"]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["a@b.c_d@e.f", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "1.2.3.4@5.6", "a@b..c@d.e", "x@y.z%x@y.z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    for kind, pattern in plain.items():
        got = df.select("doc_id", pii.matches(F.col("text"), pii.PATTERNS[kind]).alias("m")).collect()
        for r in got:
            assert [(m.start, m.end) for m in r.m] == [m.span() for m in re.finditer(pattern, texts[r.doc_id])], texts[r.doc_id]
