"""Removal of repeated byte strings, by bucket-pointer refinement.

A window is LENGTH bytes within a document. All windows whose least Q-gram (by hash) is the same
one, at the same place, form a run; windows with equal bytes have equal least Q-grams at equal
offsets, so they meet in the bucket of that Q-gram.

1. Runs are written as one row each: the Q-gram's hash, the hash of the run's bytes, where it is.
   Hot Q-grams are counted first; each window of theirs becomes a run of its own in the bucket of its
   own hash. Of equal runs a batch of rows sends only the first, and a task remembers those that
   repeat, so a bucket grows with the tasks at most and not with the number of copies.
2. In the bucket of a Q-gram, a run equal to an earlier one is wholly repeated, and a run that shares
   its bucket with none has no repeated window. Runs count as equal by the two 64-bit hashes of
   Q-gram and run, 128 bits, and the bytes of equal ones are not compared. First runs that share a
   bucket with other bytes go on, as their bytes.
3. There, positions begin in buckets of 8 bytes. Buckets are refined by sorting on the buckets of
   later offsets: 8 and 8 give 16 bytes, then 32, 64 and LENGTH. Each round uses the buckets of the
   round before, and positions alone in theirs are left out. Of the windows that share a bucket in
   the end, the one that starts first stays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchspark.llm.hashing import STRETCH, mix, prefix_sums, substring_hashes
from searchspark.llm.keys import keyed
from searchspark.llm.sketch import found_at, frequent
from searchspark.plans.staging import stage

LENGTH, Q = 100, 24
#: A run is at most LENGTH - Q windows longer than the first; start and extra length in one number.
EXTRA_BITS = 10
#: A Q-gram counts as hot when it has more runs than this. The runs of a hot Q-gram are dealt out
#: window by window, by the windows' own hashes.
HOT = 20_000
#: Repeated runs that a task remembers, 40 bytes each; of others each batch sends its first.
REMEMBERED = 1_000_000
#: Bytes of runs refined together, and rows handled together when they are written.
BUCKET_BYTES = 1_500_000
_PLACE = np.uint64((1 << 24) - 1)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each width keys in a row."""
    out, size, n = keys, 1, len(keys) - width + 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:n], out[width - size : width - size + n])


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(Q-gram hash, bytes hash, start, length) of all runs in texts laid end to end; ends are the
    texts' ends in data, of at most 2**24 bytes."""
    none = np.empty(0, np.uint64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    sums = prefix_sums(data)
    at = np.arange(len(data) - Q + 1)
    grams = substring_hashes(sums, at, at + Q)
    place = _least((grams & ~_PLACE) | at.astype(np.uint64), LENGTH - Q + 1) & _PLACE
    first = np.concatenate([[0], ends[:-1]])
    owner = np.searchsorted(ends, np.arange(len(place)), side="right")
    valid = np.flatnonzero((np.arange(len(place)) + LENGTH <= ends[owner]) & (np.arange(len(place)) >= first[owner]))
    if not len(valid):
        return none, none, none.astype(np.int64), none.astype(np.int64)
    p = place[valid].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 0) | (np.diff(valid) != 1)]))
    last = np.concatenate([new[1:], [len(valid)]]) - 1
    start, end = valid[new], valid[last] + LENGTH
    return grams[p[new]], substring_hashes(sums, start, end), start, end - start


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end in stretches: (data, ends, number of the text, offset in it). Long
    texts are cut into pieces that overlap by a window less one byte."""
    parts: list[bytes] = []
    owner: list[int] = []
    offset: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts]), np.array(owner), np.array(offset)

    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), STRETCH):
            piece = t[a : a + STRETCH + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            if size + len(piece) > STRETCH and parts:
                yield flush()
                parts, owner, offset, size = [], [], [], 0
            parts.append(piece), owner.append(i), offset.append(a)
            size += len(piece)
    if parts:
        yield flush()


RUN = "h long, s long, k long, at long, gone boolean"


def _runs_of(batch: pd.DataFrame, hot: np.ndarray | None) -> tuple[np.ndarray, ...] | None:
    """(h, s, k, at) of all runs of a batch of (_k, text); those of hot slots window by window."""
    keys, parts = batch["_k"].to_numpy(dtype=np.int64), []
    for data, ends, owner, offset in _pieces([t.encode() for t in batch["text"]]):
        h, s, start, length = runs(data, ends)
        if hot is not None and len(h) and (split := found_at(hot, h)[0]).any():
            extra = (length - LENGTH + 1)[split]
            first = np.repeat(start[split] - np.concatenate([[0], np.cumsum(extra)[:-1]]), extra) + np.arange(extra.sum())
            sums, half = prefix_sums(data), first + LENGTH // 2
            single = substring_hashes(sums, first, first + LENGTH)
            other = mix(substring_hashes(sums, first, half) * np.uint64(3) + substring_hashes(sums, half, first + LENGTH))
            h, s = np.concatenate([h[~split], single]), np.concatenate([s[~split], other])
            start, length = np.concatenate([start[~split], first]), np.concatenate([length[~split], np.full(len(first), LENGTH)])
        piece = np.searchsorted(ends, start, side="right")
        where = start - np.concatenate([[0], ends[:-1]])[piece] + offset[piece]
        parts.append((h, s, keys[owner[piece]], (where << EXTRA_BITS) | (length - LENGTH)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else None


def hot_grams(rows: DataFrame) -> np.ndarray:
    """Hashes of hot Q-grams, ascending."""
    return frequent(rows.select("_k", "text"), lambda b: [r[0] for r in [_runs_of(b, None)] if r is not None], HOT)[0]


class Repeated:
    """Runs that a task has seen repeated, with the first place of each."""

    def __init__(self) -> None:
        self.key = np.empty(0, np.uint64)
        self.rows = [np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]

    def later(self, h: np.ndarray, s: np.ndarray, k: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of these runs (no two equal) are known from an earlier place; the first place of
        the others that are known becomes theirs."""
        there, i = found_at(self.key, mix(h) ^ s)
        mh, ms, mk, mat = self.rows
        if not len(mh):
            return there
        there &= (mh[i] == h) & (ms[i] == s)
        after = there & ((mk[i] < k) | ((mk[i] == k) & (mat[i] < at)))
        new = there & ~after
        mk[i[new]], mat[i[new]] = k[new], at[new]
        return after

    def add(self, h: np.ndarray, s: np.ndarray, k: np.ndarray, at: np.ndarray) -> None:
        """Remember these runs, as far as there is room."""
        key = mix(h) ^ s
        fresh = np.flatnonzero(~found_at(self.key, key)[0])[: max(0, REMEMBERED - len(self.key))]
        key, place = np.unique(np.concatenate([self.key, key[fresh]]), return_index=True)
        self.key = key
        self.rows = [np.concatenate([old, x[fresh]])[place] for old, x in zip(self.rows, (h, s, k, at), strict=True)]


def run_rows(hot: Broadcast):  # noqa: ANN201
    """Makes rows of RUN from batches of (_k, text). Of equal runs within a batch only the first
    stays in its bucket, and only if the task has not met it before; the others are known to be gone
    and take a bucket of their own."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = Repeated()
        for batch in batches:
            found = _runs_of(batch, hot.value)
            if found is None:
                continue
            h, s, k, at = found
            order = np.lexsort((at, k, s, h))
            h, s, k, at = h[order], s[order], k[order], at[order]
            gone = np.concatenate([[False], (h[1:] == h[:-1]) & (s[1:] == s[:-1])])
            first = np.flatnonzero(~gone)
            many = np.diff(np.append(first, len(h))) > 1
            gone[first] = met.later(h[first], s[first], k[first], at[first])
            own = first[many]
            met.add(h[own], s[own], k[own], at[own])
            h = np.where(gone, mix(k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)), h)
            yield pd.DataFrame({"h": h.view(np.int64), "s": s.view(np.int64), "k": k, "at": at, "gone": gone})

    return rows


def repeated_windows(data: np.ndarray, ends: np.ndarray, k: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Positions in data of windows that occur earlier. data holds strings end to end, each at
    start in document k; earlier means smaller (k, start)."""
    size = len(data)
    first = np.concatenate([[0], ends[:-1]])
    owner = np.searchsorted(ends, np.arange(size), side="right")
    left = ends[owner] - np.arange(size)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    gram = np.zeros(size, np.uint64)
    for j in range(8):
        gram = (gram << np.uint64(8)) | wide[j : j + size]
    active = np.flatnonzero(left >= 8)
    bucket = np.full(size, -1, np.int64)
    order = active[np.argsort(gram[active], kind="stable")]
    g = gram[order]
    depth, step = 8, 8
    heads = np.concatenate([[True], g[1:] != g[:-1]]) if len(order) else np.empty(0, bool)
    while True:
        ids = np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))
        refined = np.full(size, -1, np.int64) if depth == 8 else bucket.copy()
        refined[order] = ids + (0 if depth == 8 else size * depth)
        alone = heads & np.concatenate([heads[1:], [True]]) if len(order) else heads
        bucket = refined
        if depth == LENGTH:
            break
        step = min(depth, LENGTH - depth)
        depth += step
        many = order[~alone]
        many = many[left[many] >= depth]
        a, b = bucket[many], bucket[many + step]
        by = np.lexsort((b, a))
        order, a, b = many[by], a[by], b[by]
        heads = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.empty(0, bool)
    many = order[~alone]
    if not len(many):
        return many
    where = start[owner[many]] + many - first[owner[many]]
    by = np.lexsort((where, k[owner[many]], bucket[many]))
    group = bucket[many][by]
    return many[by][np.concatenate([[False], group[1:] == group[:-1]])]


def _spans(k: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Windows (k, start) joined into spans k, start, length."""
    order = np.lexsort((start, k))
    k, start = k[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(k) != 0) | (np.diff(start) > LENGTH)])) if len(k) else np.empty(0, np.int64)
    last = np.concatenate([new[1:], [len(k)]]).astype(np.int64) - 1
    return pd.DataFrame({"k": k[new], "start": start[new], "length": start[last] - start[new] + LENGTH}) if len(k) else pd.DataFrame({"k": k, "start": k, "length": k})


def refine(group: pd.DataFrame) -> pd.DataFrame:
    """Spans of repeated windows among the runs of one group of buckets."""
    ends = np.cumsum([len(b) for b in group["bytes"]])
    data = np.frombuffer(b"".join(group["bytes"]), np.uint8)
    k, start = group["k"].to_numpy(), group["start"].to_numpy()
    found = repeated_windows(data, ends, k, start)
    owner = np.searchsorted(ends, found, side="right")
    return _spans(k[owner], start[owner] + found - np.concatenate([[0], ends[:-1]])[owner]).astype("int64")


def judged(rows: DataFrame) -> DataFrame:
    """Staged: runs that are gone, and first runs to be refined: h, k, at, gone."""
    hot = rows.sparkSession.sparkContext.broadcast(hot_grams(rows))
    bucket, equal = Window.partitionBy("h"), Window.partitionBy("h", "s").orderBy("k", "at")
    numbered = (
        rows.select("_k", "text").mapInPandas(run_rows(hot), RUN)
        .withColumn("rn", F.row_number().over(equal))
        .withColumn("n", F.count(F.lit(1)).over(bucket))
        .withColumn("kinds", F.sum((F.col("rn") == 1).cast("int")).over(bucket))
        .filter("gone or (n > 1 and (rn > 1 or kinds > 1))")
    )
    return stage(numbered.select("h", "k", "at", (F.col("gone") | (F.col("rn") > 1)).alias("gone")), "substrings-runs")


def _bytes_of_runs(buckets: int):  # noqa: ANN202
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text, own in zip(batch["_k"], batch["text"], batch["own"], strict=True):
                data = text.encode()
                for r in own:
                    start = r["at"] >> EXTRA_BITS
                    end = start + LENGTH + (r["at"] & ((1 << EXTRA_BITS) - 1))
                    out.append((r["h"] % buckets, k, start, data[start:end]))
            yield pd.DataFrame(out, columns=["bucket", "k", "start", "bytes"]).astype({"bucket": "int64", "k": "int64", "start": "int64"})

    return cut


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            data, removed, count, digest, at = text.encode(), 0, 0, hashlib.sha256(), 0
            end = -1
            for s in sorted((r["start"], r["length"]) for r in (spans if spans is not None else [])):
                if s[0] > end:
                    count += 1
                    digest.update(data[at : s[0]])
                    at, removed = s[0] + s[1], removed + s[1]
                elif s[0] + s[1] > end:
                    removed += s[0] + s[1] - end
                    at = s[0] + s[1]
                end = at
            digest.update(data[at:])
            out.append((len(data), removed, count, digest.hexdigest()))
        frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield frame


def removed_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """k, start, length of all removed spans; they may overlap or touch."""
    start = F.shiftright("at", EXTRA_BITS)
    length = F.col("at").bitwiseAND((1 << EXTRA_BITS) - 1) + LENGTH
    whole = found.filter("gone").select("k", start.alias("start"), length.alias("length"))
    open_ = found.filter("not gone")
    size = open_.agg(F.sum(length)).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    own = open_.groupBy("k").agg(F.collect_list(F.struct("h", "at")).alias("own"))
    strings = rows.join(own, F.col("_k") == F.col("k")).select("_k", "doc_id", "text", "own").mapInPandas(
        _bytes_of_runs(buckets), "bucket long, k long, start long, bytes binary"
    )
    return whole.unionByName(strings.groupBy("bucket").applyInPandas(refine, "k long, start long, length long"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document.

    A byte goes where a window over it also starts earlier, in a smaller id or before in the same
    text. Null texts are empty; texts shorter than a window lose nothing; a null id comes last; rows
    with equal ids count as documents in the order of their texts, so of repeated rows the first
    keeps its bytes. An empty table gives no rows; other columns are ignored.
    """
    rows = keyed(docs.select("doc_id", "text")).drop("_all")
    spans = removed_spans(rows, judged(rows)).groupBy("k").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    joined = rows.join(spans, F.col("_k") == F.col("k"), "left").select("_k", "doc_id", "text", "spans")
    return joined.mapInPandas(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
