"""Periodic runs of words, by branching squares in an enhanced suffix array.

A stretch of words with period q that cannot be extended ends in exactly one square of period q
whose two suffixes share q words and no more: its branching square. In the suffix array both
suffixes lie below one LCP interval of depth q, in different children. So for each interval the
suffixes of all children but the largest look up, in the inverse array, whether the suffix one
depth on, or one depth back, lies in the interval outside their own child. Squares found this way
are rotated to the left as far as the period holds, which gives the run; squares whose root is
itself a power of a run found before are dropped. Intervals are pairs of borders of the LCP array;
no tree is built.

Documents are handled many at a time, in blocks: the document is the first part of every suffix's
key, so no match crosses documents, and the sorts, the LCP values and the look-ups are numpy calls
over the whole block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of one block, unless a single document has more.
BLOCK = 1 << 18
#: A run has at least so many words, and so many times its period.
LEAST, POWER = 6, 4
#: Words compared for all pairs at once, before the pairs that are still equal go one by one.
TOGETHER = 8


class Run(NamedTuple):
    """Words start to start + length (exclusive) of a document repeat after period words."""

    start: int
    length: int
    period: int


def suffix_order(first: np.ndarray, end: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the place of each: first orders them by document and h words, then
    groups that are still equal are sorted by the groups of the suffixes h words on, h doubling."""
    n = len(first)
    places = np.arange(n)
    sa = np.argsort(first, kind="stable")
    key = first[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, places, 0))
    unsettled = places[~(new & np.append(new[1:], True))]
    while unsettled.size:
        at = sa[unsettled]
        later = at + h
        key = rank[at] * (n + 1) + np.where(later < end[at], rank[np.minimum(later, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[unsettled] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, unsettled, 0))
        unsettled = unsettled[~(new & np.append(new[1:], True))]
        h *= 2
    return sa, rank


def _ahead(words: np.ndarray, a: int, b: int, most: int) -> int:
    """How many of the next words, at most, from a and from b on are equal."""
    done, size = 0, 32
    while done < most:
        size = min(size, most - done)
        differ = words[a + done : a + done + size] != words[b + done : b + done + size]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + size, size * 2
    return done


def _back(words: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words, at most, right before a and before b are equal."""
    done, size = 0, 32
    while done < most:
        size = min(size, most - done)
        differ = words[a - done - size : a - done] != words[b - done - size : b - done]
        if differ.any():
            return done + int(differ[::-1].argmax())
        done, size = done + size, size * 2
    return done


def common_prefixes(words: np.ndarray, sa: np.ndarray, isa: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that each suffix in sa shares with the one before it of the same document.

    Where the words before both are equal the value is that of the suffix one earlier, less one;
    the others are compared, and their sum is at most 2 n log n.
    """
    n = len(words)
    places = np.arange(n)
    before = np.where(isa > begin, sa[np.maximum(isa - 1, 0)], -1)
    inner = (before > begin) & (places > begin)
    same = inner & (words[np.maximum(places - 1, 0)] == words[np.maximum(before - 1, 0)])
    a = places[~same & (before >= 0)]
    b = before[a]
    most = end[a] - np.maximum(a, b)
    value = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    for step in range(TOGETHER):
        active = active[most[active] > step]
        active = active[words[a[active] + step] == words[b[active] + step]]
        value[active] = step + 1
    for i in active[most[active] > TOGETHER].tolist():
        value[i] = TOGETHER + _ahead(words, int(a[i]) + TOGETHER, int(b[i]) + TOGETHER, int(most[i]) - TOGETHER)
    known = np.zeros(n, np.int64)
    known[a] = value
    last = np.maximum.accumulate(np.where(same, 0, places))
    return (known[last] - (places - last))[sa]


def _borders(lcp: list[int]) -> tuple[list[int], list[int], list[int]]:
    """For each place of the LCP array: the nearest smaller value before, after, and the largest
    value between."""
    left, right, most = [0] * len(lcp), [0] * len(lcp), lcp[:]
    stack: list[int] = []
    for p, v in enumerate(lcp):
        top = 0
        while stack and lcp[stack[-1]] > v:
            q = stack.pop()
            right[q] = p
            top = most[q] = max(top, most[q])
        if top > v:
            most[p] = top
        if stack:
            q = stack[-1]
            left[p] = left[q] if lcp[q] == v else q
        stack.append(p)
    top = 0
    for q in reversed(stack):
        right[q] = len(lcp)
        top = most[q] = max(top, most[q])
    return left, right, most


def branching_squares(lcp: np.ndarray, sa: np.ndarray, isa: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares whose two suffixes share just one period, of those that
    can end a run of POWER periods.

    lcp is zero at the first suffix of each document; isa holds places in sa by word number.
    """
    left, right, most = map(np.asarray, _borders(lcp.tolist()))
    # An interval that a run of POWER periods passes through holds POWER suffixes, and two of them
    # share all of the run but one period.
    cuts = np.flatnonzero((lcp > 0) & (right - left >= POWER) & (most >= np.maximum((POWER - 1) * lcp, LEAST - lcp)))
    cuts = cuts[np.lexsort((cuts, right[cuts], left[cuts]))]
    if not cuts.size:
        return cuts, cuts
    lo, hi = left[cuts], right[cuts]
    opens = np.ones(len(cuts), bool)
    # The largest value lies among the cuts of one level only, so the levels of an interval are
    # told apart by their borders, and cuts that pass the test above may lack some of their level.
    opens[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    node = np.cumsum(opens) - 1
    lo, hi, depth = lo[opens], hi[opens], lcp[cuts[opens]]
    every = np.flatnonzero(lcp > 0)
    key = left[every] * (len(lcp) + 1) + right[every]
    wanted = lo * (len(lcp) + 1) + hi
    at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
    every, node = every[wanted[at] == key], at[wanted[at] == key]
    # Children: from each cut to the next, the first from the left border, the last to the right.
    head = np.concatenate([lo, every])
    owner = np.concatenate([np.arange(len(lo)), node])
    order = np.lexsort((head, owner))
    head, owner = head[order], owner[order]
    final = np.append(owner[1:] != owner[:-1], True)
    tail = np.where(final, hi[owner], np.append(head[1:], 0))
    size = tail - head
    order = np.lexsort((-size, owner))
    largest = np.append(True, owner[order][1:] != owner[order][:-1])
    small = order[~largest]
    total = int(size[small].sum())
    child = np.repeat(small, size[small])
    place = np.arange(total) - np.repeat(np.cumsum(size[small]) - size[small], size[small]) + head[child]
    i, d = sa[place], depth[owner[child]]
    found = []
    for sign in (1, -1):
        j = i + sign * d
        inside = (j >= begin[i]) & (j < end[i])
        other = isa[np.where(inside, j, i)]
        hit = inside & (other >= lo[owner[child]]) & (other < hi[owner[child]]) & ((other < head[child]) | (other >= tail[child]))
        found.append(np.stack([np.minimum(i, j)[hit], d[hit]]))
    start, period = np.unique(np.concatenate(found, axis=1), axis=1)
    return start, period


def _merged(words: np.ndarray, start: np.ndarray, period: np.ndarray, begin: np.ndarray) -> dict[int, list[Run]]:
    """Runs by the first word of their document, from branching squares."""
    room = np.minimum(start - begin[start], 2 * period)
    good = room == 2 * period
    for step in range(1, TOGETHER + 1):
        tested = good & (step <= room)
        at = np.where(tested, start - step, 0)
        good &= ~tested | (words[at] == words[at + np.where(tested, period, 0)])
    start, period = start[good], period[good]
    order = np.lexsort((period, start + 2 * period))
    out: dict[int, list[Run]] = {}
    ended, here = -1, []
    for s, q in zip(start[order].tolist(), period[order].tolist(), strict=True):
        if s + 2 * q != ended:
            ended, here = s + 2 * q, []
        if any(q % r.period == 0 and r.start <= s for r in here):
            continue
        low = int(begin[s])
        more = _back(words, s, s + q, s - low)
        if more >= (POWER - 2) * q:
            here.append(Run(s - more, ended - s + more, q))
            if ended - s + more >= LEAST:
                out.setdefault(low, []).append(Run(s - more - low, ended - s + more, q))
    return out


def find_runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """Of each text, given as word numbers from 0 on, all runs by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    out: list[list[Run]] = [[] for _ in texts]
    if n < LEAST:
        return out
    words = np.concatenate(texts).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    begin, end = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)
    width = int(words.max() + 1).bit_length()
    h = max(1, (62 - len(texts).bit_length()) // width)
    first = np.repeat(np.arange(len(texts)), sizes)
    for k in range(h):
        later = np.arange(k, n + k)
        first = (first << width) | np.where(later < end, words[np.minimum(later, n - 1)] + 1, 0)
    sa, isa = suffix_order(first, end, h)
    lcp = common_prefixes(words, sa, isa, begin, end)
    # Two suffixes one period apart in a run share LEAST - 1 words or more.
    deepest = np.zeros(len(texts), np.int64)
    deepest[sizes > 0] = np.maximum.reduceat(lcp, begins[sizes > 0])
    kept = np.repeat(deepest >= LEAST - 1, sizes)
    if not kept.any():
        return out
    place = np.cumsum(kept) - 1
    start, period = branching_squares(lcp[kept], sa[kept], place[isa], begin, end)
    own = {int(b): i for i, b in enumerate(begins) if sizes[i]}
    for low, runs in _merged(words, start, period, begin).items():
        out[own[low]] = sorted(runs, key=lambda r: (r.start, r.period))
    return out


def _kept(words: list[bytes], runs: list[Run]) -> bytes:
    """Words outside of runs or in the first period of each they lie in, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for r in runs:
        keep[r.start + r.period : r.start + r.length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep))


def _described(words: list[bytes], runs: list[Run]) -> tuple:
    """Columns of one document."""
    listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
    shas = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(_kept(words, runs)).hexdigest()
    if not runs:
        return 0, None, None, None, None, *shas
    best = max(runs, key=lambda r: (Fraction(r.length, r.period), -r.start, -r.period))
    return len(runs), *best, 1000 * best.length // best.period, *shas


_KIND = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long,"
    " runs_sha256 string, collapsed_sha256 string"
)


def _periodic(words: list[bytes], h: int) -> list[bytes]:
    """words with the part from one word on made periodic, where h, a hash of the id, asks for it."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _blocks(rows: Iterator[tuple[int | None, str, int | None]]) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    block: list[tuple[int | None, list[bytes]]] = []
    n = 0
    for doc_id, text, h in rows:
        words = text.encode().split()
        if h is not None:
            words = _periodic(words, h)
        block.append((doc_id, words))
        n += len(words)
        if n >= BLOCK or len(block) >= BLOCK // 16:
            yield block
            block, n = [], 0
    yield block


def _numbers(docs: list[list[bytes]]) -> list[np.ndarray]:
    known = {x: i for i, x in enumerate(dict.fromkeys(chain.from_iterable(docs)))}
    return [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in docs]


def run_table(docs: DataFrame, edited: Column | None = None) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of docs (doc_id, text).

    Words stand between the white space of ASCII. start to exponent_milli are of the run with the
    greatest length by period (ties: smallest start, then period), null without a run. Texts that
    are null, empty or short have no run. Rows with equal ids, or without one, each have a row; no
    rows, none. Other columns are ignored. A task holds BLOCK words or one document; nothing is
    shuffled. edited: hash by which a text is first made periodic (see report()).
    """
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        (F.lit(None) if edited is None else edited).cast("string").alias("h"),
    )

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def listed() -> Iterator[tuple[int | None, str, int | None]]:
            for batch in batches:
                for d, t, h in zip(batch["doc_id"].tolist(), batch["text"].tolist(), batch["h"].tolist(), strict=True):
                    yield (None if d is None else int(d)), t, (None if h is None else int(h))

        for block in _blocks(listed()):
            words = [w for _, w in block]
            out = [(d, *_described(w, r)) for (d, w), r in zip(block, find_runs(_numbers(words)), strict=True)]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _KIND.split(", ")], dtype=object)
            yield frame.astype(dict.fromkeys(frame.columns[:6], "Int64"))

    return rows.mapInPandas(find, _KIND)


def report(docs: DataFrame) -> DataFrame:
    """run_table() of documents of which those whose crc32(id as text) divides by ten are made
    periodic first; a document without an id stays as it is."""
    return run_table(docs, F.crc32(F.col("doc_id").cast("string")))


def collapsed(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with each run cut to its first period, for use before training: column holds the kept
    words joined by single spaces where a run was found, and is untouched elsewhere (null: null)."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[str | None] = texts.tolist()
            for block in _blocks((i, t or "", None) for i, t in enumerate(texts.tolist())):
                found = find_runs(_numbers([w for _, w in block]))
                for (i, w), runs in zip(block, found, strict=True):
                    if runs:
                        out[i] = _kept(w, runs).decode()
            yield pd.Series(out, dtype=object)

    return docs.withColumn(column, cut(column))
