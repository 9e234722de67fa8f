"""Token counts by byte-pair merging, without ids.

A text is cut as the tokenizer file's own pre-tokenizer cuts it. Each pre-token begins as a linked
list of bytes; a heap holds its adjacent pairs that have a merge, lowest rank and leftmost first.
The first of them is merged, its neighbours' new pairs go onto the heap, and pairs that are no
longer there are passed over. Its count is its bytes less its merges. Special strings inside a
text are one token each, as is the library's default. Only ranks are read from the file; no
identifier is looked up or put out.

A text is first cut at spaces and line feeds, across which this pre-tokenizer never goes, so that
each different piece is merged once in a worker; texts with other white space are cut by the
pre-tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchspark.llm.tokens import CACHE_ENTRIES, CACHE_PIECE, ODD_SPACE, PIECES, RUNS

#: Above so many tokens a document is over the limit.
LIMIT = 512
#: Byte-level symbols of ASCII (visible characters stand for themselves), and what the
#: pre-tokenizer does with symbols of a piece that has white space, if any, at its beginning.
_SYMBOLS = {**{i: chr(256 + i) for i in range(33)}, 127: chr(289)}
_INNER_SPACE = re.compile(r".\s|^[^\S \n]", re.DOTALL)
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)|\u0120?[A-Za-z]+|\u0120?[0-9]+|\u0120?[^\u0120\u010aA-Za-z0-9]+|[\u0120\u010a]")

_counters: dict[str, Counter] = {}


class Merges:
    """Ranks of adjacent pairs of symbols, and what each pair becomes."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        known: dict[str, str] = {}
        listed = [(known.setdefault(a, a), known.setdefault(b, b)) for a, b in pairs]
        self.rank = {pair: r for r, pair in enumerate(listed)}
        self.merged = [known.setdefault(a + b, a + b) for a, b in listed]

    def length(self, word: str) -> int:
        """How many symbols are left when adjacent pairs are merged, lowest rank and leftmost
        first, until no pair has a rank."""
        n = left = len(word)
        rank, merged = self.rank.get, self.merged
        # The rank of the pair that begins at each symbol; entries of the heap are rank and place.
        here = [*map(rank, zip(word, word[1:], strict=False)), None]
        bits = n.bit_length()
        heap = [r << bits | i for i, r in enumerate(here) if r is not None]
        if not heap:
            return n
        heapify(heap)
        held, after, before, mask = list(word), list(range(1, n + 1)), list(range(-1, n - 1)), (1 << bits) - 1
        while heap:
            top = heappop(heap)
            i, r = top & mask, top >> bits
            if here[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            both = held[i] = merged[r]
            here[i] = here[j] = None
            left -= 1
            if k < n:
                before[k] = i
                r = rank((both, held[k]))
                if r is not None:
                    here[i] = r
                    heappush(heap, r << bits | i)
            h = before[i]
            if h >= 0:
                r = here[h] = rank((held[h], both))
                if r is not None:
                    heappush(heap, r << bits | h)
        return left


class _Known(dict):
    """Token counts of pieces, worked out when first asked for."""

    def __init__(self, count: Counter, before: str):
        self.count, self.before = count, before

    def __missing__(self, piece: str) -> int:
        n = self.count.piece(piece if piece[:1] == "\n" else self.before + piece)
        if len(piece) <= CACHE_PIECE and len(self) < CACHE_ENTRIES:
            self[piece] = n
        return n


class Counter:
    """Counts tokens of texts by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        kind, model = known["pre_tokenizer"] or {}, known["model"]
        plain = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and model["type"] == "BPE"
        marks = known["added_tokens"]
        if not plain or known["normalizer"] or model.get("dropout") or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in marks):
            raise ValueError(f"{path} is no plain byte-level BPE")
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.merges = Merges(pairs)
        # Longest first: of several that begin at one place the library takes the longest.
        names = sorted((t["content"] for t in marks), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.whole: dict[str, int] = {}
        self.first, self.spaced = _Known(self, ""), _Known(self, " ")

    def _words(self, piece: str) -> list[str]:
        """Byte-level symbols of each pre-token."""
        if piece.isascii() and not _INNER_SPACE.search(piece):
            return _ASCII.findall(piece.translate(_SYMBOLS))
        return [w for w, _ in self.cut(piece)]

    def piece(self, text: str) -> int:
        """Tokens of a text without special strings, cut by the pre-tokenizer."""
        total = 0
        for word in self._words(text):
            n = self.whole.get(word)
            if n is None:
                n = self.merges.length(word)
                if len(word) <= CACHE_PIECE and len(self.whole) < CACHE_ENTRIES:
                    self.whole[word] = n
            total += n
        return total

    def _part(self, text: str) -> int:
        if not text:
            return 0
        if ODD_SPACE.search(text):
            return self.piece(text)
        if text[0] in " \n" or text[-1] in " \n" or any(r in text for r in RUNS):
            return sum(map(self.first.__getitem__, PIECES.findall(text)))
        pieces = text.replace("\n", " \n").split(" ")
        return self.first[pieces[0]] + sum(map(self.spaced.__getitem__, pieces[1:]))

    def count(self, text: str) -> int:
        """Tokens of a text, each special string in it one."""
        parts: Iterable[str] = self.special.split(text) if self.special else (text,)
        counts = [self._part(p) for p in parts]
        return sum(counts) + len(counts) - 1


def counter(path: str) -> Counter:
    """The counter of this worker process, loaded once."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of a text (null: 0) by a byte-level BPE file."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(tokenizer).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    return counted(F.coalesce(text, F.lit("")))


def report(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of docs (doc_id, text).

    Texts that are null or empty have no bytes and no tokens. Each row is counted for itself, so
    rows with equal ids, equal rows and rows without an id each have a row; no rows, none. Other
    columns are ignored. Nothing is shuffled; a worker remembers at most CACHE_ENTRIES short pieces
    of each kind, and longer ones, up to a whole text, are merged anew in memory of their length.
    """
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, tokenizer).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
