"""Token ids by a public tokenizer file, piece by piece.

Both tokenizers used here split a text into pre-tokens before any merge, and none of those spans
the border between a visible character and a following space or line feed. So a text is cut at
such borders, each distinct piece is encoded once by the tokenizers library, and the ids are put
together again. Texts with any other white space are given to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Entries kept for reuse in one worker, and the longest piece worth keeping.
CACHE_ENTRIES = 1_000_000
CACHE_PIECE = 48
#: Texts with white space other than space and line feed, or with separators that the libraries
#: class differently.
ODD_SPACE = re.compile(r"[^\S \n]")
#: Runs of white space, for which the simple cut at each space would not do.
RUNS = ("  ", "\n\n", " \n", "\n ")
PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: After an ASCII letter these always begin a new pre-token, whatever the normaliser does: such a
#: letter stays one letter, and none of the marks combines with it.
_MARKS = ".,;:!?"
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

_encoders: dict[tuple[str, bool], PieceEncoder] = {}


class PieceEncoder:
    """Encodes texts to arrays of little-endian unsigned 32-bit ids (add_special_tokens=False).

    drops_space: the tokenizer ignores white space, so pieces need not carry it.
    """

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in encoded]

    def encode(self, text: str) -> bytes:
        """Ids of one text as bytes, four per id."""
        if not text:
            return b""
        if ODD_SPACE.search(text):
            return self._library([text])[0]
        if self.drops_space:
            return self._joined(text.replace("\n", " ").split(" "), self.known, "")
        if text[0] in " \n" or text[-1] in " \n" or any(r in text for r in RUNS):
            return self._joined(PIECES.findall(text), self.known, "")
        lines = text.replace("\n", " \n").split(" ")
        return self._joined(lines[:1], self.known, "") + self._joined(lines[1:], self.spaced, " ")

    def _joined(self, pieces: list[str], known: dict[str, bytes], before: str) -> bytes:
        """Ids of pieces that each follow a space (before), unless they begin with a line feed."""
        found = list(map(known.get, pieces))
        if None in found:
            extra = self._new({p for p, b in zip(pieces, found, strict=True) if b is None}, known, before)
            found = [extra[p] if b is None else b for p, b in zip(pieces, found, strict=True)]
        return b"".join(found)

    def _new(self, pieces: set[str], known: dict[str, bytes], before: str) -> dict[str, bytes]:
        """Ids of pieces not yet known. Of a word that ends in an ASCII letter before its closing
        marks, word and marks are encoded apart, so each word is encoded once for all its marks."""
        cut: dict[str, str] = {}
        whole: set[str] = set()
        for p in pieces:
            word = p.rstrip(_MARKS)
            if len(word) < len(p) and word[-1:] in _LETTERS:
                cut[p] = word
                if word not in known:
                    whole.add(word)
            else:
                whole.add(p)
        out: dict[str, bytes] = {}
        listed = list(whole)
        for i in range(0, len(listed), 1024):
            part = listed[i : i + 1024]
            texts = [p if p[:1] == "\n" else before + p for p in part] if before else part
            out.update(zip(part, self._library(texts), strict=True))
        for p, word in cut.items():
            ids = known[word] if word in known else out[word]
            out[p] = ids + self._joined([p[len(word) :]], self.known, "")
        if len(known) < CACHE_ENTRIES:
            known.update((p, b) for p, b in out.items() if len(p) <= CACHE_PIECE)
        return out


def encoder(path: str, drops_space: bool = False) -> PieceEncoder:
    """The encoder of this worker process, loaded once."""
    key = (path, drops_space)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, drops_space)
    return _encoders[key]
