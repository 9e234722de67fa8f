"""Cost-balanced packing of documents into sequences of bounded length."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchspark.llm.tokens import encoder

#: Documents packed together: enough that the one sequence left open per shard hardly counts.
SHARD_DOCS = 1024
#: Cost of a piece of n ids: LINEAR * n + SQUARE * n * n.
LINEAR, SQUARE = 1.0, 1.0 / 1024
#: The largest id that pieces can carry.
LARGEST = (1 << 16) - 1

PIECE = "shard long, doc_id long, no_id boolean, start long, length long, doc_tokens long, ids_crc32 long, ids binary"
PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def assign(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for lengths in descending order.

    The fewest sequences that can hold everything are open from the start. Each document goes
    to the sequence of least cost that has room for it; where none has, the roomiest sequence
    takes as much as fits and the rest goes on as a shorter document.
    """
    count = math.ceil(int(lengths.sum()) / capacity)
    cost, room = np.zeros(count), np.full(count, capacity, dtype=np.int64)
    out = []
    for doc, length in enumerate(lengths.tolist()):
        start, left = 0, length
        while left:
            k = int(np.where(room >= left, cost, np.inf).argmin())
            if room[k] < left:
                k = int(room.argmax())
            n = min(left, int(room[k]))
            out.append((doc, start, n, k, capacity - int(room[k])))
            room[k] -= n
            cost[k] += LINEAR * n + SQUARE * n * n
            start, left = start + n, left - n
    return out


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, drops_space: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document (null text: empty) is encoded and closed with end_id, so none is without ids.
    Whole stretches of capacity ids are sequences of their own; what is left of each document is
    packed within its shard, a hash of id and text. Nothing depends on the order of rows; rows
    that repeat are packed as often as they come; null ids stay null; further columns are ignored;
    an empty table gives no rows. Ids are carried as 16-bit numbers; a larger one is an error.
    """
    shards = max(1, math.ceil(docs.count() / SHARD_DOCS))
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"),
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer, drops_space).encode, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for shard, doc, no_id, text in zip(batch["shard"], batch["doc_id"], batch["no_id"], batch["text"], strict=True):
                raw = encode(text) + end
                total, step = len(raw) // 4, 4 * capacity
                whole = total // capacity
                rows += [
                    (shard, doc, no_id, k * capacity, capacity, total, zlib.crc32(raw[k * step : (k + 1) * step]), None)
                    for k in range(whole)
                ]
                if rest := raw[whole * step :]:
                    ids = np.frombuffer(rest, dtype="<u4")
                    if int(ids.max()) > LARGEST:
                        raise ValueError(f"id {int(ids.max())} does not fit 16 bits")
                    short = ids.astype("<u2").tobytes()
                    rows.append((shard, doc, no_id, whole * capacity, len(rest) // 4, total, None, short))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])
            yield frame.astype({"ids_crc32": "Int64"})

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0]) << 32
        full, part = group[group["ids"].isna()], group[group["ids"].notna()]
        full, part = full.sort_values(["no_id", "doc_id", "start"]), part.sort_values(
            ["length", "no_id", "doc_id", "ids"], ascending=[False, True, True, True]
        )
        ids = [np.frombuffer(b, dtype="<u2") for b in part["ids"]]
        named = lambda df: [None if no else d for d, no in zip(df["doc_id"], df["no_id"], strict=True)]
        docs_, starts, totals = named(part), part["start"].tolist(), part["doc_tokens"].tolist()
        placed = assign(part["length"].to_numpy(dtype=np.int64), capacity) if len(part) else []
        rows = [
            (docs_[d], starts[d] + s, n, zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()), totals[d], shard + k, at)
            for d, s, n, k, at in placed
        ]
        used = 1 + max((p[3] for p in placed), default=-1)
        rows += [
            (d, s, n, c, t, shard + used + i, 0)
            for i, (d, s, n, c, t) in enumerate(
                zip(named(full), *(full[c].tolist() for c in ("start", "length", "ids_crc32", "doc_tokens")), strict=True)
            )
        ]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])
        out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
        return out

    return keyed.mapInPandas(cut, PIECE).groupBy("shard").applyInPandas(fill, PACKED)
