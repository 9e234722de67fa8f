"""Frequent hashes among very many, by exact counts of those that repeat within a stretch.

What is frequent over all rows is frequent in stretches of them, too. Tasks count a stretch of hashes
at a time, send those seen SEEN times or more, and sums over the stretches tell the frequent ones. So
the table grows neither with the input nor with the number of different hashes: of hashes in a given
share of all rows there can only be so many. What is missed, or counted short, changes no result of
the operators here; they only choose an order or a way by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashes counted at once in a task, and how often one must come among them to be sent.
STRETCH, SEEN = 1 << 21, 3
#: Frequent hashes kept, the most frequent ones first: 16 bytes each in the driver and in a broadcast.
MOST = 1 << 20


def frequent(rows: DataFrame, hashes: Callable[[pd.DataFrame], Iterable[np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) that come at least so many times in all rows, and how often."""

    def often(parts: list[np.ndarray]) -> pd.DataFrame:
        found, times = np.unique(np.concatenate(parts), return_counts=True)
        kept = times >= SEEN
        return pd.DataFrame({"h": found[kept].view(np.int64), "n": times[kept].astype(np.int64)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts, size = [np.empty(0, np.uint64)], 0
            for h in hashes(b):
                parts.append(h)
                size += len(h)
                if size >= STRETCH:
                    yield often(parts)
                    parts, size = [np.empty(0, np.uint64)], 0
            yield often(parts)

    summed = rows.mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    got = summed.orderBy(F.col("n").desc(), "h").limit(MOST).toPandas()
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["n"].to_numpy(np.int64)[order]


def found_at(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are in known (ascending), and their places there."""
    if not len(known):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return known[at] == hashes, at
