"""Approximate nearest documents: trained cells, short codes for what lies in them, exact scores for few.

Vectors are dealt into cells by their nearest centre. What is left of a vector beyond its centre is stored as a
code of one byte for each of its parts (product quantisation). A query looks into the cells whose centres are
nearest, estimates scores there from codes alone, and whole vectors are joined only for the best estimates.
Centres, codes and the number of cells to look into are fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchspark.operators.semantic import dot, nearest

#: Vectors that a fit reads at most, those of the smallest hashes of their ids.
SAMPLE = 20_000
#: Sampled vectors asked to find how many cells their neighbours lie in.
ASKED = 500
CODES, ROUNDS, MOST_CELLS = 256, 8, 1_024
#: Queries whose tables of part scores are sent to all tasks at once (16 KB each with 16 parts).
BLOCK = 500


@dataclass(frozen=True)
class Cells:
    """Centres (cells by width), codes of the parts (parts by codes by entries), cells that a query looks into."""

    centres: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def cut(self, m: np.ndarray) -> np.ndarray:
        """Rows of m in parts, the last one filled up with zeros."""
        parts, _, step = self.books.shape
        return np.pad(m, ((0, 0), (0, parts * step - m.shape[1]))).reshape(len(m), parts, step)

    def encode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of each row."""
        cell = _closest(m, self.centres)
        rest = self.cut(m - self.centres[cell])
        return cell, np.stack([_closest(rest[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def order(self, q: np.ndarray) -> np.ndarray:
        """For each query all cells, the most promising first."""
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")


def _closest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (m @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)


def _centres(m: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Centres of count clusters; one that loses all its rows stays where it was."""
    centres = m[np.random.default_rng(seed).permutation(len(m))[:count]].copy()
    for _ in range(ROUNDS):
        own = _closest(m, centres)
        order = np.argsort(own, kind="stable")
        used, starts, sizes = np.unique(own[order], return_index=True, return_counts=True)
        centres[used] = np.add.reduceat(m[order], starts, axis=0) / sizes[:, None]
    return centres


def _matrix(vectors: pd.Series, width: int | None = None) -> np.ndarray:
    m = np.vstack([np.asarray(v, np.float32) for v in vectors])
    if width is not None and m.shape[1] != width:
        raise ValueError(f"a vector has {m.shape[1]} entries, the cells were fitted on {width}")
    return m


def fit(index: DataFrame, k: int = 10, found: float = 0.98, parts: int = 16, sample: int = SAMPLE) -> Cells:
    """Cells for index (id, embedding), from a sample of at most so many vectors. The cells that a query looks into
    are as many as hold the share found of the k nearest ones in the sample; vectors without clusters need most of
    them, clustered ones few. Vectors of different widths are an error; null ones take no part; without any, there
    is one cell of width 1."""
    read = index.filter("embedding is not null").select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    m = _matrix(read["embedding"]) if len(read) else np.zeros((1, 1), np.float32)
    count = int(min(MOST_CELLS, 2 ** round(np.log2(max(1, len(m))) / 2)))
    centres = _centres(m, count, 1)
    step = -(-m.shape[1] // parts)
    bare = Cells(centres, np.zeros((-(-m.shape[1] // step), 1, step), np.float32), count)
    rest = bare.cut(m - centres[_closest(m, centres)])
    books = [_centres(rest[:, p], min(CODES, len(m)), p + 2) for p in range(rest.shape[1])]
    asked = m[:ASKED]
    alike = asked @ m.T
    best = np.argsort(-alike, axis=1, kind="stable")[:, : k + 1]
    place = np.argsort(bare.order(asked), axis=1)
    need = np.take_along_axis(place, _closest(m, centres)[best], axis=1)
    return Cells(centres, np.stack(books), int(np.quantile(need, found, method="higher")) + 1)


def coded(index: DataFrame, cells: Cells) -> DataFrame:
    """id, cell, code of every vector. Written as a table in the order of cells within its files, those that no query
    looks into are passed over by their bounds; nothing is shuffled, so a cell with a third of all rows is no harm."""
    shared = index.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("cell int, code binary")
    def encode(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": [], "code": []})
        cell, code = shared.value.encode(_matrix(vectors, shared.value.width))
        return pd.DataFrame({"cell": cell.astype(np.int32), "code": [c.tobytes() for c in code]})

    known = index.filter("embedding is not null").select("id", encode("embedding").alias("_e"))
    return known.select("id", "_e.cell", "_e.code").sortWithinPartitions("cell")


def estimated(queries: DataFrame, codes: DataFrame, cells: Cells, keep: int) -> DataFrame:
    """query_id, id, estimate, rank: the keep best documents of each query (query_id, vector) by their codes alone.

    Queries are a stated set: they are counted, dealt by hash, and each block of bounded size goes to all tasks.
    A task keeps its own best of a query before anything is shuffled."""
    spark = queries.sparkSession
    asked = queries.filter("vector is not null").select("query_id", "vector")
    blocks = max(1, -(-asked.count() // BLOCK))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {codes.schema['id'].dataType.simpleString()}, estimate float"

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values(["estimate", "id"], ascending=[False, True]).groupby("query_id", sort=False).head(keep)

    def one(block: int) -> DataFrame | None:
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
        if own.empty:
            return None
        q = _matrix(own["vector"], cells.width)
        looks = cells.order(q)[:, : cells.probes]
        tables = np.einsum("qps,pcs->pqc", cells.cut(q), cells.books, optimize=True).astype(np.float32)
        sent = spark.sparkContext.broadcast((own["query_id"].to_numpy(), looks, q @ cells.centres.T, tables))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, looks, near, tables = sent.value
            top = pd.DataFrame({"query_id": names[:0], "id": pd.Series([], dtype=object), "estimate": np.zeros(0, np.float32)})
            for b in batches:
                code = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), len(tables))
                cell, ids = b["cell"].to_numpy(), b["id"].to_numpy()
                found = [top]
                for c in np.unique(cell):
                    here, by = np.flatnonzero(cell == c), np.flatnonzero((looks == c).any(axis=1))
                    if not len(by):
                        continue
                    score = np.repeat(near[by, c][:, None], len(here), axis=1)
                    for p, t in enumerate(tables):
                        score += t[by][:, code[here, p]]
                    found.append(pd.DataFrame({"query_id": np.repeat(names[by], len(here)), "id": np.tile(ids[here], len(by)), "estimate": score.ravel()}))
                top = best(pd.concat([f for f in found if len(f)])) if any(map(len, found)) else top
            yield top

        wanted = codes.filter(F.col("cell").isin(np.unique(looks).tolist()))
        return wanted.select("id", "cell", "code").mapInPandas(scan, schema)

    parts = [p for p in map(one, range(blocks)) if p is not None]
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return rows.withColumn("rank", nearest("estimate")).filter(F.col("rank") <= keep)


def semantic_cells(queries: DataFrame, index: DataFrame, codes: DataFrame, cells: Cells, k: int, again: int = 10) -> DataFrame:
    """query_id, id, semantic_score, rank, as semantic(): the k nearest documents of each query among the again * k of
    the best estimates; scores are exact, ties by id. Repeated rows of an id count each in the estimates."""
    near = estimated(queries, codes, cells, again * k).select("query_id", "id").distinct()
    asked = queries.filter("vector is not null").select("query_id", "vector")
    pairs = near.join(index.filter("embedding is not null").select("id", "embedding"), "id").join(asked, "query_id")
    scored = pairs.select("query_id", "id", F.round(dot(F.col("embedding"), F.col("vector")), 6).alias("semantic_score"))
    return scored.withColumn("rank", nearest()).filter(F.col("rank") <= k)
