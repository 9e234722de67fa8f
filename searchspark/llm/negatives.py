"""Hard negatives, with exact integer scores from a residue number system.

Components become integers. Of every vector the residues modulo a few small primes are kept as
32-bit floating numbers, and the matrices of anchors and rows are multiplied once for each prime;
at most DIM products of residues below PRIME_BELOW / 2 are added at a time, so every sum is exact.
Chinese remaindering puts the residues together to the signed score; there are as many primes as
the longest vector asks for.

Anchors are a stated set of queries against all rows. They are taken in blocks of BLOCK, which is
what one broadcast holds; each task walks its rows in tiles and keeps, for each anchor, the best
few, which a window over the anchor's few rows puts in order. The first pass finds positives, the
second, for each of them, the negatives within its window of scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchspark.plans.staging import new_path, stage

#: Components multiplied and added before residues are reduced; primes are below this: then
#: DIM * (PRIME_BELOW / 2) ** 2 stays within the 24 bits that a 32-bit floating number holds.
DIM, PRIME_BELOW = 256, 512
#: Numbers in the anchors of one broadcast (8 bytes each), and rows and anchors of one tile.
BLOCK_NUMBERS, TILE = 1 << 22, 1024
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def primes_for(bound: int) -> list[int]:
    """The largest primes below PRIME_BELOW whose product exceeds 2 * bound; scores within bound
    (in absolute value) can then be told apart."""
    out, product = [], 1
    for n in range(PRIME_BELOW - 1, 2, -1):
        if product > 2 * bound:
            return out
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            out.append(n)
            product *= n
    raise OverflowError(f"scores up to {bound} need more primes than there are")


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, nearest to zero, as 32-bit floating numbers."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a times the transpose of b modulo p, from 0 to p - 1."""
    out = np.zeros((len(a), len(b)), np.int32)
    for at in range(0, a.shape[1], DIM):
        out += np.matmul(a[:, at : at + DIM], b[:, at : at + DIM].T).astype(np.int32) % p
        out %= p
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of the rows of two matrices, given as residues for each prime.

    The score is written as digits, each nearest to zero, with the products of the primes before as
    their weights. Sums of 64 bits may overflow on the way, but the score itself does not.
    """
    value = np.zeros((len(a[0]), len(b[0])), np.int64)
    digits: list[np.ndarray] = []
    weights: list[int] = []
    product = 1
    for x, y, p in zip(a, b, primes, strict=True):
        rest = _product(x, y, p)
        for digit, weight in zip(digits, weights, strict=True):
            rest = rest - digit * (weight % p) % p
        rest = rest % p * pow(product, -1, p) % p
        digits.append(np.where(rest > p // 2, rest - p, rest))
        weights.append(product)
        value += digits[-1].astype(np.int64) * np.array([product % (1 << 64)], np.uint64).astype(np.int64)
        product *= p
    return value


class Best:
    """For each of n lists, the first k entries by score downwards, then id, then key."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _NONE, np.int64)
        self.id = np.full((n, k), _LAST, np.int64)
        self.key = np.full((n, k), _LAST, np.int64)

    def add(self, at: int, offered: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        """Offer scores (_NONE: not offered) of rows to the lists at to at + len(offered)."""
        least = self.score[at : at + len(offered), -1, None]
        good = (offered >= least) & (offered != _NONE)
        if np.count_nonzero(good) > 4 * self.k * len(offered) and offered.shape[1] > self.k:
            # Of many, only those that can be among the first k of this tile.
            good &= offered >= np.partition(offered, -self.k, axis=1)[:, -self.k, None]
        lists, columns = np.nonzero(good)
        if not lists.size:
            return
        touched, owner = np.unique(lists, return_inverse=True)
        held = at + touched
        owner = np.concatenate([np.repeat(np.arange(len(touched)), self.k), owner])
        score = np.concatenate([self.score[held].ravel(), offered[lists, columns]])
        ident = np.concatenate([self.id[held].ravel(), ids[columns]])
        key = np.concatenate([self.key[held].ravel(), keys[columns]])
        # The complement turns the order of scores round without overflow.
        order = np.lexsort((key, ident, ~score, owner))
        take = order[np.searchsorted(owner[order], np.arange(len(touched)))[:, None] + np.arange(self.k)]
        self.score[held], self.id[held], self.key[held] = score[take], ident[take], key[take]

    def rows(self) -> tuple[np.ndarray, ...]:
        """List, id, key and score of all entries."""
        lists, places = np.nonzero(self.score != _NONE)
        return lists, self.id[lists, places], self.key[lists, places], self.score[lists, places]


def prepared(embeddings: DataFrame) -> DataFrame:
    """Rows that take part, staged: key (different for each; negative without an id), vec_id (then
    the largest number), label, x (integers), bound (at least the sum of the squares of x)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    rows = embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("e")
    )
    number = F.monotonically_increasing_id()
    bound = F.aggregate("e", F.lit(0.0), lambda s, v: s + (F.abs(256 * v) + 1) * (F.abs(256 * v) + 1))
    return stage(
        rows.filter(finite).select(
            F.when(F.col("vec_id").isNull(), -1 - number).otherwise(number).alias("key"),
            F.coalesce("vec_id", F.lit(_LAST)).alias("vec_id"), "label", F.transform("e", lambda v: F.floor(256 * v)).alias("x"),
            bound.alias("bound"),
        ),
        "vectors",
    )


def _matrix(x: pd.Series, width: int) -> np.ndarray:
    """Vectors one below the other, shorter ones filled with zeros."""
    out = np.zeros((len(x), width), np.int64)
    for i, v in enumerate(x):
        out[i, : len(v)] = v
    return out


def _best(rows: DataFrame, block: pd.DataFrame, width: int, primes: list[int], places: int, windows: np.ndarray | None = None) -> DataFrame:
    """The first places rows for each anchor of block and slot: anchor (its place in the block), slot, rank,
    id, key, score.

    Without windows there is one slot, for rows of the anchor's label but itself. Otherwise windows holds the
    least and the largest score for each anchor and slot (none fits: least above largest), and rows of
    other labels count.
    """
    sent = rows.sparkSession.sparkContext.broadcast(
        (_matrix(block["x"], width), block["label"].to_numpy(np.int64), block["key"].to_numpy(np.int64), windows)
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors, labels, keys, limits = sent.value
        sides = [residues(anchors, p) for p in primes]
        best = [Best(len(anchors), places) for _ in range(1 if limits is None else limits.shape[1])]
        for batch in batches:
            for r in range(0, len(batch), TILE):
                part = batch.iloc[r : r + TILE]
                ids, label, key = (part[c].to_numpy(np.int64) for c in ("vec_id", "label", "key"))
                own = _matrix(part["x"], width)
                other = [residues(own, p) for p in primes]
                for a in range(0, len(anchors), TILE):
                    here = slice(a, a + TILE)
                    score = scores([s[here] for s in sides], other, primes)
                    alike = labels[here, None] == label
                    if limits is None:
                        best[0].add(a, np.where(alike & (keys[here, None] != key), score, _NONE), ids, key)
                        continue
                    for slot, b in enumerate(best):
                        fits = ~alike & (score >= limits[here, slot, 0, None]) & (score <= limits[here, slot, 1, None])
                        b.add(a, np.where(fits, score, _NONE), ids, key)
        for slot, b in enumerate(best):
            lists, ids, key, score = b.rows()
            yield pd.DataFrame({"anchor": lists, "slot": slot, "id": ids, "key": key, "score": score})

    found = rows.select("key", "vec_id", "label", "x").mapInPandas(walk, "anchor int, slot int, id long, key long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= places)


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of embeddings (vec_id, embedding, label): anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by every. Of the other rows of an anchor's label the
    first positives by score, then vec_id, are its positives; for each of them the first negatives of the
    rows of other labels that score low to high hundredths of it are returned. A vec_id divisible by 7
    has the label (label + 1) % 10.

    Rows without a label or vector, or with a component that is null or not finite, take no part. Every
    other row counts for itself, also where ids or whole rows repeat: an anchor is never its own positive,
    but its copies are. Rows without an id come last among equal scores and are no anchors. Of vectors of
    different length the missing components count as zero. An empty table, or one without anchors, has no
    rows. Other columns are ignored. Scores that 64 bits cannot hold are an error.
    """
    spark = embeddings.sparkSession
    rows = prepared(embeddings)
    anchors = rows.filter((F.col("vec_id") % every == 0) & (F.col("key") >= 0))
    width, bound = rows.agg(F.max(F.size("x")), F.max("bound")).first()
    folder = new_path(spark, "negatives")
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n = anchors.count()
    if not n:
        return spark.createDataFrame([], kind)
    if bound * 1.001 >= 2.0**63:
        raise OverflowError(f"scores up to {bound} do not fit 64 bits")
    width, primes = max(1, width), primes_for(int(bound * 1.001) + 1)
    blocks = -(-n * width // BLOCK_NUMBERS)
    for number in range(blocks):
        own = F.pmod(F.xxhash64("key"), F.lit(blocks)) == number
        block = anchors.filter(own).select("key", "vec_id", "label", "x").toPandas()
        if not len(block):
            continue
        found = stage(_best(rows, block, width, primes, positives), "positives")
        windows = np.tile(np.array([1, 0], np.int64), (len(block), positives, 1))
        for r in found.select("anchor", "rank", "score").collect():
            windows[r.anchor, r.rank - 1] = -(-low * r.score // 100), min(high * r.score // 100, _LAST)
        known = found.select(
            "anchor", (F.col("rank") - 1).alias("slot"), F.when(F.col("key") >= 0, F.col("id")).alias("positive_id"),
            F.col("score").alias("positive_score"),
        )
        ids = spark.createDataFrame(pd.DataFrame({"anchor": np.arange(len(block), dtype=np.int32), "anchor_id": block["vec_id"]}))
        out = _best(rows, block, width, primes, negatives, windows).join(known, ["anchor", "slot"]).join(ids, "anchor")
        out.select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
            F.when(F.col("key") >= 0, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(folder)
    return spark.read.schema(kind).parquet(folder)


#: The same result over a table without repeated rows, for DuckDB.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5
"""
