"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive sample, all other training texts are unlabelled. A linear
model over the words a text contains is trained in numpy on the estimator of the risk that needs
no negative sample: with the class prior p and the sigmoid loss, p R_P(+1) + max(0, R_U(-1) - p R_P(-1));
where the second part falls below zero, its gradient is taken back (Kiryo et al., 2017).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Fit:
    """What bounds and steers the fit; the scores go over all documents whatever these are.

    Training texts are documents with a label, chosen by a hash of their id: at most positive
    confirmed toxic ones, and at most unlabelled ones whose labels are not looked at. Features are
    words and word beginnings that at least min_texts positive texts have, and by z standard errors
    more often than the unlabelled texts; at most most_features, the surest first. Of training texts
    that agree in at least alike of slots minimum hashes of five words in a row, one is used.
    """

    positive: int = 2_000
    unlabelled: int = 8_000
    min_texts: int = 6
    z: float = 5.0
    most_features: int = 3_000
    epochs: int = 60
    batch: int = 500
    rate: float = 0.05
    decay: float = 3e-4
    seed: int = 7
    slots: int = 4
    alike: int = 2


BEGINNINGS = (4, 5)
ROW = 5
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    """The words a text contains, in lower case."""
    return set(_WORD.findall(text.lower()))


def features(found: set[str]) -> set[str]:
    """The words and their beginnings (marked by a hyphen)."""
    out = set(found)
    for n in BEGINNINGS:
        out.update([w[:n] + "-" for w in found if len(w) > n])
    return out


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_texts(docs: DataFrame, labels: DataFrame, fit: Fit) -> pd.DataFrame:
    """words, positive of the bounded sample: confirmed toxic documents, and labelled documents
    drawn without a look at their labels, so that they hold toxic ones in the share of prior(). Near
    copies within either part count once; so does an id, however many rows it has."""
    learnt = labels.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    pick = lambda df, n, mark: (
        df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).withColumn("positive", F.lit(mark))
    )
    chosen = pick(learnt.filter("toxic = 1"), fit.positive, 1).unionByName(pick(learnt.filter("toxic is not null"), fit.unlabelled, 0))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = _presence(rows, fit.slots).groupBy("doc_id", "positive").agg(F.min(F.struct("words", "hashes")).alias("w"))
    sample = once.select("doc_id", "positive", "w.*").toPandas().sort_values(["doc_id", "positive"])
    parts = [sample[sample["positive"] == mark] for mark in (1, 0)]
    return pd.concat([part.iloc[without_copies(part["hashes"].tolist(), fit.alike)] for part in parts], ignore_index=True)


def _presence(rows: DataFrame, slots: int) -> DataFrame:
    """The words of each text in place of the text, sorted, joined by spaces."""

    def to_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [" ".join(sorted(words(t))) for t in b["text"]]
            hashes = [" ".join(map(str, least_hashes(t, slots))) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "positive": b["positive"], "words": found, "hashes": hashes})

    return rows.select("doc_id", "positive", "text").mapInPandas(to_words, "doc_id long, positive int, words string, hashes string")


def prior(labels: DataFrame) -> float:
    """Share of toxic documents among the labelled training ones."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    share = known.agg(F.avg("toxic")).first()[0]
    return float(min(max(share or 0.0, 1e-3), 0.5))


def least_hashes(text: str, slots: int = Fit.slots) -> list[int]:
    """Minimum hashes of the text's runs of ROW words."""
    found = _WORD.findall(text.lower())
    rows = [" ".join(found[i : i + ROW]).encode() for i in range(max(1, len(found) - ROW + 1))]
    own = np.array([zlib.crc32(r) for r in rows], dtype=np.uint64)
    mixed = [(own + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k) >> np.uint64(8) for k in range(slots)]
    return [int(m.min()) for m in mixed]


def without_copies(hashes: list[str], alike: int = Fit.alike) -> list[int]:
    """Places of texts that agree with none before in so many minimum hashes."""
    seen: dict[tuple[int, str], list[int]] = {}
    kept = []
    for i, h in enumerate(hashes):
        own = list(enumerate(h.split()))
        shared = Counter(j for slot in own for j in seen.get(slot, ()))
        if max(shared.values(), default=0) < alike:
            kept.append(i)
        for slot in own:
            seen.setdefault(slot, []).append(i)
    return kept


def telling(texts: list[str], positive: np.ndarray, fit: Fit) -> list[str]:
    """Features that positive texts have significantly more often."""
    mine = Counter(f for t, p in zip(texts, positive, strict=True) if p for f in features(set(t.split())))
    mine = {f: c for f, c in mine.items() if c >= fit.min_texts}
    rest: Counter[str] = Counter()
    for t, p in zip(texts, positive, strict=True):
        if not p:
            rest.update(mine.keys() & features(set(t.split())))
    n_p, n_u = int(positive.sum()), int((~positive).sum())

    def z(f: str) -> float:
        share = (mine[f] + rest[f]) / (n_p + n_u)
        return (mine[f] / n_p - rest[f] / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)

    scored = sorted(((-z(f), f) for f in mine))
    return [f for s, f in scored[: fit.most_features] if -s >= fit.z]


def risk_slopes(s: np.ndarray, is_pos: np.ndarray, p: float) -> tuple[np.ndarray, bool]:
    """Slopes of the estimated risk by each text's output, whose sigmoid is s, and whether the
    negative part was below zero, so that its slopes are taken back and nothing else moves."""
    slope, n_p, n_u = s * (1 - s), max(1, is_pos.sum()), max(1, (~is_pos).sum())
    negative = s[~is_pos].sum() / n_u - p * s[is_pos].sum() / n_p
    if negative >= 0:
        return np.where(is_pos, -2 * p * slope / n_p, slope / n_u), False
    return np.where(is_pos, p * slope / n_p, -slope / n_u), True


def train(texts: list[str], positive: np.ndarray, p: float, fit: Fit = Fit()) -> tuple[dict[str, float], float]:  # noqa: B008
    """Weights of features, and the intercept, from texts given as their words. Without a positive
    or an unlabelled text, or without a telling feature, only the prior counts."""
    start = float(np.log(p / (1 - p)))
    vocabulary = telling(texts, positive, fit) if positive.any() and not positive.all() else []
    if not vocabulary:
        return {}, start
    place = {w: i for i, w in enumerate(vocabulary)}
    rows = [np.array(sorted(place[f] for f in place.keys() & features(set(t.split()))), dtype=np.int64) for t in texts]
    random = np.random.default_rng(fit.seed)
    w, b = np.zeros(len(vocabulary)), start
    m, v, mb, vb, step = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    batches = max(1, len(unl) // fit.batch)

    def flat(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [rows[i] for i in chosen]
        return np.concatenate(own), np.repeat(np.arange(len(own)), [len(r) for r in own])

    for _ in range(fit.epochs):
        pos_order, unl_order = random.permutation(pos), random.permutation(unl)
        for k in range(batches):
            at, owner = flat(pu := np.concatenate([pos_order[k::batches] if len(pos) >= batches else pos, unl_order[k::batches]]))
            is_pos = positive[pu]
            z = b + np.bincount(owner, weights=w[at], minlength=len(pu))
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g, _ = risk_slopes(s, is_pos, p)
            gw = np.bincount(at, weights=g[owner], minlength=len(w)) + fit.decay * p * w
            gb, step = g.sum(), step + 1
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            w -= fit.rate * fix * m / (np.sqrt(v) + 1e-7)
            b -= fit.rate * fix * mb / (np.sqrt(vb) + 1e-7)
    return dict(zip(vocabulary, w.tolist(), strict=True)), float(b)


def classify(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, score and predicted for every document.

    Only the text goes into a score; null and empty texts have the score of no words. Repeated rows
    get the same score; an empty table stays empty; null ids count as held out; other columns are
    ignored. The model is fitted on a bounded sample (Fit); it is at most fit.most_features words, sent to the
    tasks as a broadcast variable.
    """
    sample = training_texts(docs, labels, fit)
    p = prior(labels)
    model = train(sample["words"].tolist(), sample["positive"].to_numpy() == 1, p, fit)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(text: pd.Series) -> pd.Series:
        weights, b = shared.value
        known = weights.keys()
        z = np.array([b + sum(weights[f] for f in sorted(features(words(t)) & known)) for t in text], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    text = F.coalesce("text", F.lit(""))
    scored = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), F.pandas_udf(score, "double")(text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
