"""Quality by hierarchical empirical Bayes: the document's own evidence, its path's and its host's.

A logistic model over counts of characters and words gives each document a probability, its
evidence. Hosts (source) and paths below them (language within the source) are random effects on
the rate of good documents: grouped sums give the variance within paths, between the paths of a
host and between hosts (analysis of variance), and from these follow the posterior means, a host's
shrunk to the rate of all and a path's to its host's, the more the less they hold. What a path tells
about its host is weighted by the variance of its mean, so a host whose documents all lie in one path is
known no better than that path. The rates for a document leave it out, in its path and in its host, so
nothing counts as evidence twice; the only document of a host has the rate of all. The final odds are Bayes' rule: the document's odds times the path's odds over the odds of all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchspark.plans.staging import stage

#: Labelled rows used to fit the document model, chosen by a hash of their id: the default of the
#: parameter fit_rows. The bound is small enough to broadcast their ids and to hold their features in
#: the driver.
FIT_ROWS = 20_000
HOST, PATH = "source", "lang"
#: Documents whose probability of being good is below this are rejected.
KEEP_FROM = 0.3
#: Probabilities nearer to 0 or 1 than this have the odds of this one.
_EDGE = 1e-4


def features(text: Column) -> dict[str, Column]:
    """Shares of kinds of characters and words; 0 for empty texts."""
    n = F.greatest(F.length(text), F.lit(1))
    split = F.split(F.translate(text, "\n\t", "  "), " ")
    words = F.size(split)
    lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    return {
        "symbols": share("#$%&*+<=>@\\^_`~{}[]/"),
        "bars": share("|"),
        "shouts": share("!"),
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / n,
        "digits": share("0123456789"),
        "stops": share(".,;:?"),
        "different": F.size(F.array_distinct(split)) / words,
        "word_length": F.length(text) / words / 10,
        "line_words": F.log1p(words / lines) / 5,
        "log_words": F.log1p(words) / 10,
    }


NAMES = tuple(["symbols", "bars", "shouts", "capitals", "digits", "stops", "different", "word_length", "line_words", "log_words"])


def design(x: np.ndarray) -> np.ndarray:
    """Columns of the model: the features and their square roots, so that small shares count."""
    return np.hstack([np.ones((len(x), 1)), x, np.sqrt(np.maximum(x, 0))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.03, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps. With one class only, that class is certain."""
    z = design(x)
    w = np.zeros(z.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if len(set(y.tolist())) < 2:
        return w
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> np.ndarray:
    """Weights from at most so many labelled documents, the same ones on every run."""
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    )
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    table = picked.select("doc_id", "quality", *(c.cast("double").alias(k) for k, c in features(F.coalesce("text", F.lit(""))).items()))
    # However often an id comes, it is one row of the sample.
    once = table.groupBy("doc_id", "quality").agg(F.min(F.struct(*NAMES)).alias("f")).select("doc_id", "quality", "f.*")
    got = once.toPandas().sort_values(["doc_id", "quality"])
    if got.empty:
        return np.zeros(1 + 2 * len(NAMES))
    return fit_logistic(got[list(NAMES)].to_numpy(float), got["quality"].to_numpy(float))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(_EDGE), F.least(F.lit(1 - _EDGE), p))
    return F.log(p / (1 - p))


def evidence(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds evidence: the document model's probability that a text is good."""
    cols = features(F.coalesce("text", F.lit("")))
    named = docs.withColumns({f"_q_{k}": cols[k].cast("double") for k in NAMES})
    z = F.lit(float(weights[0]))
    for i, k in enumerate(NAMES):
        z = z + F.col(f"_q_{k}") * float(weights[1 + i])
        z = z + F.sqrt(F.greatest(F.col(f"_q_{k}"), F.lit(0.0))) * float(weights[1 + len(NAMES) + i])
    return named.withColumn("evidence", 1 / (1 + F.exp(-z))).drop(*(f"_q_{k}" for k in NAMES))


@dataclass(frozen=True)
class Spread:
    """Rate of all documents, variance within paths, between paths of a host, between hosts."""

    mean: float
    within: float
    paths: float
    hosts: float


def spread(paths: DataFrame) -> Spread:
    """The variances from grouped sums (n, s, q: count, sum and sum of squares of evidence by host
    and path), by the moments of a nested analysis of variance. What cannot be told apart is 0."""
    hosts = paths.groupBy(HOST).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("c"),
    )
    t = hosts.agg(
        *(F.sum(c).cast("double").alias(c) for c in ("n", "s", "q", "k", "n2", "c")), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("h"), F.sum(F.col("n2") / F.col("n")).alias("m"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nh2"),
    ).first()
    if not t["n"]:
        return Spread(0.5, 0.0, 0.0, 0.0)
    share = lambda a, b: max(0.0, a / b) if b > 1e-9 else 0.0
    within = share(t["q"] - t["c"], t["n"] - t["k"])
    between_paths = share(t["c"] - t["h"] - (t["k"] - t["hosts"]) * within, t["n"] - t["m"])
    rest = (t["hosts"] - 1) * within + (t["m"] - t["n2"] / t["n"]) * between_paths
    between_hosts = share(t["h"] - t["s"] ** 2 / t["n"] - rest, t["n"] - t["nh2"] / t["n"])
    return Spread(t["s"] / t["n"], within, between_paths, between_hosts)


#: Variance within paths that is assumed at least, so that documents without any still weigh something.
LEAST_WITHIN = 1e-6


def told(n: Column, v: Spread) -> Column:
    """How much n documents of a path tell about its host: one over the variance of their mean around
    the host's rate."""
    return n / (n * v.paths + max(v.within, LEAST_WITHIN))


def host_posterior(weight: Column, weighted: Column, v: Spread) -> Column:
    """Posterior mean of a host's rate from the sums over its paths of what each tells, and of that
    times the mean of its documents; the rate of all where nothing tells."""
    return (v.hosts * weighted + v.mean) / (v.hosts * weight + 1)


def path_posterior(n: Column, s: Column, host_rate: Column, v: Spread) -> Column:
    """Posterior mean of a path with n documents whose evidence sums up to s, given its host's."""
    within = max(v.within, LEAST_WITHIN)
    return (v.paths * s + within * host_rate) / (v.paths * n + within)


def site_rates(scored: DataFrame) -> tuple[DataFrame, Spread]:
    """One row per path (host, path, n, s, weight, weighted, host_rate, path_rate), and the variances used.
    weight and weighted are the sums over the paths of its host that host_posterior() takes."""
    e = F.col("evidence")
    paths = stage(scored.groupBy(HOST, PATH).agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("q")), "quality-sites")
    v = spread(paths)
    tells = told(F.col("n"), v)
    hosts = paths.groupBy(F.col(HOST).alias("_h")).agg(F.sum(tells).alias("weight"), F.sum(tells * F.col("s") / F.col("n")).alias("weighted"))
    below = paths.join(hosts, F.col(HOST).eqNullSafe(F.col("_h"))).drop("_h", "q")
    rated = below.withColumn("host_rate", host_posterior(F.col("weight"), F.col("weighted"), v))
    return rated.withColumn("path_rate", path_posterior(F.col("n"), F.col("s"), F.col("host_rate"), v)), v


def rate_of_others(n: Column, s: Column, weight: Column, weighted: Column, own: Column, v: Spread) -> Column:
    """The rate of a document's path from all documents but itself (own: its evidence): the path's sums are
    taken without it, and so is what the path tells about the host."""
    left, rest = n - 1, s - own
    mean = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    weight_left = weight - told(n, v) + told(left, v)
    weighted_left = weighted - told(n, v) * mean(s, n) + told(left, v) * mean(rest, left)
    return path_posterior(left, rest, host_posterior(weight_left, weighted_left, v), v)


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, leave_out: tuple[str, ...] = ("text",)) -> DataFrame:
    """docs with evidence, path_rate, quality (the final probability) and keep, but without the
    columns to leave out: the evidence is staged with all others, so that it is worked out once.

    The model is fitted on at most fit_rows labelled documents; sites are counted over all. The
    table of sites is joined by host and path, null being a site of its own. Null and empty texts
    have the evidence of an empty text. Without labels every document has the same odds and stays.
    Repeated rows count each; an empty table stays empty; columns of docs named like those added are
    replaced.
    """
    docs = docs.drop("evidence", "path_rate", "quality", "keep")
    scored = stage(evidence(docs, fit(docs, labels, fit_rows)).drop(*leave_out), "quality-evidence")
    rates, v = site_rates(scored.select(HOST, PATH, "evidence"))
    rates = rates.select(F.col(HOST).alias("_h"), F.col(PATH).alias("_p"), "n", "s", "weight", "weighted")
    sites = F.struct("n", "s", "weight", "weighted").alias("_site")
    same = F.col(HOST).eqNullSafe(F.col("_h")) & F.col(PATH).eqNullSafe(F.col("_p"))
    own = F.col("evidence")
    others = rate_of_others(*(F.col(f"_site.{c}") for c in ("n", "s", "weight", "weighted")), own, v)
    z = _logit(own) + _logit(F.col("path_rate")) - _logit(F.lit(v.mean))
    return (
        scored.join(rates.select("_h", "_p", sites), same, "left").drop("_h", "_p").withColumn("path_rate", others).drop("_site")
        .withColumn("quality", 1 / (1 + F.exp(-z))).withColumn("keep", F.col("quality") >= KEEP_FROM)
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, evidence, path_rate, quality and keep for every document."""
    return score(docs.select("doc_id", "text", HOST, PATH), labels).select("doc_id", "evidence", "path_rate", "quality", "keep")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs whatever their names. Nulls, empty
    texts, repeats and an empty table: as in score()."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all")
    return score(docs.select(row, "doc_id", "text", HOST, PATH), labels).filter("keep").select("_all.*")
