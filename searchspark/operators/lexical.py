"""Lexical search: token table, typos, synonyms, ranking by rules in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchspark.functions.stemmer import stem
from searchspark.functions.text import (
    cyr_to_lat, has_cyrillic, lat_to_cyr, normalize, normalize_native, stems, tokens,
)
from searchspark.plans.staging import stage

#: One typo from this length of a query word, two from the next.
ONE_TYPO, TWO_TYPOS = 4, 8
FARTHEST = 7
#: Entries of lists from which the first candidates of a query come, about; matching tokens sent to all tasks.
PROBE, SMALL = 200, 200_000
#: Bits of a number in a packed place: no text has more words.
_BITS = 28


def token_table(index: DataFrame, fields: list[str]) -> DataFrame:
    """One row per word of a searchable field: collection, id, field_rank, pos, token."""
    lists = F.array(*(
        F.struct(F.lit(i).alias("field_rank"), tokens(normalize_native(F.coalesce(F.col(f), F.lit("")))).alias("words"))
        for i, f in enumerate(fields)
    ))
    by_field = index.select("collection", "id", F.explode(lists).alias("l"))
    return by_field.select("collection", "id", "l.field_rank", F.posexplode("l.words").alias("pos", "token"))


def query_variants(queries: DataFrame, stemmer: Callable[[str], str] | None = stem, transliteration: bool = True) -> DataFrame:
    """query_id, variant, n: the normal form of a query, its stems, the form in the other alphabet, and
    the stems of that; distinct, not empty, numbered in this order."""
    normal = F.coalesce(normalize(F.col("query")), F.lit(""))
    forms = queries.select("query_id", normal.alias("_n")).withColumn("_o", F.when(has_cyrillic(F.col("_n")), cyr_to_lat(F.col("_n"))).otherwise(lat_to_cyr(F.col("_n"))))
    stemmed = lambda c: [F.array_join(stems(F.col(c), stemmer, lambda t: t), " ")] if stemmer else []
    listed = F.array(F.col("_n"), *stemmed("_n"), *([F.col("_o"), *stemmed("_o")] if transliteration else []))
    ready = forms.select("query_id", F.array_distinct(F.filter(listed, lambda v: v != "")).alias("v"))
    return ready.select("query_id", F.posexplode("v").alias("n", "variant")).select("query_id", "variant", "n")


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, qpos, qtoken."""
    return queries.select("query_id", F.posexplode(tokens(normalize_native(F.col("query")))).alias("qpos", "qtoken"))


def allowed_typos(word: Column) -> Column:
    """How many typos a query word may have."""
    n = F.length(word)
    return F.when(n < ONE_TYPO, 0).when(n < TWO_TYPOS, 1).otherwise(2)


def vocabulary(token_rows: DataFrame) -> DataFrame:
    """Distinct tokens."""
    return token_rows.select("token").distinct()


def _pieces(word: Column, k: int) -> Column:
    """A word of the vocabulary in k + 1 pieces: array of (k, n, i, piece), n its length."""
    n = F.length(word)
    cut = [F.floor(n * i / (k + 1)).cast("int") for i in range(k + 2)]
    return F.array(*(
        F.struct(F.lit(k).alias("k"), n.alias("n"), F.lit(i).alias("i"), F.substring(word, cut[i] + 1, cut[i + 1] - cut[i]).alias("piece"))
        for i in range(k + 1)
    ))


def _places(word: Column, k: int) -> Column:
    """Where the pieces of words within k typos can lie in a query word: as _pieces(), for each length
    n that is possible. The first piece lies at the beginning, the last one at the end, others within k
    of their own place."""
    m = F.length(word)

    def of_length(n: Column) -> Column:
        cut = [F.floor(n * i / (k + 1)).cast("int") for i in range(k + 2)]
        out = []
        for i in range(k + 1):
            shifts = [F.lit(0)] if i == 0 else [m - n] if i == k else [F.lit(d) for d in range(-k, k + 1)]
            size = cut[i + 1] - cut[i]
            for d in shifts:
                inside = (cut[i] + d >= 0) & (cut[i] + d + size <= m)
                piece = F.when(inside, F.substring(word, cut[i] + d + 1, size))
                out.append(F.struct(F.lit(k).alias("k"), n.alias("n"), F.lit(i).alias("i"), piece.alias("piece")))
        return F.array(*out)

    return F.array_distinct(F.flatten(F.transform(F.sequence(m - k, m + k), of_length)))


def typo_candidates(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """qtoken, token, typos for words of the vocabulary within the allowed typos.

    Of a word cut in k + 1 pieces, k typos leave one piece as it is. So words of the vocabulary are
    joined by their pieces, a handful each, with the places where query words can hold them; only words
    that share one are compared, and the comparison stops beyond the allowed distance. Query words are
    the small side; whether they are broadcast is left to their size as Spark finds it.
    """
    asked = words.select("qtoken").distinct().withColumn("k", allowed_typos(F.col("qtoken")))
    exact = vocab.join(asked, F.col("token") == F.col("qtoken")).select("qtoken", "token", F.lit(0).alias("typos"))
    longest, token = F.length("token"), F.col("token")
    pieces = vocab.filter(longest >= ONE_TYPO - 1).select("token", F.explode(F.concat(
        _pieces(token, 1), F.when(longest >= TWO_TYPOS - 2, _pieces(token, 2)).otherwise(F.slice(_pieces(token, 2), 1, 0))
    )).alias("p")).select("token", "p.*")
    qtoken = F.col("qtoken")
    places = asked.filter("k > 0").select("qtoken", F.explode(F.when(F.col("k") == 1, _places(qtoken, 1)).otherwise(_places(qtoken, 2))).alias("p"))
    near = pieces.join(places.select("qtoken", "p.*"), ["k", "n", "i", "piece"]).withColumn("typos", F.levenshtein("token", "qtoken", 2))
    close = near.filter((F.col("typos") > 0) & (F.col("typos") <= F.col("k"))).select("qtoken", "token", "typos").distinct()
    return exact.unionByName(close)


def expand_synonyms(words: DataFrame, synonyms: DataFrame) -> DataFrame:
    """qtoken, token, typos (0) for the synonyms (word, synonym) of query words."""
    return words.select("qtoken").distinct().join(synonyms, F.col("qtoken") == F.col("word")).select("qtoken", F.col("synonym").alias("token"), F.lit(0).alias("typos"))


def _place(*names: str) -> Column:
    """Small numbers as one that has their order; unlike a struct, its minimum is a hash aggregate."""
    return reduce(lambda held, c: F.shiftleft(held, _BITS).bitwiseOR(F.col(c).cast("bigint")), names[1:], F.col(names[0]).cast("bigint"))


def _unpacked(place: str, *names: str) -> list[Column]:
    """The numbers of a place as columns."""
    low = F.lit((1 << _BITS) - 1).cast("bigint")
    shifts = range(_BITS * (len(names) - 1), -1, -_BITS)
    return [F.shiftright(place, n).bitwiseAND(low).cast("int").alias(c) for c, n in zip(names, shifts, strict=True)]


def postings(token_rows: DataFrame) -> DataFrame:
    """The best place of each token in each document: collection, id, token, field_rank, pos. That is the
    best field, then the first place, whatever is asked, as typos are the same for all places of a token."""
    best = token_rows.groupBy("collection", "id", "token").agg(F.min(_place("field_rank", "pos")).alias("p"))
    return best.select("collection", "id", "token", *_unpacked("p", "field_rank", "pos"))


def best_places(index: DataFrame, fields: list[str]) -> DataFrame:
    """postings() of the token_table() of an index with one row of a document, without a shuffle: a document's words lie in
    its row, so tasks pick their first places."""
    lists = [tokens(normalize_native(F.coalesce(F.col(f), F.lit("")))).alias(f"w{i}") for i, f in enumerate(fields)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [b.column(2 + i) for i in range(len(fields))]
            counts = [np.diff(h.offsets.to_numpy()) for h in held]
            words = pa.concat_arrays([h.flatten() for h in held]).dictionary_encode()
            row = np.concatenate([np.repeat(np.arange(b.num_rows), n) for n in counts])
            field = np.repeat(np.arange(len(fields)), [n.sum() for n in counts])
            pos = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in counts])
            # The lists come field by field, so that the first place met is the best.
            _, at = np.unique(row * max(1, len(words.dictionary)) + words.indices.to_numpy(), return_index=True)
            own = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(own), b.column(1).take(own), words.dictionary.take(words.indices.take(pa.array(at))),
                 pa.array(field[at].astype(np.int32)), pa.array(pos[at].astype(np.int32))],
                names=["collection", "id", "token", "field_rank", "pos"],
            )

    kind = index.schema["id"].dataType.simpleString()
    return index.select("collection", "id", *lists).mapInArrow(first, f"collection string, id {kind}, token string, field_rank int, pos int").select("collection", "id", "token", "field_rank", "pos")


def query_words(queries: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """query_id, n, qpos, qtoken of queries (query_id, query), or of their variants (query_id, variant, n)."""
    forms = queries.select("query_id", "query", F.lit(0).alias("n")) if variants is None else variants.select("query_id", F.col("variant").alias("query"), "n")
    return forms.select("query_id", "n", F.posexplode(tokens(normalize_native(F.col("query")))).alias("qpos", "qtoken"))


def matching_tokens(asked: DataFrame, vocab: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Staged: the words asked (query_words()) with the tokens of a vocabulary that match them, and typos."""
    found = typo_candidates(asked, vocab)
    if synonyms is not None:
        found = found.unionByName(expand_synonyms(asked, synonyms)).groupBy("qtoken", "token").agg(F.min("typos").alias("typos"))
    return stage(asked.join(found, "qtoken"), "lexical-wanted")


_HIT = ["query_id", "n", "collection", "id"]


def _figures(hits: DataFrame, asked: DataFrame, n_fields: int) -> DataFrame:
    """The figures of the rules for hits (places of tokens joined with matching_tokens()), by query and form."""
    place = ("typos", "field_rank", "pos")
    best = hits.groupBy(*_HIT, "qpos").agg(F.min(_place(*place)).alias("p")).select(*_HIT, "qpos", *_unpacked("p", *place))
    before = Window.partitionBy(*_HIT).orderBy("qpos")
    same = F.lag("field_rank").over(before) == F.col("field_rank")
    far = F.when(same, F.least(F.abs(F.col("pos") - F.lag("pos").over(before)) - 1, F.lit(FARTHEST))).otherwise(FARTHEST)
    gap = F.when(F.lag("qpos").over(before).isNull(), 0).otherwise(F.greatest(far, F.lit(0)))
    figures = best.withColumn("gap", gap).groupBy(*_HIT).agg(
        F.count(F.lit(1)).alias("words"), F.sum("typos").alias("typos"), F.sum("gap").alias("proximity"),
        F.min("field_rank").alias("attribute"), F.sum((F.col("typos") == 0).cast("int")).alias("exact"),
    )
    out = figures.join(asked.groupBy("query_id", "n").agg(F.count(F.lit(1)).alias("asked")), ["query_id", "n"])
    parts = [
        F.col("words") / F.col("asked"), 1 - F.col("typos") / (2 * F.col("asked")), 1 / (1 + F.col("proximity")),
        1 - F.col("attribute") / n_fields, F.col("exact") / F.col("asked"),
    ]
    weights = (0.4, 0.2, 0.1, 0.1, 0.2)
    return out.withColumn("lexical_score", sum((p * w for p, w in zip(parts, weights, strict=True)), F.lit(0.0)))


def lexical(
    queries: DataFrame, token_rows: DataFrame, n_fields: int, synonyms: DataFrame | None = None, variants: DataFrame | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """query_id, collection, id and the figures of the rules: words, typos, proximity, attribute,
    exact, asked, lexical_score. token_rows is a stored token_table() or, better, its postings(); it
    is read twice, or once where wanted (matching_tokens()) is given.

    Of the places where a query word is found in a document, the one with the fewest typos, then
    the best field, then the first counts. Proximity is the distance of neighbouring query words,
    less one, at most FARTHEST each. With variants (query_id, variant, n; see query_variants()) each
    is asked, and the best one by score, then by number, counts.
    """
    asked = query_words(queries, variants)
    if wanted is None:
        wanted = matching_tokens(asked, vocabulary(token_rows), synonyms)
    # Each entry is shuffled once, whichever queries ask for it; what follows is about one document at a time.
    lists = token_rows.join(_sent(wanted.select("token").distinct()), "token", "left_semi").repartition("collection", "id")
    scored = _figures(lists.join(_sent(wanted), "token"), asked, n_fields)
    if variants is None:
        return scored.drop("n")
    rest = F.struct("words", "typos", "proximity", "attribute", "exact", "asked", "lexical_score")
    top = scored.groupBy("query_id", "collection", "id").agg(F.max_by(rest, F.struct("lexical_score", -F.col("n"))).alias("b"))
    return top.select("query_id", "collection", "id", "b.*")


def _sent(rows: DataFrame) -> DataFrame:
    """Rows for a join: sent to all tasks where they are counted and few, else dealt by their keys."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def lexical_top(
    queries: DataFrame, places: DataFrame, n_fields: int, k: int, wanted: DataFrame | None = None, sort: list[Column] | None = None,
) -> DataFrame:
    """As lexical(), the first k documents of each query by rules(), with rank; places are stored postings().

    How many words match comes first in the rules, so lists of frequent words need not be walked. Lists are
    taken by size, smallest first. A document outside of the first r of m lists has m - r words at most.
    First the lists up to about PROBE entries bring candidates, whose figures are worked out in full; the
    k-th of them has w words. Any document with w words or more lies in one of the first m - w + 1 lists,
    and these bring the candidates of the second round, for queries for which r lists were not enough. Of
    long lists only the entries of candidates leave the task that reads them.
    """
    asked = query_words(queries)
    if wanted is None:
        wanted = matching_tokens(asked, vocabulary(places))
    wanted = _sent(wanted)
    sizes = places.join(_sent(wanted.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    lists = wanted.join(sizes, "token").groupBy("query_id", "qpos").agg(F.sum("size").alias("size"))
    by_size = Window.partitionBy("query_id").orderBy("size", "qpos")
    lists = lists.withColumns({
        "place": F.row_number().over(by_size), "so_far": F.sum("size").over(by_size.rowsBetween(Window.unboundedPreceding, 0)),
        "m": F.count(F.lit(1)).over(Window.partitionBy("query_id")),
    })
    lists = stage(lists, "lexical-lists")
    probe = max(PROBE, 4 * k)
    first = lists.groupBy("query_id").agg(F.greatest(F.lit(1), F.count(F.when(F.col("so_far") <= probe, 1))).alias("r"), F.first("m").alias("m"))
    order = Window.partitionBy("query_id").orderBy(*rules(sort))

    def best(turn: DataFrame) -> DataFrame:
        """The first k among the candidates that the first r lists of each query in turn bring."""
        bringing = wanted.join(lists.join(turn, "query_id").filter("place <= r").select("query_id", "qpos"), ["query_id", "qpos"])
        candidates = stage(places.join(_sent(bringing.select("query_id", "token").distinct()), "token").select("query_id", "collection", "id").distinct(), "lexical-candidates")
        hits = places.join(wanted, "token").join(_sent(candidates), ["query_id", "collection", "id"], "left_semi")
        return _figures(hits, asked, n_fields).drop("n").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    one = stage(best(first.select("query_id", "r")), "lexical-first")
    reached = first.join(one.filter(F.col("rank") == k).select("query_id", F.col("words").alias("w")), "query_id", "left")
    needed = reached.select("query_id", "r", F.least("m", F.coalesce(F.col("m") - F.col("w") + 1, F.col("m"))).alias("needed"))
    again = stage(needed.filter("needed > r").select("query_id", F.col("needed").alias("r")), "lexical-again")
    return one.join(again, "query_id", "left_anti").unionByName(best(again))


def rules(sort: list[Column] | None = None) -> list[Column]:
    """The ranking rules in order; a declared sort stands before exactness."""
    c = F.col
    return [c("words").desc(), c("typos").asc(), c("proximity").asc(), c("attribute").asc(), *(sort or []), c("exact").desc(), c("id").asc()]
