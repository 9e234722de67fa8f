"""Jaccard join of documents by their n-grams of words, on prefix trees.

The work runs on distinct sets of shingle hashes (nodes); equal sets are one node.

1. Shingles that many documents share are counted, and give classes of frequency. Sets are ordered
   globally: rare classes first, then by hash.
2. Sets that are alike share at least as many shingles among their first ones as their sizes
   demand, so only the first shingles of each set are compared, one of those that the same nodes
   have, and only nodes that repeat enough of them go on.
3. Within the nodes that share a shingle, sizes and parity bitmaps rule out pairs without error:
   bitmaps differ in no more bits than sets in shingles. Each node keeps its nearest neighbour.
4. Neighbours are verified: the sets around one node form a trie, which is walked with that
   node's set. Overlaps are shared along common beginnings, and branches end where the rest
   cannot reach the overlap needed.
5. Links give components. Each node looks once more for its nearest neighbour, in another
   component; then all close pairs that still lie in different components are verified, so no
   link between components is lost. Tokens dealt into blocks take part with all their nodes, as
   nodes of two blocks have not met before; of other tokens, nodes without a close one are done.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchspark.llm.components import components
from searchspark.llm.hashing import mix, shingles
from searchspark.llm.keys import keyed
from searchspark.llm.sketch import found_at, frequent
from searchspark.plans.staging import stage

#: Of a set's size, so much more than needed is compared, to be able to ask for that many agreements.
EXTRA = 20
#: Nodes compared with each other at once; tokens with more nodes are dealt into blocks.
BLOCK = 4096
ROWS_PER_BUCKET, PAIRS_PER_BUCKET = 20_000, 500
#: Members of one trie.
TRIE = 256
#: Nodes (16 bytes each) up to which their list is sent to the texts; beyond, texts are shuffled to it.
BROADCAST_NODES = 500_000
#: Part of a node that is summed over the rows of a token: 2**32 rows fit into the sum.
LOW_BITS = (1 << 31) - 1
STEP = 64


@dataclass(frozen=True)
class Rule:
    """Shingles of n words; linked when den * intersection >= num * union."""

    n: int = 5
    num: int = 80
    den: int = 100

    def least_own(self, size: int) -> int:
        """Overlap that any link of a set of this size has."""
        return -(-self.num * size // self.den)

    def needed(self, a: int, b: int) -> int:
        """Overlap that a link between sets of these sizes has."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def compared(self, size: int) -> int:
        """How many of a set's first shingles are compared."""
        return min(size, size - self.least_own(size) + 1 + size // EXTRA)

    def agreements(self, size: int) -> int:
        """How many of them every set linked with one of this size shares at least."""
        return 1 + self.least_own(size) // EXTRA


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens' counts over slots; as many slots as keep unlike sets apart."""
    bits = 512
    while bits < len(tokens):
        bits *= 2
    parity = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


#: Shingles shared by one in so many documents, and by LEAST_OFTEN at least, have a class of their own.
#: With some hundred shingles a document, they are a million at most, whatever the input.
ONE_IN, LEAST_OFTEN = 2_000, 16
Classes = tuple[np.ndarray, np.ndarray]


def frequency_classes(rows: DataFrame, rule: Rule) -> Classes:
    """Frequent shingles, ascending, and their classes (powers of two of their counts)."""
    n = rule.n
    known, times = frequent(rows.select("text"), lambda b: (shingles(t, n) for t in b["text"]), max(LEAST_OFTEN, rows.count() // ONE_IN))
    return known, np.log2(times + 1).astype(np.uint8)


def ordered(text: str, rule: Rule, classes: Classes) -> np.ndarray:
    """The text's shingles, rare ones first."""
    s = shingles(text, rule.n)
    there, at = found_at(classes[0], s)
    return s[np.argsort(np.where(there, classes[1][at], 0), kind="stable")] if there.any() else s


def node_of(tokens: np.ndarray) -> int:
    """Id of a set: a 64-bit hash of all its shingles, whatever their order."""
    both = np.array([mix(tokens).sum(dtype=np.uint64), np.bitwise_xor.reduce(tokens)])
    return int(mix(both[:1] * np.uint64(3) + mix(both[1:] + np.uint64(len(tokens))))[0].astype(np.int64))


def members(rows_: DataFrame, rule: Rule, classes: Broadcast) -> DataFrame:
    """Staged, one row per document: _k, n, node, and for the first of its kind in a task the tokens
    to compare, the frequent ones apart, and the bitmap. Documents without words have no node."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            out = []
            for t in b["text"]:
                s = ordered(t, rule, classes.value)
                node = node_of(s) if len(s) else None
                new = node is not None and node not in seen
                seen.add(node)
                rare = often = None
                if new:
                    compared = s[: rule.compared(len(s))]
                    hot = found_at(classes.value[0], compared)[0]
                    rare, often = compared[~hot].view(np.int64), compared[hot].view(np.int64)
                out.append((len(s), node, rare, often, bitmap(s) if new else None))
            frame = pd.DataFrame(out, columns=["n", "node", "tokens", "often", "bits"])
            frame["node"] = pd.array([r[1] for r in out], dtype="Int64")
            frame.insert(0, "_k", b["_k"].to_numpy())
            yield frame

    kind = "_k long, n long, node long, tokens array<long>, often array<long>, bits binary"
    return stage(rows_.select("_k", "text").mapInPandas(rows, kind), "jaccard-members")


def _shared_tokens(member: DataFrame) -> DataFrame:
    """token, node, together (rows with the token), weight, for tokens that different nodes have.

    Of tokens that the same nodes have (near copies share most of theirs) the smallest stands for
    all, weight of them, since each would bring the same nodes together. Same nodes are told by the
    count, the least, a sum and the exclusive or of the nodes.

    Rows of a token that is not frequent are shuffled once, its figures are put beside them there, and
    those of tokens with one node end; what stands for others is joined with the rest. Frequent tokens are summed up before the
    shuffle and joined with their rows, which that join splits."""
    low = F.col("node").bitwiseAND(F.lit(LOW_BITS))
    figures = {"lo": F.min("node"), "hi": F.max("node"), "together": F.count(F.lit(1)), "mark": F.bit_xor("node"), "total": F.sum(low)}
    of = lambda c: member.filter("bits is not null").select("node", F.explode(c).alias("token"))
    same = ("lo", "together", "mark", "total")

    def standing(summed: DataFrame) -> DataFrame:
        one_of_each = summed.groupBy(*same).agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("weight"))
        return one_of_each.select("token", "weight")

    here = Window.partitionBy("token")
    placed = of("tokens").select("token", "node", *(f.over(here).alias(c) for c, f in figures.items()))
    # Staged, as both sides of the join below would each shuffle all tokens; few have two nodes.
    rare = stage(placed.filter("lo <> hi").drop("hi"), "jaccard-placed")
    # The row of its least node has a token's figures; a node has a token once in a task.
    once = rare.filter("node = lo").select("token", *same).distinct()
    rare = rare.select("token", "node", "together").join(standing(once), "token")
    often = of("often")
    summed = often.groupBy("token").agg(*(f.alias(c) for c, f in figures.items())).filter("lo <> hi")
    hot = often.join(standing(summed).join(summed.select("token", "together"), "token"), "token")
    columns = ("token", "node", "together", "weight")
    return stage(rare.select(*columns).unionByName(hot.select(*columns)), "jaccard-shared")


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of more slots as they would be with words * 64 slots."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def close_pairs(token: np.ndarray, node: np.ndarray, n: np.ndarray, bits: list[bytes], rule: Rule, comp: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j) with the same token that sizes and bitmaps do not rule out, and in how
    many bits they differ. Rows must be sorted by token and node. With comp, only pairs of
    different components."""
    words = np.array([len(b) // 8 for b in bits])
    folded = {}
    for w in np.unique(words).tolist():
        matrix = np.zeros((len(bits), w), np.uint64)
        for wide in np.unique(words[words >= w]).tolist():
            at = np.flatnonzero(words == wide)
            matrix[at] = _fold(np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), wide), w)
        folded[w] = matrix
    i, d = np.arange(len(token)), 0
    while len(i):
        d += 1
        i = i[i + d < len(token)]
        i = i[token[i] == token[i + d]]
        j = i + d
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (rule.den * small >= rule.num * large) & (node[i] != node[j])
        if comp is not None:
            ok &= comp[i] != comp[j]
        a, b = i[ok], j[ok]
        least = np.minimum(words[a], words[b])
        for w in np.unique(least).tolist():
            x, y = a[least == w], b[least == w]
            differ = np.bitwise_count(folded[w][x] ^ folded[w][y]).sum(axis=1, dtype=np.int64)
            both = n[x] + n[y]
            allowed = both - 2 * -(-rule.num * both // (rule.num + rule.den))
            good = differ <= allowed
            yield x[good], y[good], differ[good]


def _dealt(rows: DataFrame, buckets: int, every: bool) -> DataFrame:
    """Adds key: rows of a token come together, in blocks where they are many. Without every, each
    block meets only itself and the first; with it, all others."""
    blocks = F.ceil(F.col("together") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks)
    last = blocks - 1
    if every:
        meets = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.struct(F.least(k, own).alias("x"), F.greatest(k, own).alias("y")))
    else:
        to = F.when(own == 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array(own))
        meets = F.transform(to, lambda k: F.struct(F.lit(0).cast("long").alias("x"), k.alias("y")))
    placed = rows.withColumn("_m", F.explode(meets))
    return placed.withColumn("key", F.when(blocks == 1, F.pmod("token", F.lit(buckets))).otherwise(F.xxhash64("token", "_m.x", "_m.y"))).drop("_m", "together")


def _columns(group: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
    group = group.drop_duplicates(["token", "node"]).sort_values(["token", "node"])
    return group, (group["token"].to_numpy(), group["node"].to_numpy(), group["n"].to_numpy(), [bytes(b) for b in group["bits"]])


def neighbours(rows: DataFrame, rule: Rule, buckets: int, across: bool = False) -> DataFrame:
    """node, other: each node's nearest one with a smaller id in each of its groups; other is null
    where a node is only the smaller id of a close pair. With across, of another component (comp)."""

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        group, columns = _columns(group)
        node = columns[1]
        comp = group["comp"].to_numpy() if across else None
        best, other, near = np.full(len(node), 1 << 30), np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        for i, j, differ in close_pairs(*columns, rule, comp):
            better = differ < best[j]
            best[j[better]], other[j[better]] = differ[better], node[i[better]]
            near[i] = True
        found = best < 1 << 30
        alone = near & ~found
        out = pd.DataFrame({"node": np.concatenate([node[found], node[alone]]), "other": pd.array(np.concatenate([other[found], node[alone]]), dtype="Int64")})
        out.loc[found.sum() :, "other"] = pd.NA
        return out.drop_duplicates()

    dealt = _dealt(rows, buckets, every=False).select("key", "token", "node", "n", "bits", *(["comp"] if across else []))
    return dealt.groupBy("key").applyInPandas(nearest, "node long, other long").distinct()


def cross_pairs(rows: DataFrame, rule: Rule, buckets: int) -> DataFrame:
    """node, other: all close pairs of different components."""

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        group, columns = _columns(group)
        node, comp = columns[1], group["comp"].to_numpy()
        parts = [(node[j], node[i]) for i, j, _ in close_pairs(*columns, rule, comp)]
        a, b = (np.concatenate([p[k] for p in parts] or [np.empty(0, np.int64)]) for k in (0, 1))
        return pd.DataFrame({"node": a, "other": b}).drop_duplicates()

    dealt = _dealt(rows, buckets, every=True).select("key", "token", "node", "n", "bits", "comp")
    return dealt.groupBy("key").applyInPandas(pairs, "node long, other long").distinct()


def trie_links(probe: np.ndarray, sets: list[np.ndarray], rule: Rule) -> list[int]:
    """Places of the sets linked with probe.

    Sets in the order of their tokens are the leaves of a trie; what two neighbours share is the
    path above both. Along a path the overlap with probe is counted once; where the overlap so far
    and the tokens left cannot reach what is needed, the branch is left, and neighbours that share
    the path up to there are judged from that point.
    """
    inside = np.sort(probe)
    order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
    linked: list[int] = []
    marks: list[tuple[int, int]] = [(0, 0)]
    previous = np.empty(0, np.uint64)
    for k in order:
        s = sets[k]
        shorter = min(len(s), len(previous))
        unlike = np.flatnonzero(s[:shorter] != previous[:shorter])
        shared = int(unlike[0]) if len(unlike) else shorter
        while marks[-1][0] > shared:
            marks.pop()
        depth, overlap = marks[-1]
        need = rule.needed(len(probe), len(s))
        while depth < len(s) and overlap + min(len(s) - depth, len(probe) - overlap) >= need:
            part = s[depth : depth + STEP]
            at = np.minimum(np.searchsorted(inside, part), len(inside) - 1)
            overlap += int((inside[at] == part).sum())
            depth += len(part)
            marks.append((depth, overlap))
        if depth == len(s) and overlap >= need:
            linked.append(k)
        previous = s
    return linked


def sets_of(texts: DataFrame, member: DataFrame, nodes: DataFrame, rule: Rule, classes: Broadcast) -> DataFrame:
    """Staged: node, tokens (frequent ones first, so that tries share more) of the given nodes.

    Few texts are asked for out of many, so these stay where they are while the list of nodes is short."""
    source = stage(member.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("_k").alias("_k")), "jaccard-source")
    if source.count() <= BROADCAST_NODES:
        source = F.broadcast(source)
    chosen = texts.select("_k", "text").join(source, "_k").select("node", "text")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [ordered(t, rule, classes.value) for t in b["text"]]
            own = [(k, s[::-1].tobytes()) for k, s in zip(b["node"], sets, strict=True) if len(s) and node_of(s) == k]
            yield pd.DataFrame(own, columns=["node", "tokens"])

    return stage(chosen.mapInPandas(rows, "node long, tokens binary"), "jaccard-sets")


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Staged: a, b, the pairs (node, other) that are linked. Each trie holds the nodes that name
    the same other, up to TRIE of them."""
    pairs = stage(pairs.filter("other is not null").distinct(), "jaccard-pairs")
    count = pairs.count()
    buckets = max(1, math.ceil(count / PAIRS_PER_BUCKET))
    sizes = pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / TRIE).alias("tries"))
    salted = pairs.join(sizes, "other").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("tries")))
    with_self = salted.select("other", "salt", "node").unionByName(
        sizes.select("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tries") - 1)).alias("salt"), F.col("other").alias("node"))
    )
    rows = with_self.join(sets, "node").withColumn("key", F.pmod(F.xxhash64("other", "salt"), F.lit(buckets)))

    def links(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (other, _), own in group.drop_duplicates(["other", "salt", "node"]).groupby(["other", "salt"]):
            names, sets_ = own["node"].tolist(), [np.frombuffer(t, np.uint64) for t in own["tokens"]]
            if other in names:
                probe = sets_.pop(at := names.index(other))
                names.pop(at)
                out += [(names[k], other) for k in trie_links(probe, sets_, rule)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return stage(rows.groupBy("key").applyInPandas(links, "a long, b long"), "jaccard-links")


def _unmet(shared: DataFrame, kept: DataFrame, inside: DataFrame) -> DataFrame:
    """Rows of shared whose pairs may not all be known: those of nodes with a close one, and, of
    tokens dealt into blocks, those of all kept nodes."""
    hot = F.col("together") > BLOCK
    met = shared.filter(~hot).join(inside, "node", "left_semi")
    return met.unionByName(shared.filter(hot).join(kept, "node", "left_semi"))


def _open(rows: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (token, node, together) with comp, n and bits, of tokens that nodes of different
    components share. Bitmaps join last, so that only these rows carry them."""
    placed = rows.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return placed.join(mixed.select("token"), "token", "left_semi").join(nodes, "node")


def cluster(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id and _component (the same for rows of one component).

    component_id is the smallest doc_id of the component. Null and empty texts, and those of white
    space alone, have no shingles and stand alone; texts with fewer words than a shingle have one.
    Repeated rows have equal sets and so are one component; null ids take part, and a component of
    null ids only has the id null. An empty table gives no rows; other columns are ignored.
    """
    rows = keyed(docs.select("doc_id", "text")).drop("_all")
    found = clustered(rows, rule)
    named = found.join(rows.select("_k", "doc_id"), "_k")
    ids = named.filter("_component is not null").groupBy("_component").agg(F.min("doc_id").alias("component_id"))
    out = named.join(ids, "_component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "_component")


def clustered(rows: DataFrame, rule: Rule) -> DataFrame:
    """_k, n, _component of rows (_k, text) with different _k and no null texts."""
    spark: SparkSession = rows.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(rows, rule))
    member = members(rows, rule, classes)
    shared = _shared_tokens(member)
    size = F.col("n")
    enough = 1 + F.floor(F.ceil(size * rule.num / rule.den) / EXTRA)
    repeats = shared.groupBy("node").agg(F.sum("weight").alias("repeats"))
    nodes = member.filter("bits is not null").groupBy("node").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    kept = stage(nodes.join(repeats, "node").filter(F.col("repeats") >= enough).select("node", "n", "bits"), "jaccard-kept")
    buckets = max(1, math.ceil(shared.count() / ROWS_PER_BUCKET))
    # A merge join leaves the rows of a node together, so that its repeated bitmap is compressed in the next shuffle.
    near = stage(neighbours(shared.join(kept.hint("merge"), "node"), rule, buckets), "jaccard-near")
    inside = near.select("node").unionByName(near.select(F.col("other").alias("node"))).distinct()
    sets = sets_of(rows, member, inside, rule, classes)
    tested, links = near, verified(near, sets, rule)
    inner = stage(_unmet(shared, kept, inside), "jaccard-inner")

    def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """sets, and those of nodes that only these pairs have."""
        named = pairs.select("node").unionByName(pairs.select(F.col("other").alias("node"))).distinct()
        new = stage(named.join(sets, "node", "left_anti"), "jaccard-new")
        return sets if new.isEmpty() else sets.unionByName(sets_of(rows, member, new, rule, classes))

    rest = neighbours(_open(inner, components(links), kept), rule, buckets, across=True).filter("other is not null")
    rest = stage(rest.join(tested, ["node", "other"], "left_anti"), "jaccard-near")
    sets = with_sets(rest, sets)
    tested, links = tested.unionByName(rest), links.unionByName(verified(rest, sets, rule))
    rest = cross_pairs(_open(inner, components(links), kept), rule, buckets)
    rest = stage(rest.join(tested, ["node", "other"], "left_anti"), "jaccard-across")
    links = links.unionByName(verified(rest, with_sets(rest, sets), rule))
    roots = stage(components(links), "jaccard-roots")
    rooted = member.select("_k", "n", "node").join(roots, "node", "left")
    return rooted.select("_k", "n", F.coalesce("root", "node").alias("_component"))


def deduplicate(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """docs with one row of each component: that of the smallest id (null last, then by text).

    Rows without words stay. Repeated rows are copies of each other, so one of them stays.
    """
    rows = keyed(docs)
    found = clustered(rows.drop("_all"), rule or Rule())
    first = found.filter("_component is not null").groupBy("_component").agg(F.min("_k").alias("_k"))
    alone = found.filter("_component is null").select("_k")
    return rows.join(first.select("_k").unionByName(alone), "_k", "left_semi").select("_all.*")
