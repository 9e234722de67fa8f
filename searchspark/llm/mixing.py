"""Mixing sources to target weights: Sainte-Laguë quotas of equal blocks of words.

Only DataFrame functions. Tables of sources and of shards are small beside the documents; no step
gathers a source's documents in one task: they are dealt into shards first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchspark.llm.keys import keyed
from searchspark.plans.staging import stage

#: What counts as a word: a run without space, tab, line feed and their like.
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: The mix holds SHARE_NUM / SHARE_DEN of all words; no source is taken more than CAP times.
SHARE_NUM, SHARE_DEN, CAP = 3, 2, 2
BLOCK = 32
#: Documents of a shard, on average, while a source has no more than MOST_SHARDS shards; of larger
#: sources shards are larger, so that neither a source's shards nor a shard's documents are too many
#: for the window over them.
SHARD_DOCS, MOST_SHARDS = 2048, 65_536
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Adds target to one row per source (source, source_size): weights by rank of the name (null
    last), shared out up to CAP times the size, the excess going to the others by weight.

    With r = cap / weight ascending, the sources before some point are full and all others get
    the same amount per unit of weight; that amount is the one for the first source it leaves
    below its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), rank + 1).cast("long")
    cap = (F.col("source_size") * CAP).cast("double")
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    out = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("fill", cap / F.col("weight"))
    out = (
        out.withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.col("all_words") * SHARE_NUM / SHARE_DEN)
        .withColumn("rate", (F.col("total") - F.col("full")) / F.col("open_weight"))
    )
    level = F.min(F.when(F.col("fill") >= F.col("rate"), F.struct("fill", "rate"))).over(everything)["rate"]
    out = out.withColumn("level", level)
    return out.withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).select(
        "source", "source_size", "n_docs", "target"
    )


def sainte_lague(parties: DataFrame, within: list[str], votes: str, seats: str, order: list[Column]) -> DataFrame:
    """Adds quota: the given number of seats (equal on all rows of a group) by highest quotients
    votes / (2 k + 1).

    The seats every party surely has follow from the two divisors that bound the true one; only
    the few seats between are ranked by quotient.
    """
    group = Window.partitionBy(*within)
    n, total = F.count(F.lit(1)).over(group), F.sum(votes).over(group)
    rounded = lambda d: F.floor(F.col(votes) / d + 0.5).cast("long")
    sure = F.when(F.col("_t") <= 0, 0).when(F.col("_s") <= F.col("_n"), 0).otherwise(
        F.greatest(rounded(F.col("_t") / (F.col("_s") - F.col("_n") / 2)) - 1, F.lit(0))
    )
    most = F.when(F.col("_t") <= 0, 0).otherwise(rounded(F.col("_t") / (F.col("_s") + F.col("_n") / 2)) + 1)
    bounded = (
        parties.withColumn("_n", n).withColumn("_t", total).withColumn("_s", F.col(seats))
        .withColumn("_sure", sure.cast("long")).withColumn("_most", most.cast("long"))
        .withColumn("_open", F.col("_s") - F.sum("_sure").over(group))
    )
    ranked = bounded.withColumn(
        "_k", F.explode(F.when(F.col("_most") > F.col("_sure"), F.sequence("_sure", F.col("_most") - 1)).otherwise(F.array(F.lit(-1).cast("long"))))
    ).withColumn(
        "_r", F.row_number().over(group.orderBy(F.when(F.col("_k") < 0, -1.0).otherwise(F.col(votes) / (2 * F.col("_k") + 1)).desc(), *order))
    )
    won = F.sum(F.when((F.col("_k") >= 0) & (F.col("_r") <= F.col("_open")), 1).otherwise(0))
    keys = [c for c in parties.columns]
    return ranked.groupBy(*keys, "_sure").agg(won.alias("_won")).select(
        *keys, (F.col("_sure") + F.col("_won")).cast("long").alias("quota")
    )


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes.

    Documents of a shard stand in the order of a seeded hash and are cut into blocks of BLOCK
    words; the shard's quota takes blocks from the front, and begins again from the front where
    the quota is larger than the shard. So a document gives at most CAP times its words, and
    repeated rows share one place in the order but are counted and taken singly, in the order of
    their ids. Null texts have no words, null sources are one source, an empty table gives no
    rows, further columns are ignored.
    """
    sized = stage(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
        .withColumn("_row", F.monotonically_increasing_id()),
        "mix-sizes",
    )
    sources = stage(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
        .withColumn("_blocks", F.round(F.sum("target").over(Window.partitionBy()) / BLOCK).cast("long")),
        "mix-targets",
    )
    by_source = sainte_lague(sources, [], "target", "_blocks", [F.col("source").asc_nulls_last()]).withColumn(
        "n_shards", F.least(F.ceil(F.col("n_docs") / SHARD_DOCS), F.lit(MOST_SHARDS))
    )
    by_source = stage(by_source.drop("_blocks").withColumnRenamed("quota", "source_quota"), "mix-quotas")
    same = sized["source"].eqNullSafe(by_source["source"])
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = (
        sized.join(by_source, same, "left").drop(by_source["source"])
        .withColumn("_h", hashed)
        .withColumn("_shard", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % F.col("n_shards"))
    )
    shards = dealt.groupBy("source", "_shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    quotas = stage(sainte_lague(shards, ["source"], "shard_size", "source_quota", [F.col("_shard")]), "mix-shards")
    quotas = quotas.select(F.col("source").alias("_s"), F.col("_shard").alias("_sh"), "shard_size", "quota")
    place = Window.partitionBy("source", "_shard").orderBy("_h", "doc_id", "size", "_row")
    start = F.coalesce(F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("_start", start).join(
        quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_sh")), "left"
    )
    words = F.least(F.col("quota") * BLOCK, F.col("shard_size") * CAP)
    passes = [
        F.greatest(F.lit(0), F.least(F.col("size"), words - k * F.col("shard_size") - F.col("_start")))
        for k in range(CAP)
    ]
    taken = sum(passes[1:], passes[0])
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as it is taken, the last
    time up to the end of its last taken word where the quota ends within it; n_chars follows the
    text.

    White space stays as it is. Null texts and those without words have nothing to take and are not
    in a mix of words. Repeated rows are taken singly; null sources are one source, null ids ids like
    others; an empty table gives no rows; further columns go along.
    """
    rows = keyed(docs)
    chosen = mix(rows.select(F.col("_k").alias("doc_id"), "text", F.col("_all.source").alias("source")), seed)
    chosen = chosen.filter("taken > 0").select(F.col("doc_id").alias("_k"), "size", "taken")
    parts = [F.least(F.col("size"), F.greatest(F.lit(0), F.col("taken") - k * F.col("size"))) for k in range(CAP)]
    copies = rows.select("_k", "_all").join(chosen, "_k").withColumn("_w", F.explode(F.filter(F.array(*parts), lambda w: w > 0)))
    spaced = F.regexp_extract_all("_all.text", F.lit(SPACED_WORD), F.lit(0))
    beginning = F.array_join(F.slice(spaced, F.lit(1), F.col("_w").cast("int")), "")
    text = F.when(F.col("_w") < F.col("size"), beginning).otherwise(F.col("_all.text"))
    out = copies.select(F.col("_all").withField("text", text).alias("_all"))
    if "n_chars" in docs.columns:
        n = F.length("_all.text").cast(docs.schema["n_chars"].dataType)
        out = out.select(F.col("_all").withField("n_chars", n).alias("_all"))
    return out.select("_all.*")


ORACLE_SQL = f"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size,
    md5(concat_ws(':', '{SEED}', coalesce(cast(doc_id as varchar), ''))) as h from documents),
src as (select source, sum(size) as source_size, count(*) as n_docs from sized group by source),
wt as (select *, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)] as weight from src),
cp as (select *, cast(source_size * {CAP} as double) as cap, cast(source_size * {CAP} as double) / weight as fill from wt),
lv as (select *, (cast(sum(source_size) over () * {SHARE_NUM} as double) / {SHARE_DEN}
    - coalesce(sum(cap) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (order by fill, source nulls last rows between current row and unbounded following) as rate from cp),
tg as (select source, source_size, n_docs, least(cap, (select min((fill, rate))[2] from lv where fill >= rate) * weight) as target from lv),
al as (select *, cast(round(sum(target) over () / {BLOCK}) as bigint) as seats from tg),
sq as (select source, row_number() over (order by target / (2 * k + 1) desc, source nulls last) as r, seats
    from (select source, target, seats, unnest(range(0, seats)) as k from al where target > 0)),
so as (select al.*, least(cast(ceil(n_docs / {SHARD_DOCS}) as bigint), {MOST_SHARDS}) as n_shards,
    (select count(*) from sq where sq.source is not distinct from al.source and r <= sq.seats) as source_quota from al),
dealt as (select s.*, source_size, target, source_quota, cast('0x' || substr(h, 1, 8) as bigint) % n_shards as shard
    from sized s join so on s.source is not distinct from so.source),
sh as (select source, shard, source_quota, sum(size) as shard_size from dealt group by all),
hq as (select source, shard, row_number() over (partition by source order by shard_size / (2 * k + 1) desc, shard) as r, source_quota
    from (select *, unnest(range(0, source_quota)) as k from sh where shard_size > 0)),
q as (select sh.*, (select count(*) from hq where hq.source is not distinct from sh.source and hq.shard = sh.shard and r <= hq.source_quota) as quota from sh),
pl as (select d.doc_id, d.size, d.source_size, d.target, shard_size, least(quota * {BLOCK}, shard_size * {CAP}) as words,
    coalesce(sum(d.size) over (partition by d.source, d.shard order by h, doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as begun
    from dealt d join q on d.source is not distinct from q.source and d.shard = q.shard)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
  cast(greatest(0, least(size, words - begun)) + greatest(0, least(size, words - shard_size - begun)) as bigint) as taken from pl"""
