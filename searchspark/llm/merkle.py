"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of sentences.

Only DataFrame functions. A text splits at empty lines into sections, at line feeds into
paragraphs, and at stops, or after 24 characters, into pieces (LEAF); nothing is left out. A leaf's
node is the SHA-256 of its piece; a paragraph's, a section's and the root's are those of the nodes
below. So equal roots mean equal texts, and where roots differ, the sections and then paragraphs
that differ locate the edits.

A fingerprint is ``root|section:paragraph,paragraph;section:...|leaf,leaf,...`` with nodes below the
root cut to NODE hex digits. Of the leaves it holds the SKETCH smallest different nodes; from the
leaves of two fingerprints follows how much of two texts is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchspark.llm.keys import keyed

LEAF = r"[^.!?]{0,23}[.!?]|[^.!?]{1,24}"
NODE = 8
SKETCH = 128
#: Ranges of doc_id per shuffle partition, and at most so many ranges (their bounds are collected).
RANGES_PER_PARTITION, MOST_RANGES = 4, 20_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def leaves(text: Column) -> Column:
    """Nodes of the leaves, by section and paragraph."""
    of = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), of))


def _node(below: Column) -> Column:
    return F.sha2(F.array_join(below, ","), 256)


def tree(found: Column) -> Column:
    """Sections of the tree over leaves(): array of (node, paragraphs) with whole nodes."""
    section = lambda ps: F.struct(_node(ps).alias("node"), ps.alias("paragraphs"))
    return F.transform(found, lambda s: _let(F.transform(s, _node), section))


def sketch(found: Column) -> Column:
    """The smallest nodes of the leaves, as one string."""
    short = F.transform(F.flatten(F.flatten(found)), lambda x: F.substring(x, 1, NODE))
    return F.array_join(F.slice(F.array_sort(F.array_distinct(short)), 1, SKETCH), ",")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty."""
    short = lambda h: F.substring(h, 1, NODE)
    one = lambda s: F.concat(short(s["node"]), F.lit(":"), F.array_join(F.transform(s["paragraphs"], short), ","))
    upper = lambda t: F.concat(_node(F.transform(t, lambda s: s["node"])), F.lit("|"), F.array_join(F.transform(t, one), ";"))
    whole = lambda found: F.concat(_let(tree(found), upper), F.lit("|"), sketch(found))
    return _let(leaves(F.coalesce(text, F.lit(""))), whole)


def edit_places(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: ``section:paragraph`` from 0, joined by commas. Only sections
    whose nodes differ are opened; a place that only one has counts."""
    listed = lambda f: F.split(F.element_at(F.split(f, r"\|"), 2), ";")
    below = lambda x: F.split(F.substring_index(F.coalesce(x, F.lit("")), ":", -1), ",")
    inside = lambda z, i: F.transform(
        F.arrays_zip(below(z["x"]).alias("x"), below(z["y"]).alias("y")),
        lambda p, j: F.when(~p["x"].eqNullSafe(p["y"]), F.concat_ws(":", i, j)),
    )
    zipped = F.arrays_zip(listed(a).alias("x"), listed(b).alias("y"))
    places = F.transform(zipped, lambda z, i: F.when(z["x"].eqNullSafe(z["y"]), F.array().cast("array<string>")).otherwise(inside(z, i)))
    return F.array_join(F.flatten(places), ",")


def likeness(a: Column, b: Column) -> Column:
    """Twice the common share over the sum of shares (0 to 1), from the leaves of two fingerprints.

    The SKETCH smallest nodes of both together are a sample of all leaves, and all of them for short
    texts; of j of them being in both, 2 j / (1 + j) is the share that the texts have in common.
    """
    parts = lambda f: F.split(F.substring_index(f, "|", -1), ",")
    sample = F.slice(F.array_sort(F.array_union(parts(a), parts(b))), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(sample, parts(a)), parts(b)))
    return 2.0 * both / (F.size(sample) + both)


def locate_edits(a: DataFrame, b: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs in which two versions of the documents differ: key, section, paragraph (from 0).

    Only sections whose nodes differ are opened. Versions are joined by key, null being a key like
    others; of rows with one key the n-th, by text, is compared with the n-th. A document or place
    that only one version has counts as a difference.
    """
    turn = Window.partitionBy(key).orderBy(text)

    def nodes(df: DataFrame, side: str) -> DataFrame:
        numbered = df.select(key, text).withColumn("_n", F.row_number().over(turn))
        s = numbered.select(key, "_n", F.posexplode(tree(leaves(F.coalesce(F.col(text), F.lit(""))))).alias("section", "s"))
        return s.select(
            F.col(key).alias(f"{side}_key"), F.col("_n").alias(f"{side}_n"), F.col("section").alias(f"{side}_section"),
            F.col("s.node").alias(f"{side}_node"), F.col("s.paragraphs").alias(f"{side}_ps"),
        )

    same = F.col("a_key").eqNullSafe(F.col("b_key")) & (F.col("a_n") == F.col("b_n")) & (F.col("a_section") == F.col("b_section"))
    differ = nodes(a, "a").join(nodes(b, "b"), same, "full").filter(~F.col("a_node").eqNullSafe(F.col("b_node")))
    zipped = differ.select(F.coalesce("a_key", "b_key").alias(key), F.coalesce("a_section", "b_section").alias("section"), F.posexplode(F.arrays_zip(
        F.coalesce("a_ps", F.array().cast("array<string>")).alias("x"), F.coalesce("b_ps", F.array().cast("array<string>")).alias("y")
    )).alias("paragraph", "p"))
    return zipped.filter(~F.col("p.x").eqNullSafe(F.col("p.y"))).select(key, "section", "paragraph")


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text and next_fingerprint to _k, doc_id, text, fingerprint: those of the document
    with the next key; after the last comes the first. Keys are different.

    Keys are dealt into ranges of about equal size, and the first row of a range is also sent to
    the range before, so a window over each range sees every neighbour.
    """
    spark = docs.sparkSession
    doubled = docs.withColumn("_d", F.col("_k").cast("double"))
    n = min(MOST_RANGES, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = F.percentile_approx("_k", [i / n for i in range(1, n)] or [0.5], 20 * n)
    low, at = doubled.agg(F.min("_d"), cuts).first()
    bounds = sorted({float(b) for b in at or []} - {low})
    splits = [-float("inf"), *bounds, float("inf")] if bounds else [-float("inf"), 0.0, float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="_d", outputCol="_b").transform(doubled)
    copy = lambda b, wrap, ghost: F.struct(
        b.cast("int").alias("b"), F.lit(wrap).alias("wrap"), F.lit(ghost).alias("ghost")
    )
    last = dealt.agg(F.max("_b")).first()[0] if not bounds else float(len(bounds))
    copies = [
        F.array(copy(F.col("_b"), 0, False)),
        F.when(F.col("_d").isin(bounds), F.array(copy(F.col("_b") - 1, 0, True))) if bounds else None,
        F.when(F.col("_d") == F.lit(low), F.array(copy(F.lit(last), 1, True))),
    ]
    empty = F.array().cast("array<struct<b:int,wrap:int,ghost:boolean>>")
    places = F.concat(*(F.coalesce(c, empty) for c in copies if c is not None))
    placed = dealt.withColumn("_p", F.explode(places)).select("doc_id", "text", "fingerprint", "_k", "_p.*")
    order = Window.partitionBy("b").orderBy("wrap", "_k")
    following = F.lead(F.struct("text", "fingerprint")).over(order)
    out = placed.withColumn("_next", following).filter(~F.col("ghost"))
    return out.select(
        "doc_id", "text", "fingerprint", F.col("_next.text").alias("next_text"),
        F.col("_next.fingerprint").alias("next_fingerprint"),
    )


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, how alike they are, and where the
    edited text differs (edit_places).

    The edited text ends with the beginning of the next document in place of its own last quarter.
    Null texts are empty; two empty texts are alike (1), an empty one and another are not (0); a
    single document follows itself; repeated rows follow each other; an empty table gives no rows.
    """
    own = keyed(docs.select("doc_id", "text")).drop("_all")
    joined = with_next(own.withColumn("fingerprint", fingerprint(F.col("text"))))
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - q), F.substring(F.col("next_text"), F.lit(1), q))
    out = joined.withColumn("n_chars", n.cast("long")).withColumn("_edited", edited)
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("_edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        edit_places(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edit_places"),
    )


def _sql_leaves(text: str) -> str:
    return f"""list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda x: sha256(x))))"""


def _sql_fingerprint(found: str) -> str:
    paragraph = "sha256(array_to_string(p, ','))"
    section = f"sha256(array_to_string(list_transform(s, lambda p: {paragraph}), ','))"
    return f"""
  sha256(array_to_string(list_transform({found}, lambda s: {section}), ','))
  || '|' || array_to_string(list_transform({found}, lambda s: substr({section}, 1, {NODE})
      || ':' || array_to_string(list_transform(s, lambda p: substr({paragraph}, 1, {NODE})), ',')), ';')
  || '|' || array_to_string(list_sort(list_distinct(list_transform(flatten(flatten({found})), lambda x: substr(x, 1, {NODE}))))[1:{SKETCH}], ',')"""


def _sql_places(a: str, b: str) -> str:
    listed = lambda f: f"string_split(string_split({f}, '|')[2], ';')"
    below = lambda z: f"string_split(string_split(coalesce({z}, ''), ':')[-1], ',')"
    inside = f"""list_transform(list_zip({below('z[1]')}, {below('z[2]')}), lambda p, j:
      case when p[1] is distinct from p[2] then (i - 1) || ':' || (j - 1) end)"""
    return f"""array_to_string(flatten(list_transform(list_zip({listed(a)}, {listed(b)}), lambda z, i:
    case when z[1] is not distinct from z[2] then [] else {inside} end)), ',')"""


def _sql_likeness(a: str, b: str) -> str:
    part = lambda f: f"string_split(string_split({f}, '|')[3], ',')"
    sample = f"list_sort(list_distinct(list_concat({part(a)}, {part(b)})))[1:{SKETCH}]"
    both = f"len(list_intersect(list_intersect({sample}, {part(a)}), {part(b)}))"
    return f"2.0::double * {both} / (len({sample}) + {both})"


ORACLE_SQL = f"""
with own as (select doc_id, coalesce(text, '') as text from documents),
seq as (select doc_id, text, coalesce(lead(text) over (order by doc_id nulls last, text),
          first_value(text) over (order by doc_id nulls last, text)) as next_text from own),
ed as (select *, length(text) as n, left(text, length(text) - length(text) // 4)
         || left(next_text, length(text) // 4) as edited from seq),
lv as (select *, {_sql_leaves("text")} as lt, {_sql_leaves("edited")} as le, {_sql_leaves("next_text")} as ln from ed),
fp as (select doc_id, n, edited, {_sql_fingerprint("lt")} as f, {_sql_fingerprint("le")} as e,
         {_sql_fingerprint("ln")} as x from lv)
select doc_id, cast(n as bigint) as n_chars, sha256(edited) as edited_sha256, f as fingerprint,
  e as edited_fingerprint, {_sql_likeness("f", "e")} as near_edited, {_sql_likeness("f", "x")} as near_next,
  {_sql_places("f", "e")} as edit_places
from fp"""
