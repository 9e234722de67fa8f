"""Personal data: four fixed kinds, and identifiers found by bootstrapped contexts.

Only DataFrame functions. Base spans come from patterns and checks. They and all other values with
digits, each with the one or two words before it, form a graph of contexts and instances; base spans
are the seeds. Confidence runs from instances to contexts and back for a few rounds of grouped
aggregation, and values in contexts that end above a threshold become spans of the kind "id".
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchspark.plans.staging import stage

# Kinds in the order of the digest, and their patterns. Inner repeats are possessive;
# what follows each of them cannot begin with what it repeats, so matches are the same. A run of signs
# that an e-mail or an ip may begin with is tried once, at its start or where the match before ended:
# from any later place in it the same signs follow the run, so that fails where the first try fails.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: One or two words, each with up to four signs or spaces after it.
CONTEXT = r"(?:\p{L}++[^\p{L}\p{N}]{1,4}+){1,2}"
#: A token with a digit among its first 65 characters, so that none is searched for far ahead, and up to
#: eight further groups of digits after single spaces. Signs at the end are cut off; LEAST characters must be left.
VALUE = r"(?=[A-Za-z._%@(-]{0,64}+[0-9])[A-Za-z0-9][A-Za-z0-9._%+@()-]*+(?: [0-9(][A-Za-z0-9._%+@()-]*+){0,8}"
LEAST = 5
CANDIDATE = rf"(?<!\p{{L}}){CONTEXT}{VALUE}"
#: So many characters before a span can be its context.
REACH = 80
NEW_KIND = "id"
ROUNDS = 3
#: A context counts once it has seen so many different confirmed instances, and then by its share of them.
SUPPORT, THRESHOLD = 3, 0.5
#: New spans (8 bytes each, and 30 for a document) up to which they are sent to all tasks; more are
#: joined by a shuffle.
BROADCAST_SPANS = 200_000

SPAN = "array<struct<start:int,end:int,value:string,before:string>>"
#: Entries that a fold copies at once.
CHUNK = 512


def fold(entries: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """What step(at, entry) puts out for the entries in order; it returns a struct of at (the next
    state, a number) and out (an entry or null), nulls being left out; kind is the array's type.

    Entries are folded by chunks, so that growing the result costs no square of their number.
    """
    none = F.array().cast(kind)
    grown = lambda acc, r: F.struct(
        r["at"].alias("at"), F.when(r["out"].isNotNull(), F.concat(acc["out"], F.array(r["out"]))).otherwise(acc["out"]).alias("out")
    )
    one = lambda at, part: F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), lambda acc, x: grown(acc, step(acc["at"], x)))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(entries) - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(entries, i + 1, CHUNK))

    def joined(acc: Column, part: Column) -> Column:
        both = F.transform(F.array(one(acc["at"], part)), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))
        return F.element_at(both, 1)

    return F.aggregate(chunks, F.struct(start.alias("at"), none.alias("out")), joined, lambda acc: acc["out"])


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their code point positions (end exclusive), and the
    last characters before each since the match before.

    The same pattern splits the text; the lengths of gaps and matches add up to the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(REACH)).alias("before")))

    def step(at: Column, x: Column) -> Column:
        begin = at + x["gap"]["n"]
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value"), x["gap"]["before"].alias("before"))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull(), span).alias("out"))

    walked = fold(F.arrays_zip(gaps.alias("gap"), found.alias("m")), F.lit(0), step, SPAN)
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """The checksum of card numbers over the digits of value."""
    d = F.reverse(_digits(value))
    doubled = F.translate(d, "0123456789", "0246813579")
    pick = lambda acc, i: acc + F.substring(F.when(i % 2 == 1, d).otherwise(doubled), i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), pick) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Valid matches by kind."""
    n = lambda v: F.length(_digits(v))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    valid = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(rf"^(?:{part}\.){{3}}{part}$") ,
        "card": lambda v: F.when(n(v).between(16, 19), luhn(v)).otherwise(False),
        "phone": lambda v: n(v).between(8, 15),
    }
    kept = lambda k: F.filter(matches(text, PATTERNS[k]), lambda s: valid[k](s["value"]))
    return {k: kept(k) for k in PATTERNS}


def _named(words: Column) -> Column:
    """The name of a context: lower case, runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(words, r"\s+", " ")))


def annotate(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Staged: the columns to keep, _row, one array of base spans per kind, and candidates: context,
    value, start, end, seed. Seeds are base spans; the others overlap none."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), text.alias("_text"))
    out = out.withColumns({f"_{k}": c for k, c in base_spans(F.col("_text")).items()})
    spans = F.concat(*(F.col(f"_{k}") for k in PATTERNS))
    lead = lambda v: F.regexp_extract(v, f"^{CONTEXT}", 0)
    value = lambda x: F.regexp_replace(F.substring(x["value"], F.length(lead(x["value"])) + 1, F.length(x["value"])), "[^A-Za-z0-9]+$", "")
    other = lambda x: F.struct(
        _named(lead(x["value"])).alias("context"), value(x).alias("value"), (x["start"] + F.length(lead(x["value"]))).alias("start"),
        (x["start"] + F.length(lead(x["value"])) + F.length(value(x))).alias("end"), F.lit(False).alias("seed"),
    )
    seed = lambda x: F.struct(
        _named(F.regexp_extract(F.concat(F.lit(" "), x["before"]), rf"[^\p{{L}}]({CONTEXT})$", 1)).alias("context"), x["value"].alias("value"),
        x["start"].alias("start"), x["end"].alias("end"), F.lit(True).alias("seed"),
    )
    free = lambda c: (F.length(c["value"]) >= LEAST) & ~F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    out = out.withColumn("_found", F.transform(matches(F.col("_text"), CANDIDATE), other))
    both = F.concat(F.filter("_found", free), F.filter(F.transform(spans, seed), lambda c: c["context"] != ""))
    bare = {f"_{k}": F.transform(f"_{k}", lambda s: F.struct(s["start"], s["end"])) for k in PATTERNS}
    return stage(out.withColumn("_candidates", both).withColumns(bare).drop("_text", "_found"), "pii-annotated")


def contexts(annotated: DataFrame) -> DataFrame:
    """Accepted contexts: context, confidence. Edges are distinct pairs of context and instance."""
    c = annotated.select(F.explode("_candidates").alias("c")).select("c.context", "c.value", "c.seed")
    edges = stage(c.groupBy("context", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    trust = edges.groupBy("value").agg(F.max("seed").cast("double").alias("trust"))
    scored = None
    for _ in range(ROUNDS):
        believed = edges.join(trust, "value").groupBy("context").agg(
            F.sum("trust").alias("mass"), F.count(F.lit(1)).alias("n"),
            F.sum((F.col("trust") >= THRESHOLD).cast("int")).alias("support"),
        )
        share = F.when(F.col("support") >= SUPPORT, F.col("mass") / (F.col("n") + 1)).otherwise(0.0)
        scored = stage(believed.select("context", share.alias("confidence")), "pii-contexts")
        trust = stage(
            edges.join(scored, "context").groupBy("value").agg(
                F.max(F.greatest(F.col("seed").cast("double"), "confidence")).alias("trust")
            ), "pii-instances",
        )
    return scored.filter(F.col("confidence") >= THRESHOLD)


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, one array of spans per kind (_email, _ip, _card, _phone) and _id.

    Spans are structs of start and end in code points, ascending. Null and empty texts have none;
    repeated rows each get theirs; an empty table stays empty; other columns are not looked at.
    """
    annotated = annotate(docs, keep)
    accepted = contexts(annotated)
    new = (
        annotated.select("_row", F.explode("_candidates").alias("c"))
        .filter(~F.col("c.seed"))
        .select("_row", F.col("c.context").alias("context"), F.col("c.start").alias("start"), F.col("c.end").alias("end"))
        .join(accepted, "context", "left_semi")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_id"))
    )
    new = stage(new, "pii-new")
    if (new.agg(F.sum(F.size("_id"))).first()[0] or 0) <= BROADCAST_SPANS:
        new = F.broadcast(new)
    out = annotated.drop("_candidates").join(new, "_row", "left")
    return out.withColumn("_id", F.coalesce("_id", F.array().cast("array<struct<start:int,end:int>>"))).drop("_row")


def _listed(kinds: list[str]) -> Column:
    one = lambda k: F.transform(f"_{k}", lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    return F.array_join(F.concat(*(one(k) for k in kinds)), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, all spans as text."""
    found = find(docs, ["doc_id"])
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in (*PATTERNS, NEW_KIND)]
    return found.select(
        "doc_id", *counts, F.sha2(_listed([*PATTERNS]), 256).alias("base_sha256"),
        _listed([*PATTERNS, NEW_KIND]).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; n_chars follows where it exists.

    Overlapping spans are replaced together by the kind of the first. Null texts stay null.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all")
    found = find(docs.select(row, "text"), ["_all"])
    text = F.col("_all.text")
    kinds = (*PATTERNS, NEW_KIND)
    tagged = lambda k: F.transform(f"_{k}", lambda s: F.struct(s["start"], s["end"], F.lit(k).alias("kind")))
    spans = F.array_sort(F.concat(*(tagged(k) for k in kinds)))
    end = F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit(None).cast("string").alias("kind"))
    step = lambda at, s: F.struct(
        F.greatest(at, s["end"]).alias("at"),
        F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.coalesce(F.concat(F.lit("["), s["kind"], F.lit("]")), F.lit("")))).alias("out"),
    )
    redacted = F.array_join(fold(F.concat(spans, F.array(end)), F.lit(0), step, "array<string>"), "")
    any_span = reduce(lambda a, b: a | b, (F.size(f"_{k}") > 0 for k in kinds))
    out = found.select(
        F.col("_all").withField("text", F.when(any_span, redacted).otherwise(text)).alias("_all")
    )
    if "n_chars" in docs.columns:
        n = F.length("_all.text").cast(docs.schema["n_chars"].dataType)
        out = out.select(F.col("_all").withField("n_chars", n).alias("_all"))
    return out.select("_all.*")
