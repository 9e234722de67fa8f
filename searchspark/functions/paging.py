"""Page sizes, page tokens, effective mode and weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the semantic part by the number of words in a query.
FEW, SOME, MANY = 0.2, 0.45, 0.7


def page_size(size: Column, default: int = 20, maximum: int = 100) -> Column:
    """The size asked for; default where it is not positive, at most maximum."""
    return F.when(F.coalesce(size, F.lit(0)) <= 0, default).when(size > maximum, maximum).otherwise(size)


def encode_offset(offset: Column) -> Column:
    """The decimal offset in URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(offset.cast("string"), "UTF-8")), "+/", "-_"), F.lit("="))


def decode_offset(token: Column) -> Column:
    """The offset of a token; 0 for a bad or missing one, never negative."""
    t = F.translate(F.coalesce(token, F.lit("")), "-_", "+/")
    padded = F.rpad(t, (F.ceil(F.length(t) / 4) * 4).cast("int"), F.lit("="))
    number = F.try_to_binary(padded, F.lit("base64")).cast("string").try_cast("int")
    return F.greatest(F.lit(0), F.coalesce(number, F.lit(0)))


def next_token(offset: Column, hits: Column, total: Column) -> Column:
    """Token of the next page; empty on the last."""
    return F.when(offset + hits < total, encode_offset(offset + hits)).otherwise("")


def effective_weight(mode: Column, query: Column, given: Column) -> Column:
    """The semantic weight: by mode, else as given, else by the words of the query."""
    trimmed = F.trim(F.regexp_replace(query, r"(?U)\s+", " "))
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))
    auto = F.when(words.between(3, 5) & ~F.contains(query, F.lit('"')), SOME).when(words >= 6, MANY).otherwise(FEW)
    mode = F.upper(F.coalesce(mode, F.lit("")))
    return F.when(mode == "LEXICAL", 0.0).when(mode == "SEMANTIC", 1.0).when((given > 0) & (given <= 1), given).otherwise(auto)


def effective_mode(mode: Column) -> Column:
    """LEXICAL, SEMANTIC, or else HYBRID."""
    mode = F.upper(F.coalesce(mode, F.lit("")))
    return F.when(mode.isin("LEXICAL", "SEMANTIC"), mode).otherwise("HYBRID")


def matched_fields(query: Column, fields: dict[str, Column]) -> Column:
    """Names of fields that contain the query, in lower case and as a whole; none for an empty one."""
    q = F.lower(query)
    hit = lambda n: F.when((q != "") & F.contains(F.lower(fields[n]), q), F.lit(n))
    return F.array_compact(F.array(*(hit(n) for n in sorted(fields))))


def first_string(*columns: Column) -> Column:
    """The first present value, or an empty string."""
    return F.coalesce(*columns, F.lit(""))


def as_long(value: Column) -> Column:
    """A whole number, or 0."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def backoff_seconds(attempts: Column) -> Column:
    """1, 2, 4, 8, 16, then 32 seconds."""
    return F.pow(F.lit(2.0), F.least(F.greatest(attempts, F.lit(1)) - 1, F.lit(5))).cast("int")
