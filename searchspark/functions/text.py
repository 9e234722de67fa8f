"""Text functions: normal form, tokens, transliteration, stems."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}]+)"

# Cyrillic letters and their Latin spelling; hard and soft sign have none.
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
# Latin spellings and their Cyrillic letter. Of the letters that share a spelling,
# е and й are meant.
LATIN_TO_CYRILLIC = {v: k for k, v in CYRILLIC_TO_LATIN.items() if v and k not in "ыэ"}


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize(text: Column) -> Column:
    """NFKC, lower case, white space collapsed and trimmed. Only texts beyond ASCII visit Python."""
    folded = F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(F.pandas_udf(_nfkc, "string")(text))
    return F.trim(F.regexp_replace(F.lower(folded), r"(?U)\s+", " "))


def normalize_native(text: Column) -> Column:
    """normalize() for texts known to be in NFKC: all in the JVM."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


def has_cyrillic(text: Column) -> Column:
    """Whether a Cyrillic letter occurs."""
    return text.rlike(r"\p{IsCyrillic}")


def _spelled(text: Column, long: list[tuple[str, str]], single: dict[str, str]) -> Column:
    """text with long spellings replaced one after the other, then single letters at once."""
    for spelling, other in long:
        text = F.replace(text, F.lit(spelling), F.lit(other))
    letters = sorted(single, key=lambda c: (single[c] == "", c))
    return F.translate(text, "".join(letters), "".join(single[c] for c in letters))


def cyr_to_lat(text: Column) -> Column:
    """Cyrillic letters spelled in Latin ones; everything else stays."""
    both = CYRILLIC_TO_LATIN | {k.upper(): v for k, v in CYRILLIC_TO_LATIN.items()}
    return _spelled(text, [(k, v) for k, v in both.items() if len(v) > 1], {k: v for k, v in both.items() if len(v) < 2})


def lat_to_cyr(text: Column) -> Column:
    """Latin spellings, from left to right and longest first, as Cyrillic letters; everything else
    stays.

    Replacing one spelling after the other comes to the same: only the s of "ts" can begin another
    spelling ("sh", "shch"), so that one goes first, then the longest.
    """
    long = sorted((t for t in LATIN_TO_CYRILLIC if len(t) > 1), key=lambda t: (t != "ts", -len(t), t))
    return _spelled(text, [(t, LATIN_TO_CYRILLIC[t]) for t in long], {k: v for k, v in LATIN_TO_CYRILLIC.items() if len(k) == 1})


def spelled_otherwise(normal: Column) -> Column:
    """A normal form spelled in the other alphabet."""
    return F.when(has_cyrillic(normal), cyr_to_lat(normal)).otherwise(lat_to_cyr(normal))


def transliterate(text: Column, normal: Callable[[Column], Column] = normalize) -> Column:
    """The normal form spelled in the other alphabet."""
    return spelled_otherwise(normal(text))


def unique_non_empty(values: Column, normal: Callable[[Column], Column] = normalize_native) -> Column:
    """Each value normalised, without empty ones and repeats, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(values, normal), lambda v: v != ""))


def _strings(value: object) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v)
    elif isinstance(value, dict):
        for k in sorted(value):
            yield from _strings(value[k])


def _all_text(documents: pd.Series) -> pd.Series:
    return documents.map(lambda d: " ".join(_strings(json.loads(d))) if d else "")


def all_text(document_json: Column) -> Column:
    """All strings of a JSON value at any depth, keys in order and left out, joined by spaces."""
    return F.pandas_udf(_all_text, "string")(document_json)


def content_hash(text: Column) -> Column:
    """SHA-256, hexadecimal."""
    return F.sha2(text, 256)


def with_role(text: Column, role: str) -> Column:
    """The prefix that tells an encoder what a text is: "passage" or "query"."""
    return F.concat(F.lit(f"{role}: "), text)


def semantic_text(columns: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Non-empty fields joined by line feeds; fields of weight 0.9 and more count twice."""
    parts = []
    for name, c in columns.items():
        parts += [F.when(c != "", c)] * (2 if (weights or {}).get(name, 0) >= 0.9 else 1)
    return F.concat_ws("\n", *parts)


#: Words whose stems a task remembers.
KNOWN_STEMS = 500_000


def stems(text: Column, stemmer: Callable[[str], str], normal: Callable[[Column], Column] = normalize) -> Column:
    """Each word's stem, distinct and in order; none for a null text. The different words of a text
    visit Python, where a task stems each once, as far as it can remember them; nothing is shuffled."""

    def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}

        def one(words: Iterable[str]) -> list[str]:
            if len(known) > KNOWN_STEMS:
                known.clear()
            return list(dict.fromkeys(known[w] if w in known else known.setdefault(w, stemmer(w) or w) for w in words))

        for batch in batches:
            yield batch.map(lambda words: [] if words is None else one(words))

    return F.pandas_udf(stemmed, "array<string>")(F.array_distinct(tokens(normal(text))))


def enrich(df: DataFrame, document: Column, stemmer: Callable[[str], str] | None, transliteration: bool = True) -> DataFrame:
    """Adds _search_text, _stems and _translit of a JSON document; the last two are null where the
    stemmer or the transliteration is left out."""
    found = df.withColumn("_all_text", all_text(document))
    whole = F.col("_all_text")
    return found.withColumns({
        "_search_text": normalize(whole),
        "_stems": stems(whole, stemmer) if stemmer else F.lit(None).cast("array<string>"),
        "_translit": transliterate(whole) if transliteration else F.lit(None).cast("string"),
    }).drop("_all_text")
