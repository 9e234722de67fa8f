import pytest
from pyspark.sql import functions as F

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = (
    "_row", "_k", "_all", "_text", "_id", "key", "size", "taken", "token", "tokens", "node", "bits", "keep", "quality",
    "evidence", "media", "start", "offset", "fingerprint", "score", "target", "shard", "words", "spans", "component_id",
)

LINE = "The quick brown fox jumps over the lazy dog while seven wizards watch from a very old stone bridge near town. "
ODD = [
    None, "", "   ", "One two", "one\ttwo ", "a" * 350, LINE * 3, LINE * 3 + "The end.", LINE * 3,
    "mail me: a.b@c.example.org or +1 (555) 123-4567, 10.0.0.1 and 4111 1111 1111 1111\n\nNew section", "é́ 😀 Straße",
    "word " * 40_000, "x" * 5_000 + "\n" + LINE, " lead and trail \n", "<|endoftext|> a<|endoftext|>b", "tab\tand\x1codd\x0bspace",
]


def with_clashes(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a repeated row, an id with two texts, null ids, null sources, clashing columns."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(ODD)]
    rows += [rows[6], (3, "another text of the same id", "en", "src0", 27), (None, LINE, "en", "src1", 9), (None, None, None, None, None)]
    return with_clashes(spark.createDataFrame(rows, KIND))


@pytest.fixture(scope="session")
def empty(spark):
    return with_clashes(spark.createDataFrame([], KIND))


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i % 4 == 0)) for i in range(16)] + [(0, 1, 1), (None, 1, 0), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
