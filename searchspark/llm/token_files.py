"""Token files: flat unsigned ids, 64-bit document offsets, bases by prefix sums.

A folder holds, for each partition p in ascending order of doc_id,
``p.ids`` (unsigned 16-bit ids; 32-bit ones by the parameter dtype), ``p.offsets`` (unsigned
64-bit, one more than documents, counted from the partition's start) and ``p.docs`` (signed 64-bit
document ids). The first id of partition p in the whole corpus is the sum of the sizes before it.
Files grow batch by batch, so a task holds one batch, and there are as many partitions as the size
of the texts asks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchspark.llm.files import Growing, mapped
from searchspark.llm.tokens import encoder
from searchspark.plans.staging import new_path, stage

#: Bytes of text for one partition, about.
PARTITION_BYTES = 128 << 20
#: Documents of one output batch when files are read back.
READ_ROWS = 4096


def _file(folder: str, part: int, kind: str) -> str:
    return f"{folder}/{part:06d}.{kind}"


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, drops_space: bool = True,
    dtype: str = "<u2", partitions: int | None = None,
) -> DataFrame:
    """Encode docs (doc_id, text), append end_id to each, and write the files to folder.

    Returns the staged manifest: part, n_docs, n_ids, n_null (documents without an id, the last ones
    of the last file). Null texts are empty documents of one id. Null ids come last. Rows with equal
    ids are written in the order of their texts; other columns are ignored; an empty table writes no
    file. An id beyond dtype is an error. Which rows a file holds follows from the data alone, and
    files appear under their names whole, so a task that runs twice writes the same.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if partitions is None:
        size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    ordered = texts.repartitionByRange(partitions, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_last(), "text"
    )
    # pandas would turn a column of ids with nulls into floating numbers.
    whole = ordered.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    largest = np.iinfo(dtype).max

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, end = encoder(tokenizer, drops_space).encode, np.array([end_id], dtype="<u4").tobytes()
        files: dict[str, Growing] = {}
        n_docs = n_ids = n_null = 0
        for batch in batches:
            if not files:
                files = {kind: Growing(_file(folder, part, kind)) for kind in ("ids", "offsets", "docs")}
                files["offsets"].add(np.zeros(1, dtype="<u8"))
            encoded = [encode(t) + end for t in batch["text"]]
            ids = np.frombuffer(b"".join(encoded), dtype="<u4")
            if ids.size and int(ids.max()) > largest:
                raise ValueError(f"id {int(ids.max())} does not fit {dtype}")
            ends = np.cumsum([len(b) // 4 for b in encoded], dtype="<u8") + np.uint64(n_ids)
            files["ids"].add(ids.astype(dtype))
            files["offsets"].add(ends.astype("<u8"))
            files["docs"].add(batch["doc_id"].to_numpy(dtype="<i8"))
            n_docs, n_ids, n_null = n_docs + len(batch), n_ids + ids.size, n_null + int(batch["no_id"].sum())
        for f in files.values():
            f.close()
        if files:
            yield pd.DataFrame({"part": [part], "n_docs": [n_docs], "n_ids": [n_ids], "n_null": [n_null]})

    return stage(whole.mapInPandas(write, "part int, n_docs long, n_ids long, n_null long"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str, dtype: str = "<u2") -> DataFrame:
    """Documents as the files hold them: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before. The window below sees one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, base, n_null in zip(batch["part"], batch["base"], batch["n_null"], strict=True):
                ids, offsets, keys = (
                    mapped(_file(folder, part, kind), d)
                    for kind, d in (("ids", dtype), ("offsets", "<u8"), ("docs", "<i8"))
                )
                for at in range(0, len(keys), READ_ROWS):
                    ends = np.asarray(offsets[at : at + READ_ROWS + 1]).astype(np.int64)
                    own = pd.Series(np.asarray(keys[at : at + READ_ROWS])).astype("Int64")
                    yield pd.DataFrame(
                        {
                            "doc_id": own.mask(np.arange(at, at + len(own)) >= len(keys) - n_null),
                            "start": base + ends[:-1],
                            "n_tokens": np.diff(ends),
                            "ids_crc32": [
                                zlib.crc32(ids[a:b].astype("<u4").tobytes())
                                for a, b in zip(ends[:-1], ends[1:], strict=True)
                            ],
                        }
                    )

    return based.repartition(n, "part").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int, drops_space: bool = True) -> DataFrame:
    """Write docs to a new folder among the shared ones and read it back."""
    folder = new_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, folder, tokenizer, end_id, drops_space)
    return read_token_files(manifest, folder)
