"""Keyed tables that grow by changed rows only.

A table under a root is a set of parts. A version (a batch, or maintenance between two) writes the
rows that it changes as one part, dealt into hashed buckets, and then a manifest that lists the
parts of the table as of that version. Readers take the newest manifest up to the version they ask
for, so versions that wrote nothing need no file of their own. The newest row of a key counts, a row
with live = false says that the key is gone.

Once FAN parts of one level have come together they are merged into one part of the next level, so
that a row is rewritten about once for each power of FAN, and a reader sees a few parts at most. A
version that runs again writes the same parts and the same manifest; nothing is overwritten while it
is read by others. vacuum() removes what no kept manifest names.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchspark.plans.staging import SMALL, few

#: More buckets let a version read less of a large state; each is a directory that every part has.
BUCKETS, FAN = 16, 8
#: Versions that vacuum() keeps.
KEPT = 20


class ChangeLog:
    """Rows of a schema (Spark DDL) by key, under root/name.

    Buckets are hashes of the columns dealt_by (default: the key). With spread over 1 the rows of one
    value of dealt_by, which may be very many, lie in so many buckets. Rows of a wide table are not shuffled
    when a version writes them: each task writes its own files into the buckets.
    """

    def __init__(
        self, spark: SparkSession, root: str, name: str, key: list[str], schema: str, buckets: int = BUCKETS, fan: int = FAN,
        dealt_by: list[str] | None = None, spread: int = 1, wide: bool = False,
    ):
        self.spark, self.key, self.buckets, self.fan = spark, key, buckets, fan
        self.dealt_by, self.spread, self.wide = dealt_by or key, spread, wide
        self.path = f"{root}/{name}"
        self.columns = spark.createDataFrame([], schema).columns
        self.stored = f"{schema}, live boolean, at bigint, bucket int"

    # Manifests

    def _hadoop(self, path: str):  # noqa: ANN202
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        """Versions with a manifest, ascending."""
        fs, place = self._hadoop(f"{self.path}/manifest")
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def parts(self, version: int) -> list[dict]:
        """The parts as of a version: path, level and rows' first and last version, oldest first."""
        known = [v for v in self.versions() if v <= version]
        if not known:
            return []
        fs, place = self._hadoop(f"{self.path}/manifest/{known[-1]}.json")
        stream = fs.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, parts: list[dict]) -> None:
        """Write a manifest whole under its name."""
        fs, final = self._hadoop(f"{self.path}/manifest/{version}.json")
        _, own = self._hadoop(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(own, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if fs.exists(final):
            fs.delete(final, False)
        if not fs.rename(own, final):
            raise OSError(f"manifest {version} of {self.path} could not be written")

    # Rows

    def _bucket(self) -> Column:
        shift = F.pmod(F.xxhash64(*self.key), F.lit(self.spread)) if self.spread > 1 else F.lit(0)
        return F.pmod(F.xxhash64(*self.dealt_by) + shift, F.lit(self.buckets)).cast("int")

    def _read(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.stored)
        source = self.spark.read.schema(self.stored).option("basePath", f"{self.path}/parts")
        return source.parquet(*(f"{self.path}/{p['path']}" for p in parts)).drop("part")

    def _newest(self, parts: list[dict], columns: list[str] | None = None, wanted: Column | None = None) -> DataFrame:
        """key, columns (all by default), live and at of the newest row of each key in parts. A part has one row of a key,
        so only the keys of parts after the first, in which most rows lie, are compared."""
        kept = [c for c in self.columns if columns is None or c in self.key or c in columns]
        rows, later = self._read(parts), self._read(parts[1:])
        if wanted is not None:
            rows, later = rows.filter(wanted), later.filter(wanted)
        rows = rows.select(*kept, "live", "at")
        if len(parts) < 2:
            return rows
        newest = later.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key))).agg(F.max("at").alias("_newest"))
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.key)))
        held = rows.join(F.broadcast(newest) if later.limit(SMALL + 1).count() <= SMALL else newest, same, "left")
        return held.filter(F.col("_newest").isNull() | (F.col("_newest") <= F.col("at"))).select(*kept, "live", "at")

    def latest(self, version: int, columns: list[str] | None = None) -> DataFrame:
        """All rows after a version; with columns, only these are read beside the key."""
        return self._newest(self.parts(version), columns).filter("live").drop("live", "at")

    def of(self, version: int, keys: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Rows after a version whose columns dealt_by are among keys only; other buckets are not read, nor other columns,
        where some are given."""
        parts = self.parts(version)
        kept = [c for c in self.columns if columns is None or c in self.key or c in columns]
        if not parts:
            return self.spark.createDataFrame([], self.stored).select(*kept)
        on = [c for c in self.key if c in keys.columns]
        wanted = keys.select(*on).distinct()
        first = F.xxhash64(*self.dealt_by)
        dealt = F.array(*(F.pmod(first + i, F.lit(self.buckets)).cast("int") for i in range(self.spread)))
        buckets = {r[0]: r[1] for r in wanted.select(F.explode(dealt).alias("b")).groupBy("b").count().collect()}
        asked = F.broadcast(wanted) if sum(buckets.values()) <= SMALL * self.spread else wanted
        return self._newest(parts, columns, F.col("bucket").isin([*buckets])).filter("live").select(*kept).join(asked, on, "left_semi")

    def matching(self, version: int, condition: Column, columns: list[str]) -> DataFrame:
        """key and columns of the rows after a version that meet a condition. The condition reaches the files; beside the
        rows that meet it, only the keys of parts after the first, in which most rows lie, are read."""
        parts = self.parts(version)
        found = self._read(parts).filter(F.col("live") & condition).select(*self.key, *columns, "at")
        if len(parts) < 2:
            return found.select(*self.key, *columns)
        later = few(self._read(parts[1:]).groupBy(*self.key).agg(F.max("at").alias("_newest")))
        kept = F.col("_newest").isNull() | (F.col("_newest") <= F.col("at"))
        return found.join(later, self.key, "left").filter(kept).select(*self.key, *columns)

    def write(self, changed: DataFrame, version: int) -> None:
        """The rows that a version changed, one for each key: columns, and live where some of them are gone."""
        live = changed if "live" in changed.columns else changed.withColumn("live", F.lit(True))
        path = f"parts/part={version}"
        self._write(live.select(*self.columns, "live", F.lit(version).cast("bigint").alias("at")), path, deal=not self.wide)
        parts = [*self.parts(version - 1), {"path": path, "level": 0, "first": version, "last": version}]
        while len(tail := parts[-self.fan :]) == self.fan and len({p["level"] for p in tail}) == 1:
            parts = [*parts[: -self.fan], self._merged(tail, whole=len(parts) == self.fan)]
        self._commit(version, parts)

    def _merged(self, parts: list[dict], whole: bool) -> dict:
        """Parts in a row as one; rows that are gone go only where nothing older can hold them."""
        level, first, last = parts[0]["level"] + 1, parts[0]["first"], parts[-1]["last"]
        rows = self._newest(parts)
        path = f"parts/part={first}-{last}"
        self._write(rows.filter("live") if whole else rows, path, deal=True)
        return {"path": path, "level": level, "first": first, "last": last}

    def _write(self, rows: DataFrame, where: str, deal: bool) -> None:
        dealt = rows.withColumn("bucket", self._bucket())
        ready = (dealt.repartition("bucket") if deal else dealt).sortWithinPartitions("bucket", *self.key)
        ready.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{where}")

    def part(self, version: int) -> DataFrame:
        """The rows that a version wrote."""
        return self._read([{"path": f"parts/part={version}"}])

    def vacuum(self, kept: int = KEPT) -> list[str]:
        """Remove all but the newest kept manifests, and the parts that none of these names; returns
        the parts removed. Older versions can't be read after that."""
        known = self.versions()
        named = {p["path"] for v in known[-kept:] for p in self.parts(v)}
        for v in known[:-kept]:
            fs, place = self._hadoop(f"{self.path}/manifest/{v}.json")
            fs.delete(place, False)
        fs, place = self._hadoop(f"{self.path}/parts")
        there = [f"parts/{s.getPath().getName()}" for s in fs.listStatus(place)] if fs.exists(place) else []
        gone = [p for p in there if p not in named]
        for p in gone:
            fs.delete(self._hadoop(f"{self.path}/{p}")[1], True)
        return gone
