"""The index: live documents of collections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchspark.plans.spec import ALL, CollectionSpec

KEY = ["collection", "id"]


def entries(applied: DataFrame, *more: str) -> DataFrame:
    """Index rows of applied upserts: collection, id, _revision, document, and more columns of theirs."""
    live = applied.filter("operation = 'upsert'")
    return live.select("collection", F.col("document_id").alias("id"), F.col("revision").alias("_revision"), F.col("document_json").alias("document"), *more)


def apply_to_index(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after changed (rows of the current state that are new): whole documents are
    replaced, deleted ones go."""
    gone = changed.select("collection", F.col("document_id").alias("id"))
    return index.join(gone, KEY, "left_anti").unionByName(entries(changed), allowMissingColumns=True)


def rebuild(applied: DataFrame) -> DataFrame:
    """The index from the applied state alone."""
    return entries(applied)


def audit(applied: DataFrame, index: DataFrame) -> DataFrame:
    """Rows in which index and applied state differ: collection, id, expected, found (revisions)."""
    want = rebuild(applied).select(*KEY, F.col("_revision").alias("expected"))
    have = index.select(*KEY, F.col("_revision").alias("found"))
    return want.join(have, KEY, "full").filter(~F.col("expected").eqNullSafe(F.col("found")))


def retire(index: DataFrame, names: list[str]) -> DataFrame:
    """The index without some collections; those it does not hold are no matter."""
    return index.filter(~F.col("collection").isin(names)) if names else index


def add_embedder(index: DataFrame, name: str) -> DataFrame:
    """A vector column for a new embedder, null for all documents; nothing if it is there."""
    return index if name in index.columns else index.withColumn(name, F.lit(None).cast("array<float>"))


def lookup(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents by collection and id."""
    return index.join(ids.select(*KEY).distinct(), KEY)


def materialize(df: DataFrame, spec: CollectionSpec, document: str = "document", known: tuple[str, ...] = ()) -> DataFrame:
    """Declared fields of the JSON document as columns, so that filters reach the files once
    written. known lists the fields that "*" stands for."""
    roles = (*spec.searchable, *spec.filterable, *spec.sortable, *spec.semantic, *spec.returnable)
    fields = dict.fromkeys(f for r in roles for f in (known if r == ALL else (r,)))
    value = lambda f: typed(f, spec.types[f], document) if f in spec.types else F.get_json_object(document, f"$.{f}")
    return df.withColumns({f: value(f) for f in fields if f not in df.columns})


def _scalar(value: Column, kind: str) -> Column:
    """A variant that is one value as a type; null for arrays, objects, and what is none of this type. Fractions are
    no whole numbers."""
    one = ~F.schema_of_variant(value).rlike("^(ARRAY|OBJECT|VOID)")
    out = F.try_variant_get(value, "$", kind)
    return F.when(one & (out.cast("double") == F.try_variant_get(value, "$", "double")) if kind == "bigint" else one, out)


def typed(name: str, kind: str, document: str = "document") -> Column:
    """A field of a JSON document as a type of plans.spec.TYPES; null where it is absent or no such value. A name with
    dots is a field of that very name, or else a field of an object. One value is an array of one; entries of an array
    that are not of its type are null."""
    quoted = lambda part: "['" + part.replace("'", "\\'") + "']" if '"' in part else f'["{part}"]'
    parsed = F.try_parse_json(document)
    paths = dict.fromkeys(("$" + quoted(name), "$" + "".join(map(quoted, name.split(".")))))
    value = F.coalesce(*(F.try_variant_get(parsed, p, "variant") for p in paths))
    if not kind.startswith("array"):
        return _scalar(value, kind)
    entry = kind.removeprefix("array<").removesuffix(">")
    only = _scalar(value, entry)
    many = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: _scalar(v, entry))
    return F.coalesce(F.when(only.isNotNull(), F.array(only)), F.when(F.schema_of_variant(value).startswith("ARRAY"), many))


def stored_names(fields: dict[str, str]) -> dict[str, str]:
    """Names of columns in which declared fields are stored, whatever signs their own names have."""
    return {f: f"f{i}_" + re.sub(r"\W", "_", f.lower()) for i, f in enumerate(fields)}


def shredded(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """id, live and the declared fields of rows (id, document, live) under their stored names."""
    return rows.select("id", "live", *(typed(f, fields[f]).alias(c) for f, c in stored_names(fields).items()))


def returnable(df: DataFrame, spec: CollectionSpec) -> DataFrame:
    """id, _revision and the fields that may be returned."""
    return df if ALL in spec.returnable else df.select("id", "_revision", *(f for f in spec.returnable if f not in ("id", "_revision")))
