"""Search as a whole: filters, hybrid ranking, pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchspark.functions import paging
from searchspark.functions.text import semantic_text
from searchspark.operators import lexical as lex
from searchspark.operators.semantic import BLOCK, depths, dot, nearest, scores
from searchspark.plans.spec import ALL, CollectionSpec
from searchspark.plans.staging import few, stage

# Why a request for similar documents cannot be answered.
NOT_FOUND = "document not found"
NOTHING_ASKED = "text or document_id is required"
#: Columns of an index that are no fields of a document.
RESERVED = ("collection", "id", "_revision", "_search_text", "_stems", "_translit", "content_hash", "embedding", "document")


def build_filters(filters: dict[str, list], spec: CollectionSpec, arrays: tuple[str, ...] = (), columns: dict[str, str] | None = None) -> Column:
    """All of: field is one of the values. A field that may not be filtered is an error; a filter
    without values asks nothing. Fields in arrays match by any of their entries. With columns, fields are
    stored under these names in their declared types, and values are read as of that type; those that are
    none match nothing."""
    out = F.lit(True)
    for field, values in filters.items():
        if field not in spec.filterable:
            raise ValueError(f"filter {field} is not allowed")
        if values:
            kind = spec.types.get(field, "string") if columns and field in columns else None
            column = F.col(columns[field]) if kind else F.col(field)
            entry = kind.removeprefix("array<").removesuffix(">") if kind else None
            known = [F.lit(v).try_cast(entry) if entry else F.lit(v) for v in values]
            many = kind.startswith("array") if kind else field in arrays
            out = out & (F.arrays_overlap(column, F.array(*known)) if many else column.isin(known))
    return out


def parse_sort(sort: list[str], spec: CollectionSpec) -> list[Column]:
    """"field:asc" and "field:desc" of sortable fields; documents without the field come last."""
    out = []
    for s in sort:
        field, _, way = s.partition(":")
        if field not in spec.sortable or way not in ("", "asc", "desc"):
            raise ValueError(f"sort {s} is not allowed")
        out.append(F.col(f"`{field}`").desc_nulls_last() if way == "desc" else F.col(f"`{field}`").asc_nulls_last())
    return out


def headers(queries: DataFrame, has_vector: Column | None = None) -> DataFrame:
    """Adds offset, size, weight, effective_mode, lexical_fallback. Where a weight asks for a
    vector and there is none, the query becomes lexical."""
    weight = paging.effective_weight(F.col("mode"), F.col("query"), F.col("semantic_weight"))
    failed = (weight > 0) & ~(has_vector if has_vector is not None else F.lit(True))
    return queries.withColumns({
        "offset": paging.decode_offset(F.col("page_token")), "size": paging.page_size(F.col("page_size")),
        "weight": F.when(failed, 0.0).otherwise(weight),
        "effective_mode": F.when(failed, "LEXICAL").otherwise(paging.effective_mode(F.col("mode"))),
        "lexical_fallback": failed,
    })


def fuse(lexical_hits: DataFrame, header: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits that can be on a page of their query that ends at its depth, with score = (1 - weight) *
    lexical + weight * semantic, and the two parts as columns; and query_id, total of all hits.

    Hits by words have their exact semantic part: their vectors are joined by id. Every other document
    with a vector is a hit of a query with a weight, too, and stands behind all but the nearest of its
    kind, as many as the page is deep, so no more of them go on; the total counts them all.
    """
    asked = header.select("query_id", "weight", "vector")
    wanted = asked.filter("weight > 0")
    counted_hits = lexical_hits.join(asked.select("query_id", "weight"), "query_id").filter("weight < 1")
    # Vectors of documents go once to the hits that need them; those of queries, where there are few, to all tasks.
    sides = wanted.select("query_id", "vector")
    sides = F.broadcast(sides) if sides.count() <= BLOCK else sides
    if not sides.limit(1).count():
        hits = stage(counted_hits.withColumns({"semantic_score": F.lit(0.0), "score": F.round("lexical_score", 6)}), "search-words")
        counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
        return hits, asked.join(counted, "query_id", "left").select("query_id", F.coalesce("_n", F.lit(0)).cast("long").alias("total"))
    near_words = counted_hits.filter("weight > 0").join(vectors, "id", "left").join(sides, "query_id")
    dotted = F.when(F.col("embedding").isNotNull(), dot(F.col("embedding"), F.col("vector")))
    plain = counted_hits.filter("weight = 0").withColumn("semantic_score", F.lit(None).cast("double"))
    by_words = stage(near_words.withColumn("semantic_score", dotted).drop("embedding", "vector").unionByName(plain), "search-words")
    near = scores(wanted.join(header.select("query_id", "depth"), "query_id"), vectors, F.col("depth"), F.col("weight")).drop("rank")
    alone = near.join(by_words.select("query_id", "id"), ["query_id", "id"], "left_anti").join(header.select("query_id", "weight"), "query_id")
    both = by_words.unionByName(alone, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    parts = both.withColumn("lexical_score", (1 - F.col("weight")) * zero("lexical_score")).withColumn("semantic_score", F.col("weight") * zero("semantic_score"))
    hits = parts.withColumn("score", F.round(F.col("lexical_score") + F.col("semantic_score"), 6))
    n_vectors = vectors.filter("embedding is not null").count()
    unseen = F.count(F.when((F.col("weight") == 0) | ~F.col("has_vector"), 1))
    counted = by_words.withColumn("has_vector", F.col("semantic_score").isNotNull()).groupBy("query_id").agg(unseen.alias("_n"))
    total = F.coalesce("_n", F.lit(0)) + F.when(F.col("weight") > 0, F.lit(n_vectors)).otherwise(0)
    return hits, asked.join(counted, "query_id", "left").select("query_id", total.alias("total"))


HEADER = ("query_id", "offset", "size", "effective_mode", "weight", "lexical_fallback")


def respond(ranked: DataFrame, header: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per hit of each query's page, with the query's header, its total and the token of the
    next page. A query whose page is empty has one row without a hit."""
    paged = header.select(*HEADER).join(totals, "query_id").join(ranked, "query_id", "left")
    here = (F.col("rank") > F.col("offset")) & (F.col("rank") <= F.col("offset") + F.col("size"))
    hits = F.least(F.greatest(F.col("total") - F.col("offset"), F.lit(0)), F.col("size"))
    token = paging.next_token(F.col("offset"), hits, F.col("total"))
    bare = header.select(*HEADER).join(totals, "query_id").filter(hits == 0)
    page = paged.filter(here).unionByName(bare, allowMissingColumns=True)
    return page.withColumn("next_page_token", token).drop("offset", "size")


def ranked(queries: DataFrame, rows: DataFrame, spec: CollectionSpec, found: DataFrame, sort: list[str] | None) -> DataFrame:
    """Answers as of search() from found, the hits by words; rows (id, embedding, sortable fields) are only read
    where a query has a semantic part or a declared sort."""
    header = stage(headers(queries, F.col("vector").isNotNull()).withColumn("depth", F.col("offset").cast("long") + F.col("size")), "search-headers")
    hits, totals = fuse(found, header, rows.select("id", "embedding"))
    order = parse_sort(sort or [], spec)
    if order:
        fields = [f for f in spec.sortable if f in rows.columns and f not in ("id", *hits.columns)]
        hits = hits.join(rows.select("id", *(f"`{f}`" for f in fields)), "id", "left") if fields else hits
    first = F.when(F.col("weight") > 0, F.col("score")).desc_nulls_last()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(first, *lex.rules(order)))
    asked = header.select("query_id", "depth")
    parts = [hits.join(asked.filter(some), "query_id").withColumn("rank", rank).filter(F.col("rank") <= most).filter("rank <= depth") for some, most in depths(asked)]
    top = reduce(DataFrame.unionByName, parts) if parts else hits.withColumn("rank", rank).limit(0)
    return respond(top.select("query_id", "rank", "id", "score", "lexical_score", "semantic_score"), header, totals)


def _rows(index: DataFrame, spec: CollectionSpec, filters: dict[str, list] | None, arrays: tuple[str, ...]) -> DataFrame:
    rows = index.filter(build_filters(filters or {}, spec, arrays))
    return rows if "collection" in rows.columns else rows.withColumn("collection", F.lit(spec.name))


def search(
    queries: DataFrame, index: DataFrame, spec: CollectionSpec, filters: dict[str, list] | None = None,
    sort: list[str] | None = None, synonyms: DataFrame | None = None, arrays: tuple[str, ...] = (),
    token_rows: DataFrame | None = None, variants: DataFrame | None = None,
) -> DataFrame:
    """Answers to queries (query_id, query, mode, semantic_weight, page_size, page_token, vector)
    over index (id, searchable fields, embedding): one row per hit.

    Filters come before both kinds of search. Purely lexical queries are ranked by the rules in
    order, others by score, then the rules, then id. Every document with a vector is a hit where the
    weight is not 0, whatever its score. token_rows is a stored lexical.token_table() of the index;
    without it one is made and stored first.
    """
    rows = _rows(index, spec, filters, arrays)
    fields = [f for f in spec.searchable if f in rows.columns]
    if token_rows is None:
        token_rows = stage(lex.token_table(rows, fields), "search-tokens")
    elif filters:
        token_rows = token_rows.join(rows.select("id"), "id", "left_semi")
    found = lex.lexical(queries, token_rows, len(fields), synonyms, variants)
    return ranked(queries, rows, spec, found, sort)


def similar(
    requests: DataFrame, index: DataFrame, spec: CollectionSpec, embed: Callable[[DataFrame], DataFrame],
    filters: dict[str, list] | None = None, arrays: tuple[str, ...] = (), named: DataFrame | None = None,
) -> DataFrame:
    """Documents like a text or a document: requests (query_id, text, document_id, page_size,
    page_token) to answers as of search(), and error, which is null but for requests that cannot be
    answered.

    A text that is not blank is asked for; else the semantic fields of the document with that id, each
    once. A document named in the request is no answer to it, even where a text is given. embed adds
    vector to rows with the column text; it embeds texts as queries. named holds the documents named in
    requests, with their semantic fields, where index has only id and embedding.
    """
    # Vectors may be long to make, and are read for each block of requests and to be counted.
    rows = stage(_rows(index, spec, filters, arrays).select("id", "embedding"), "similar-index")
    text = semantic_text({c: F.col(c) for c in spec.semantic})
    asked_for = few(requests.select(F.col("document_id").cast("string").alias("_own")).distinct())
    own = (index if named is None else named).select(F.col("id").cast("string").alias("_own"), text.alias("_document_text")).join(asked_for, "_own", "left_semi")
    given = F.trim(F.coalesce(F.col("text"), F.lit("")))
    named = F.coalesce(F.col("document_id").cast("string"), F.lit(""))
    asked = requests.withColumns({"_given": given, "_self": named}).join(own, F.col("_self") == F.col("_own"), "left")
    error = F.when(F.col("_given") != "", None).when((F.col("_self") != "") & F.col("_own").isNull(), NOT_FOUND).when(
        F.coalesce("_document_text", F.lit("")) == "", NOTHING_ASKED
    )
    full = asked.withColumn("error", error).withColumn("text", F.when(F.col("_given") != "", F.col("_given")).otherwise(F.col("_document_text")))
    vectors = stage(embed(full.filter("error is null").select("query_id", "text", "_self", "page_size", "page_token")), "similar-vectors")
    header = vectors.select("query_id", "_self", "vector", paging.decode_offset(F.col("page_token")).alias("offset"), paging.page_size(F.col("page_size")).alias("size"))
    depth = (F.col("offset").cast("long") + F.col("size") + 1).alias("depth")
    found = scores(header.select("query_id", "vector", depth), rows.select("id", "embedding"), F.col("depth"))
    named_too = found.join(header.select("query_id", "_self"), "query_id").filter(F.col("id").cast("string") != F.col("_self"))
    ranked = named_too.withColumn("rank", nearest()).select(
        "query_id", "rank", "id", F.col("semantic_score").alias("score"), F.lit(0.0).alias("lexical_score"), "semantic_score"
    )
    with_vector = rows.filter("embedding is not null")
    n = with_vector.count()
    selves = with_vector.select(F.col("id").cast("string").alias("_self")).distinct().withColumn("_in", F.lit(1))
    totals = header.join(selves, "_self", "left").select("query_id", (F.lit(n) - F.coalesce("_in", F.lit(0))).cast("long").alias("total"))
    modes = header.withColumns({"effective_mode": F.lit("SEMANTIC"), "weight": F.lit(1.0), "lexical_fallback": F.lit(False)})
    answers = respond(ranked, modes, totals).withColumn("error", F.lit(None).cast("string"))
    return answers.unionByName(full.filter("error is not null").select("query_id", "error"), allowMissingColumns=True)


def response(answers: DataFrame, queries: DataFrame, index: DataFrame, spec: CollectionSpec) -> DataFrame:
    """Answers of search() or similar() as a caller sees them: with provider_key, item_type, item_id,
    revision, the fields that may be returned, and matched_fields of queries (query_id, query, explain)
    that ask for them. Pages are small beside the index, which is only joined by their ids."""
    given = lambda *names: paging.first_string(*(F.col(n) for n in names if n in index.columns))
    shown = [f for f in (index.columns if ALL in spec.returnable else spec.returnable) if f not in RESERVED and f in index.columns]
    texts = [f for f in shown if index.schema[f].dataType.typeName() == "string"]
    data = index.select(
        F.col("id"), given("provider_key", "_provider_key").alias("provider_key"), given("item_type", "_item_type").alias("item_type"),
        (paging.as_long(F.col("_revision")) if "_revision" in index.columns else F.lit(0).cast("long")).alias("revision"), *(F.col(f"`{f}`").alias(f"_f_{f}") for f in shown),
    )
    asked = queries.select("query_id", F.col("query").alias("_query"), F.coalesce("explain", F.lit(False)).alias("_explain"))
    joined = answers.join(asked, "query_id", "left").join(data, "id", "left")
    matched = paging.matched_fields(F.col("_query"), {f: F.col(f"`_f_{f}`") for f in texts})
    explained = joined.withColumn("matched_fields", F.when(F.col("_explain"), matched).otherwise(F.array().cast("array<string>")))
    named = explained.withColumn("item_id", F.col("id").cast("string")).drop("id", "_query", "_explain")
    return named.withColumnsRenamed({f"_f_{f}": f for f in shown if f not in named.columns})
