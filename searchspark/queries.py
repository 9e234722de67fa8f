"""The registered queries of the engine, each with SQL of the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchspark.functions import envelope, paging, text
from searchspark.functions.stemmer import stem
from searchspark.operators import cells, embed, gate, index, ingest, lexical, search, semantic
from searchspark.plans.staging import new_path, stage, table
from searchspark.sources import fixtures
from searchspark.sources.fixtures import ENVELOPES_SQL
from searchspark.plans.schemas import APPLIED, ENVELOPE, INBOX
from searchspark.streaming.engine import SearchEngine, apply, event_files, land, stream_dedup, take_lanes
from searchspark.plans.spec import CollectionSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PROFILES = CollectionSpec("profiles")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Envelopes and gate

_REASON = """
case when operation is null or operation not in ('upsert', 'delete') then 'operation is required'
     when operation = 'upsert' and not coalesce(json_valid(document_json), false) then 'decode document_json'
     when operation = 'upsert' and json_type(case when json_valid(document_json) then document_json end) not in ('OBJECT', 'NULL') then 'decode document_json'
     when trim(coalesce(event_id, '')) = '' then 'event_id is required'
     when trim(coalesce(collection, '')) = '' then 'collection is required'
     when trim(coalesce(document_id, '')) = '' then 'document_id is required'
     when coalesce(revision, 0) <= 0 then 'revision must be greater than zero'
     when coalesce(occurred_at, '') <> '' and not regexp_matches(occurred_at, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}([.,]\\d+)?(Z|[+-]\\d{2}:\\d{2})$') then 'occurred_at must use RFC3339'
     when operation = 'upsert' and document_json in ('{}', 'null') then 'document is required for upsert' end"""
_VALID = f"{ENVELOPES_SQL}, judged as (select *, {_REASON} as reason from env), valid as (select * from judged where reason is null)"
_STATUS = f"""{_VALID}, ranked as (select *, row_number() over (partition by source_service, event_id, reason is null order by arrival) as n from judged),
done as (select *, case when reason is not null then 'rejected' when n > 1 then 'duplicate' else 'accepted' end as status from ranked)"""
_DECIDED = f"""{_STATUS}, accepted as (select *, concat_ws('|', source_service, event_id, operation, collection, document_id, revision,
  case when operation = 'upsert' then document_json end, occurred_at) as mark from done where status = 'accepted'),
held as (select *, max(revision) over (partition by collection, document_id order by arrival rows between unbounded preceding and 1 preceding) as before,
  first_value(mark) over (partition by collection, document_id, revision order by arrival) as winner from accepted),
decided as (select *, case when before is null or revision > before then 'new' when revision < before then 'stale'
  when mark = winner then 'duplicate' else 'conflict' end as decision from held)"""
_STATE = f"""{_DECIDED}, state as (select collection, document_id, max_by(revision, revision) as revision, arg_max(operation, revision) as operation,
  arg_max(document_json, revision) as document_json from decided where decision = 'new' group by collection, document_id)"""


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest(fixtures.envelopes(spark, sf_dir)).accepted


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.current_state(gate.decide(_accepted(spark, sf_dir)))


@query(f"with {_VALID} select arrival, coalesce(reason, '') as reason from judged")
def validate_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule each event breaks."""
    e = fixtures.envelopes(spark, sf_dir).withColumn("reason", F.coalesce(envelope.reject_reason(), F.lit("")))
    return e.select("arrival", "reason")


@query(f"with {_STATUS} select source_service, event_id, arrival, status, coalesce(reason, '') as message from done")
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status per event."""
    return ingest.ingest(fixtures.envelopes(spark, sf_dir)).status


@query(f"""with {_STATUS} select nullif(event_id, '') as event_id, nullif(collection, '') as collection, coalesce(nullif(revision, 0), -1) as revision, reason,
  case when reason in ('operation is required', 'decode document_json') then 'wire' else 'validate' end as stage from done where status = 'rejected'""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: refused events as stored."""
    return ingest.ingest(fixtures.envelopes(spark, sf_dir)).rejected.select(
        "event_id", "collection", F.coalesce("revision", F.lit(-1)).alias("revision"), "reason", "stage"
    )


@query(f"with {_STATUS} select source_service, event_id, arrival from done where status = 'accepted'")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: the first valid delivery of each event."""
    return _accepted(spark, sf_dir).select("source_service", "event_id", "arrival")


@query(f"with {_DECIDED} select arrival, decision from decided")
def revision_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on each accepted event."""
    return gate.decide(_accepted(spark, sf_dir)).select("arrival", "decision")


@query(f"with {_STATE} select collection, document_id, revision, operation from state")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the newest applied revision of each document."""
    return _state(spark, sf_dir).select("collection", "document_id", "revision", "operation")


@query(f"with {_STATE} select collection, document_id as id, revision as _revision, document_json as document from state where operation = 'upsert'")
def index_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live documents."""
    return index.rebuild(_state(spark, sf_dir))


def _batches(spark: SparkSession, sf_dir: str, rows: DataFrame) -> list[DataFrame]:
    """rows in two batches of about equal size, by arrival; a second delivery is in the batch of the first."""
    half = table(spark, sf_dir, "events").count() // 2
    early = F.col("arrival") % 1000000000 < half
    return [rows.filter(early), rows.filter(~early)]


def _two_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions on both batches, the index kept up to date, and the state after both."""
    first, second = _batches(spark, sf_dir, _accepted(spark, sf_dir))
    early = apply(first, spark.createDataFrame([], APPLIED), [PROFILES])
    state = stage(early.applied, "applied")
    late = gate.decide(second, state)
    changed = gate.current_state(late)
    return early.decisions.unionByName(late), index.apply_to_index(index.rebuild(state), changed), gate.current_state(late, state)


@query(f"with {_DECIDED} select arrival, decision from decided")
def decisions_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on each event, the second half against the state that the first half left."""
    return _two_batches(spark, sf_dir)[0].select("arrival", "decision")


@query(f"with {_STATE} select collection, document_id as id, revision as _revision, document_json as document from state where operation = 'upsert'")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after two batches, the second one applied to what the first one left."""
    return _two_batches(spark, sf_dir)[1]


@query(f"with {_DECIDED} select arrival, decision, cast(json_extract_string(document_json, '$.k') as bigint) as k from decided where operation = 'upsert'")
def audited_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with the payloads that the inbox holds, decoded again."""
    accepted = _accepted(spark, sf_dir)
    inbox = accepted.select(*ingest.DELIVERY, envelope.canonical_payload().alias("payload"), "arrival").select(*(c.split()[0] for c in INBOX.split(", ")))
    held = ingest.audit_payloads(gate.decide(accepted).select(*ingest.DELIVERY, "arrival", "decision"), inbox)
    again = envelope.decode_payload(held, "payload").filter("reason is null and operation = 'upsert'")
    decided = held.select("source_service", "event_id", "arrival", "decision")
    k = F.get_json_object("document_json", "$.k").cast("bigint").alias("k")
    return again.drop("arrival").join(decided, ingest.DELIVERY).select("arrival", "decision", k)


@query(f"with {_VALID} select arrival, document_id as id, revision as _revision, cast(json_extract_string(document_json, '$.k') as bigint) as k, 1 as n_fields from valid where operation = 'upsert'")
def flat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of events, with id and revision and without reserved names."""
    rows = fixtures.envelopes(spark, sf_dir).filter(envelope.reject_reason().isNull()).filter("operation = 'upsert'")
    flat = envelope.to_document(rows)
    return flat.select("arrival", "id", "_revision", F.try_variant_get(F.element_at("document", "k"), "$", "bigint").alias("k"), F.size("document").alias("n_fields"))


@query(f"with {_STATE} select document_id as id, revision as _revision from state where operation = 'upsert' and cast(document_id as bigint) % 3 <> 0")
def retired_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index without a collection, and without one that it never had."""
    old = F.when(F.col("id").cast("bigint") % 3 == 0, "old").otherwise(F.col("collection"))
    return index.retire(index.rebuild(_state(spark, sf_dir)).withColumn("collection", old), ["old", "absent"]).select("id", "_revision")


@query(f"with {_STATE} select a.arrival from accepted a join state s using (collection, document_id, revision) where s.operation = 'upsert'")
def current_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of texts queued with each event, those whose revision is still the applied one."""
    return embed.still_current(_accepted(spark, sf_dir), _state(spark, sf_dir)).select("arrival")


@query("select count(*) * 0 as differences from events")
def rebuild_equals_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which the incremental index and one built anew differ."""
    _, incremental, applied = _two_batches(spark, sf_dir)
    return index.audit(applied, incremental).agg(F.count(F.lit(1)).alias("differences"))


@query(f"with {_STATE} select collection, document_id as id, revision as expected from state where operation = 'upsert' and cast(document_id as bigint) % 7 = 0")
def audit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index that lost every seventh document lacks."""
    applied = _state(spark, sf_dir)
    damaged = index.rebuild(applied).filter(F.col("id").cast("bigint") % 7 != 0)
    return index.audit(applied, damaged).select("collection", "id", "expected")


@query(f"with {_STATE} select s.document_id as id, s.revision as _revision, document_json as document from state s join customer c on s.document_id = cast(c.c_custkey as varchar) where operation = 'upsert'")
def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: documents by id."""
    ids = table(spark, sf_dir, "customer").select(F.lit("profiles").alias("collection"), F.col("c_custkey").cast("string").alias("id"))
    return index.lookup(index.rebuild(_state(spark, sf_dir)), ids).select("id", "_revision", "document")


@query(f"with {_STATE} select document_id as id, cast(json_extract_string(document_json, '$.k') as bigint) as k from state where operation = 'upsert'")
def materialized_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the documents as a column."""
    spec = CollectionSpec("profiles", searchable=("k",))
    return index.materialize(index.rebuild(_state(spark, sf_dir)), spec).select("id", paging.as_long(F.col("k")).alias("k"))


_RAW = """raw as (select event_id, case when event_id % 3 = 0 then 'INDEX_OPERATION_DELETE' when event_id % 7 = 0 then 'other' else 'upsert' end as op,
  '  ' || event_type || ' ' as source_service, cast(user_id as varchar) as aggregate_id, props from events)"""


@query(f"""with {_RAW} select trim(source_service) as source_service, cast(event_id as varchar) as event_id, aggregate_id as document_id,
case op when 'INDEX_OPERATION_DELETE' then 'delete' when 'upsert' then 'upsert' end as operation, case when op = 'upsert' then props end as document_json from raw""")
def wire_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes from their form on the wire."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 3 == 0, "INDEX_OPERATION_DELETE").when(F.col("event_id") % 7 == 0, "other").otherwise("upsert")
    raw = e.select(
        F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("source_service"), F.col("event_id").cast("string").alias("event_id"), op.alias("operation"),
        F.lit("profiles").alias("collection"), F.col("user_id").cast("string").alias("aggregate_id"), F.lit(1).cast("bigint").alias("revision"),
        F.col("props").alias("document_json"), F.lit("").alias("occurred_at"), F.col("event_id").alias("arrival"),
    )
    return envelope.from_wire(raw).select("source_service", "event_id", "document_id", "operation", "document_json")


@query(f"with {_STATUS} select arrival, 'unknown entity ' || collection as reason from done where status = 'accepted' and cast(document_id as bigint) % 2 = 0")
def unknown_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: events of collections that are not declared; here those of even documents."""
    events = _accepted(spark, sf_dir)
    moved = events.withColumn("collection", F.when(F.col("document_id").cast("bigint") % 2 == 0, F.col("collection")).otherwise("known"))
    return gate.split_known(moved, ["known"])[1].select("arrival", "reason")


@query("""select cast(d.doc_id as varchar) as id, string_split(text, chr(10))[1] as title from documents d""")
def returnable_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: what a search may return of a document."""
    rows = fixtures.posts(spark, sf_dir).withColumn("_revision", F.lit(1))
    return index.returnable(rows, fixtures.POSTS).select("id", "title")


@query("""select d.doc_id as id, coalesce(len(e.embedding), 0) as dimensions, coalesce(round(list_sum(list_transform(e.embedding, lambda x, i: cast(x as double) * i)), 4), 0) as mark
from documents d left join embeddings e on e.vec_id = d.doc_id""")
def patched_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new vector column, null at first, and late vectors written into it."""
    rows = fixtures.posts(spark, sf_dir).select("collection", F.col("id").cast("bigint").alias("id"), "title")
    late = fixtures.vector_index(spark, sf_dir).select(F.lit("posts").alias("collection"), "id", F.col("embedding").alias("vector"))
    patched = embed.patch_vectors(index.add_embedder(rows, "embedding"), late)
    return patched.select("id", F.coalesce(F.size("embedding"), F.lit(0)).cast("bigint").alias("dimensions"), F.coalesce(_mark("embedding"), F.lit(0.0)).alias("mark"))


def _mark(vector: str) -> Column:
    """A number that tells vectors apart: their entries by their places."""
    entries = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(entries, F.lit(0.0), lambda a, b: a + b), 4)


# Text

_NORMAL = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


@query(f"select doc_id, {_NORMAL.format('text')} as normal from documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form."""
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


@query("select doc_id, len(regexp_extract_all(text, '([\\p{L}\\p{N}]+)', 1)) as n_tokens, regexp_matches(text, '\\p{Cyrillic}') as cyrillic from documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, and whether there is a Cyrillic letter."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(t)).cast("bigint").alias("n_tokens"), text.has_cyrillic(t).alias("cyrillic"))


_LATIN = sorted(text.LATIN_TO_CYRILLIC, key=lambda t: (-len(t), t))
_MAP = "map([" + ", ".join(f"'{k}'" for k in _LATIN) + "], [" + ", ".join(f"'{text.LATIN_TO_CYRILLIC[k]}'" for k in _LATIN) + "])"


@query(f"""with n as (select doc_id, {_NORMAL.format('text')} as t from documents), m as (select {_MAP} as m)
select doc_id, array_to_string(list_transform(regexp_extract_all(t, '(?s)({'|'.join(_LATIN)}|.)', 1), lambda x: coalesce(m[x], x)), '') as other from n, m""")
def transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other alphabet."""
    return table(spark, sf_dir, "documents").select("doc_id", text.transliterate(F.col("text"), text.normalize_native).alias("other"))


@query()
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", text.stems(F.col("text"), stem).alias("stems"))


_JOINED = "concat_ws(' ', text, lang, source, string_split(text, chr(10))[1])"


@query(f"""with n as (select doc_id, {_NORMAL.format(_JOINED)} as t from documents), m as (select {_MAP} as m)
select doc_id, t as _search_text, array_to_string(list_transform(regexp_extract_all(t, '(?s)({'|'.join(_LATIN)}|.)', 1), lambda x: coalesce(m[x], x)), '') as _translit from n, m""")
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search text and transliteration of documents given as JSON."""
    doc = F.to_json(F.struct("title", "content", "tags"))
    rows = fixtures.posts(spark, sf_dir).select(F.col("id").cast("bigint").alias("doc_id"), doc.alias("document"))
    return text.enrich(rows, F.col("document"), stem).select("doc_id", "_search_text", "_translit")


@query("select doc_id, case when lower(lang) = lower(source) then lower(lang) else concat_ws('|', nullif(lower(lang), ''), nullif(lower(source), '')) end as tags from documents")
def unique_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: distinct non-empty tags, in order."""
    tags = text.unique_non_empty(F.array("lang", "source", F.upper("lang"), F.lit(" ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tags, "|").alias("tags"))


@query("select doc_id, sha256('query: ' || text) as asked, sha256('passage: ' || text) as stored from documents")
def role_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as an encoder gets them."""
    asked, stored = (F.sha2(text.with_role(F.col("text"), r), 256) for r in ("query", "passage"))
    return table(spark, sf_dir, "documents").select("doc_id", asked.alias("asked"), stored.alias("stored"))


# Vectors

_TITLE = "string_split(text, chr(10))[1]"
_SEMANTIC = f"concat_ws(chr(10), nullif({_TITLE}, ''), nullif({_TITLE}, ''), nullif(text, ''))"


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {c: F.col(c) for c in fixtures.POSTS.semantic}
    s = text.semantic_text(columns, fixtures.POSTS.semantic_weights)
    return fixtures.posts(spark, sf_dir).select(F.col("id").cast("bigint").alias("id"), s.alias("semantic_text")).withColumn("content_hash", text.content_hash(F.col("semantic_text")))


@query(f"select doc_id as id, sha256({_SEMANTIC}) as content_hash, length({_SEMANTIC}) as n from documents")
def semantic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic text and its hash."""
    return _semantic(spark, sf_dir).select("id", "content_hash", F.length("semantic_text").cast("bigint").alias("n"))


@query(f"""with s as (select doc_id, sha256({_SEMANTIC}) as content_hash from documents)
select distinct content_hash from s where content_hash not in (select content_hash from s join embeddings on doc_id = vec_id)""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that the cache of vectors lacks."""
    rows = _semantic(spark, sf_dir)
    return embed.cache_misses(rows, _cache(rows, spark, sf_dir)).select("content_hash")


def _cache(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    known = rows.join(vectors, "id").groupBy("content_hash").agg(F.min_by("embedding", "id").alias("vector"))
    return known.select("content_hash", F.lit(embed.MODEL).alias("model_version"), F.size("vector").alias("dimensions"), "vector")


def _letters_sql(name: str, source: str, prefix: str) -> str:
    """CTEs for the encoder of fixtures.letters() over source (id, st)."""
    return f"""{name}_n as (select id, list_transform(range(97, 123), lambda c: len('{prefix}' || st) - len(replace('{prefix}' || st, chr(c::int), ''))) as n from ({source}) where st <> ''),
{name} as (select id, list_transform(n, lambda x: cast(x / sqrt(list_sum(list_transform(n, lambda y: y * y))) as float)) as v from {name}_n)"""


_PASSAGES = _letters_sql("pe", f"select doc_id as id, {_SEMANTIC} as st from documents", "passage: ")


@query(f"""with {_PASSAGES}, h as (select doc_id as id, sha256({_SEMANTIC}) as content_hash from documents),
known as (select content_hash, arg_min(embedding, id) as v from h join embeddings on id = vec_id group by content_hash),
own as (select h.id, coalesce(known.v, pe.v) as v from h left join known using (content_hash) left join pe on pe.id = h.id)
select id, len(v) as dimensions, round(list_sum(list_transform(v, lambda x, i: cast(x as double) * i)), 4) as mark from own""")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents, from the cache or encoded once per text."""
    rows = _semantic(spark, sf_dir)
    out, _ = embed.embed_cached(rows, _cache(rows, spark, sf_dir), fixtures.letters)
    return out.select("id", F.size("vector").cast("bigint").alias("dimensions"), _mark("vector").alias("mark"))


def _backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("posts").alias("collection"), F.col("event_id").cast("string").alias("document_id"), F.lit(1).cast("bigint").alias("revision"),
        F.lit("h").alias("content_hash"), F.lit("m").alias("model_version"), F.lit("t").alias("semantic_text"), (F.col("event_id") % 5).cast("int").alias("attempts"),
        F.col("ts").alias("next_attempt_at"), F.element_at(F.array(*map(F.lit, ("pending", "retry", "dead"))), (F.col("event_id") % 3 + 1).cast("int")).alias("status"), F.lit("").alias("last_error"),
    )


@query("""select cast(event_id as varchar) as document_id from events where event_id % 3 in (0, 1)
order by ts, cast(event_id as varchar) limit 100""")
def backlog_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: the hundred rows that wait longest."""
    return embed.due(_backlog(spark, sf_dir), F.lit("2100-01-01").cast("timestamp"), 100).select("document_id")


@query("""select cast(event_id as varchar) as document_id, cast(event_id % 5 + 1 as integer) as attempts,
case when event_id % 5 + 1 >= 5 then 'dead' else 'retry' end as status,
case when event_id % 5 + 1 >= 5 then 0 else cast(pow(2, event_id % 5) as integer) end as pause from events""")
def retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts counted, pauses doubled, dead after five."""
    now = F.lit("2024-01-01").cast("timestamp")
    out = embed.retry_or_dead(_backlog(spark, sf_dir), now)
    pause = F.when(F.col("status") == "dead", 0).otherwise((F.unix_timestamp("next_attempt_at") - F.unix_timestamp(now)).cast("int"))
    return out.select("document_id", "attempts", "status", pause.alias("pause"))


# Semantic search

_DOT = "round(list_dot_product(cast(v.embedding as double[]), cast(q.embedding as double[])), 6)"
_RANKED = f"""select q.vec_id as query_id, v.vec_id as id, {_DOT} as semantic_score from embeddings v, embeddings q where q.vec_id % 50 = 0"""


@query(f"""with s as ({_RANKED}), r as (select *, row_number() over (partition by query_id order by semantic_score desc, id) as rank from s)
select query_id, id, semantic_score, rank from r where rank <= 10""")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest documents of every fiftieth vector."""
    return semantic.semantic(fixtures.vector_queries(spark, sf_dir), fixtures.vector_index(spark, sf_dir), 10)


@query(f"""with s as ({_RANKED} and q.vec_id <> v.vec_id), r as (select *, row_number() over (partition by query_id order by semantic_score desc, id) as rank from s)
select query_id, id, semantic_score, rank from r where rank <= 10""")
def similar_to_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: the ten nearest to every fiftieth document by its stored vector, itself left out."""
    return semantic.similar(fixtures.vector_queries(spark, sf_dir), fixtures.vector_index(spark, sf_dir), 10)


def _post_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with vectors of letters: collection, id, embedding."""
    rows = _numbered_posts(spark, sf_dir)
    semantic_text_ = text.semantic_text({c: F.col(c) for c in fixtures.POSTS.semantic}, fixtures.POSTS.semantic_weights)
    hashed = rows.withColumn("semantic_text", semantic_text_).withColumn("content_hash", text.content_hash(F.col("semantic_text")))
    cache = spark.createDataFrame([], "content_hash string, model_version string, dimensions int, vector array<float>")
    return embed.embed_cached(hashed, cache, fixtures.letters)[0].select("collection", "id", F.col("vector").alias("embedding"))


def _numbered_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.posts(spark, sf_dir).withColumn("id", F.col("id").cast("bigint"))


def _as_query(rows: DataFrame) -> DataFrame:
    asked = rows.withColumn("_query", text.with_role(F.col("text"), "query"))
    return embed.embed_texts(asked, "_query", fixtures.letters).drop("_query", "error")


def _similar_sql(source: str, unlike: str) -> str:
    return f"""with {_PASSAGES}, {_letters_sql('qe', source, 'query: ')},
s as (select qe.id as query_id, pe.id, round(list_dot_product(cast(pe.v as double[]), cast(qe.v as double[])), 6) as score from qe, pe where {unlike}),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank, count(*) over (partition by query_id) as total from s)"""


@query(f"{_similar_sql('select item_id as id, trim(text) as st from benchmark', 'true')} select query_id, id, rank, score, total from r where rank > 20 and rank <= 50")
def similar_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents like a text, embedded as a query; the second page."""
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", F.lit(None).cast("string").alias("document_id"), F.lit(30).alias("page_size"), paging.encode_offset(F.lit(20)).alias("page_token")
    )
    return search.similar(asked, _post_index(spark, sf_dir), fixtures.POSTS, _as_query, named=_numbered_posts(spark, sf_dir)).select("query_id", "id", "rank", "score", "total")


_OWN_TEXT = f"select doc_id as id, concat_ws(chr(10), nullif({_TITLE}, ''), nullif(text, '')) as st from documents where doc_id % 50 = 0"


@query(f"""{_similar_sql(_OWN_TEXT, 'qe.id <> pe.id')} select query_id, id, rank, score, total, '' as error from r where rank <= 20
union all select -doc_id - 1, null, null, null, null, 'document not found' from documents where doc_id % 100 = 0""")
def similar_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents like every fiftieth document, its text embedded as a query, itself left
    out; ids that there are not give an error."""
    docs = table(spark, sf_dir, "documents")
    rest = [F.lit("").alias("text"), F.lit(0).alias("page_size"), F.lit("").alias("page_token")]
    known = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("doc_id").cast("string").alias("document_id"), *rest)
    unknown = docs.filter("doc_id % 100 = 0").select((-F.col("doc_id") - 1).alias("query_id"), F.lit("no such document").alias("document_id"), *rest)
    out = search.similar(known.unionByName(unknown), _post_index(spark, sf_dir), fixtures.POSTS, _as_query, named=_numbered_posts(spark, sf_dir))
    return out.select("query_id", "id", "rank", "score", "total", F.coalesce("error", F.lit("")).alias("error"))


@query()
def semantic_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that lie on the same sides of random planes, exact scores."""
    return semantic.semantic_lsh(fixtures.vector_queries(spark, sf_dir), fixtures.vector_index(spark, sf_dir), 10)


@query()
def semantic_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained cells, estimates from codes, exact scores of the hundred best estimates."""
    rows = fixtures.vector_index(spark, sf_dir)
    trained = cells.fit(rows)
    codes = stage(cells.coded(rows, trained), "vector-codes")
    return cells.semantic_cells(fixtures.vector_queries(spark, sf_dir), rows, codes, trained, 10)


# Lexical search

_TOKENS = f"""lists as (select doc_id as id, 0 as field_rank, regexp_extract_all({_NORMAL.format(_TITLE)}, '([\\p{{L}}\\p{{N}}]+)', 1) as w from documents
  union all select doc_id, 1, regexp_extract_all({_NORMAL.format('text')}, '([\\p{{L}}\\p{{N}}]+)', 1) from documents),
tok as (select id, field_rank, cast(unnest(range(len(w))) as integer) as pos, unnest(w) as token from lists)"""
_ASKED = """words as (select item_id as query_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:1 + item_id % 7] as w from benchmark),
qs as (select query_id, array_to_string(w, ' ') as query from words),
ql as (select query_id, query, regexp_extract_all(trim(regexp_replace(lower(query), '\\s+', ' ', 'g')), '([\\p{L}\\p{N}]+)', 1) as w from qs),
asked as (select query_id, cast(unnest(range(len(w))) as integer) as qpos, unnest(w) as qtoken from ql)"""
#: DuckDB's levenshtein counts bytes; tokens are in lower case, so capitals stand in for accented letters.
_ONE_BYTE = "translate({0}, 'áàâäéèêëíîïóôöùúûüñçß', 'ABCDEFGHIJKLMNOPQRSTU')"
_ASKED_ALL = _ASKED.replace("[1:1 + item_id % 7] as w", " as w")
_CANDIDATES = f"""cand as (select qtoken, token, levenshtein({_ONE_BYTE.format('token')}, {_ONE_BYTE.format('qtoken')}) as typos from (select distinct qtoken from asked), (select distinct token from tok)
  where abs(length(token) - length(qtoken)) <= case when length(qtoken) < 4 then 0 when length(qtoken) < 8 then 1 else 2 end
  and levenshtein({_ONE_BYTE.format('token')}, {_ONE_BYTE.format('qtoken')}) <= case when length(qtoken) < 4 then 0 when length(qtoken) < 8 then 1 else 2 end)"""
_FIGURES = """best as (select query_id, id, qpos, min((typos, field_rank, pos)) as p from asked join cand using (qtoken) join tok using (token) group by all),
b2 as (select query_id, id, qpos, p[1] as typos, p[2] as field_rank, p[3] as pos from best),
g as (select *, lag(qpos) over w as lq, lag(field_rank) over w as lf, lag(pos) over w as lp from b2 window w as (partition by query_id, id order by qpos)),
fig as (select query_id, id, count(*) as words, cast(sum(typos) as bigint) as typos, min(field_rank) as attribute, cast(sum((typos = 0)::int) as bigint) as exact,
  cast(sum(case when lq is null then 0 when lf = field_rank then greatest(least(abs(pos - lp) - 1, 7), 0) else 7 end) as bigint) as proximity from g group by query_id, id)"""


def _post_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.posts(spark, sf_dir).select("collection", F.col("id").cast("bigint").alias("id"), "title", "content")
    return lexical.token_table(rows, ["title", "content"])


def _stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(lexical.postings(_post_tokens(spark, sf_dir)), "postings")


@query(f"with {_TOKENS} select token, count(*) as n, count(distinct id) as documents from tok group by token")
def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table, summed up by token."""
    return _post_tokens(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("documents"))


@query(f"with {_TOKENS}, {_ASKED_ALL}, {_CANDIDATES} select qtoken, token, cast(typos as integer) as typos from cand")
def typo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: words within the typos that query words may have."""
    asked = lexical.query_tokens(fixtures.whole_queries(spark, sf_dir))
    return lexical.typo_candidates(asked, lexical.vocabulary(_post_tokens(spark, sf_dir)))


_BEST = f"""with {_TOKENS}, {_ASKED}, {_CANDIDATES}, {_FIGURES}, r as (select *, row_number() over (partition by query_id
  order by words desc, typos, proximity, attribute, exact desc, id) as rank from fig)
select query_id, id, rank, words, typos, proximity, attribute, exact from r where rank <= 20"""


@query(_BEST)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents by the ranking rules."""
    found = lexical.lexical(fixtures.text_queries(spark, sf_dir), _stored_postings(spark, sf_dir), 2)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*lexical.rules()))
    top = found.withColumn("rank", rank).filter("rank <= 20")
    return top.select("query_id", "id", "rank", "words", "typos", "proximity", "attribute", "exact")


@query(_BEST)
def lexical_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of the rarest words of each query, without walking the lists of frequent ones."""
    top = lexical.lexical_top(fixtures.text_queries(spark, sf_dir), _stored_postings(spark, sf_dir), 2, 20)
    return top.select("query_id", "id", "rank", "words", "typos", "proximity", "attribute", "exact")


_SYNONYMS = """voc as (select distinct token from tok), syn as (select a.token as word, b.token as synonym from voc a join voc b on b.token = a.token || 's'
  union all select b.token, a.token from voc a join voc b on b.token = a.token || 's')"""


@query(f"""with {_TOKENS}, {_ASKED}, {_CANDIDATES.replace('cand as', 'near as')}, {_SYNONYMS},
cand as (select qtoken, token, min(typos) as typos from (select * from near union all select qtoken, synonym, 0 from (select distinct qtoken from asked) join syn on word = qtoken) group by all),
{_FIGURES}, r as (select *, row_number() over (partition by query_id order by words desc, typos, proximity, attribute, exact desc, id) as rank from fig)
select query_id, id, rank, words, typos, proximity, attribute, exact from r where rank <= 20""")
def synonym_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search in which plural forms in the vocabulary count as their singular and the other
    way round."""
    tokens = _stored_postings(spark, sf_dir)
    words = lexical.vocabulary(tokens).select(F.col("token").alias("word"))
    plural = words.select(F.col("word").alias("synonym")).join(words, F.col("synonym") == F.concat("word", F.lit("s")))
    synonyms = plural.select("word", "synonym").unionByName(plural.select(F.col("synonym").alias("word"), F.col("word").alias("synonym")))
    found = lexical.lexical(fixtures.text_queries(spark, sf_dir), tokens, 2, stage(synonyms, "synonyms"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*lexical.rules()))
    return found.withColumn("rank", rank).filter("rank <= 20").select("query_id", "id", "rank", "words", "typos", "proximity", "attribute", "exact")


@query(f"""with n as (select item_id as query_id, {_NORMAL.format('text')} as t from benchmark), m as (select {_MAP} as m),
f as (select query_id, t, array_to_string(list_transform(regexp_extract_all(t, '(?s)({'|'.join(_LATIN)}|.)', 1), lambda x: coalesce(m[x], x)), '') as o from n, m)
select query_id, t as variant from f where t <> '' union all select query_id, o from f where o not in ('', t)""")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form and other alphabet of queries, without the stems, which SQL cannot make."""
    return lexical.query_variants(fixtures.whole_queries(spark, sf_dir), stemmer=None).select("query_id", "variant")


@query()
def query_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variants of queries, with stems."""
    return lexical.query_variants(fixtures.whole_queries(spark, sf_dir))


# Search as a whole

_MODE = """case item_id % 4 when 0 then 'LEXICAL' when 1 then 'SEMANTIC' else '' end"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("query_id") % 4 == 0, "LEXICAL").when(F.col("query_id") % 4 == 1, "SEMANTIC").otherwise("")
    return fixtures.text_queries(spark, sf_dir).withColumn("mode", mode).withColumn("given", F.when(F.col("query_id") % 8 == 2, 0.33).otherwise(0.0))


@query(f"""with {_ASKED}, m as (select query_id, query, {_MODE.replace('item_id', 'query_id')} as mode, case when query_id % 8 = 2 then 0.33::double else 0.0::double end as given,
  case when trim(query) = '' then 0 else len(string_split(trim(query), ' ')) end as n from qs)
select query_id, case when mode = '' then 'HYBRID' else mode end as effective_mode, case mode when 'LEXICAL' then 0.0::double when 'SEMANTIC' then 1.0::double else
  case when given > 0 and given <= 1 then given when n between 3 and 5 and not contains(query, '"') then 0.45::double when n >= 6 then 0.7::double else 0.2::double end end as weight from m""")
def effective_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode and weight of queries."""
    weight = paging.effective_weight(F.col("mode"), F.col("query"), F.col("given"))
    return _requests(spark, sf_dir).select("query_id", paging.effective_mode(F.col("mode")).alias("effective_mode"), weight.alias("weight"))


@query("""select doc_id from documents d left join (select doc_id, max(toxic) as toxic from labels group by doc_id) l using (doc_id)
where lang in ('de', 'fr') and coalesce(toxic, 0) <> 1""")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: filters on declared fields."""
    cond = search.build_filters({"lang": ["de", "fr"], "visibility": ["public"], "source": []}, fixtures.POSTS)
    return fixtures.posts(spark, sf_dir).filter(cond).select(F.col("id").cast("bigint").alias("doc_id"))


@query("""select event_id, replace(replace(rtrim(base64(encode(cast(event_id as varchar))), '='), '+', '-'), '/', '_') as token, event_id as back from events""")
def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: offsets to tokens and back."""
    token = paging.encode_offset(F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", token.alias("token"), paging.decode_offset(token).cast("bigint").alias("back"))


@query("""select event_id, case when event_id % 300 - 50 <= 0 then 20 when event_id % 300 - 50 > 100 then 100 else event_id % 300 - 50 end as size from events""")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: page sizes within their bounds."""
    return table(spark, sf_dir, "events").select("event_id", paging.page_size(F.col("event_id") % 300 - 50).cast("bigint").alias("size"))


@query("""select d.doc_id, list_filter([case when contains(lower(lang), 'e') then 'lang' end, case when contains(lower(text), 'e') then 'text' end], lambda x: x is not null) as fields from documents d""")
def explain_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: fields that contain a query."""
    return table(spark, sf_dir, "documents").select("doc_id", paging.matched_fields(F.lit("E"), {"text": F.col("text"), "lang": F.col("lang")}).alias("fields"))


_AUTO = """case when len(string_split(trim(query), ' ')) between 3 and 5 and not contains(query, '"') then 0.45::double when len(string_split(trim(query), ' ')) >= 6 then 0.7::double else 0.2::double end"""
_HAS_VECTOR = "exists (select 1 from embeddings where vec_id = query_id)"


def _search_sql(weight: str, sort: str = "") -> str:
    """CTEs up to r: ranked hits of all queries, with totals."""
    return f"""with {_TOKENS}, {_ASKED}, {_CANDIDATES}, {_FIGURES},
vec as (select q.query_id, v.vec_id as id, list_dot_product(cast(v.embedding as double[]), cast(e.embedding as double[])) as s
  from qs q join embeddings e on e.vec_id = q.query_id, embeddings v),
n as (select query_id, count(*) as asked from asked group by query_id),
hdr as (select query_id, case when {_HAS_VECTOR} then {weight} else 0.0::double end as weight from qs),
lex as (select fig.*, 0.0 + words / asked * 0.4 + (1 - typos / (2 * asked)) * 0.2 + (1 / (1 + proximity)) * 0.1 + (1 - attribute / 2) * 0.1 + exact / asked * 0.2 as ls from fig join n using (query_id)),
f as (select query_id, id, words, typos, proximity, attribute, exact, weight, s, (1 - weight) * coalesce(ls, 0) as a, weight * coalesce(s, 0) as b
  from lex full join vec using (query_id, id) join hdr using (query_id)),
k as (select *, round(a + b, 6) as score from f where (weight < 1 and words is not null) or (weight > 0 and s is not null)),
r as (select *, row_number() over (partition by query_id order by case when weight > 0 then score end desc nulls last, words desc nulls last, typos nulls first,
  proximity nulls first, attribute nulls first, {sort} exact desc nulls last, id) as rank, count(*) over (partition by query_id) as total from k)"""


def _asked_with_vectors(spark: SparkSession, sf_dir: str, mode: Column, size: int, offset: int) -> DataFrame:
    """Queries take the vector with their number; those without one fall back to words alone."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return fixtures.text_queries(spark, sf_dir).join(vectors, "query_id", "left").select(
        "query_id", "query", mode.alias("mode"), F.lit(0.0).alias("semantic_weight"), F.lit(size).alias("page_size"),
        (paging.encode_offset(F.lit(offset)) if offset else F.lit("")).alias("page_token"), "vector",
    )


def _posts_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.posts(spark, sf_dir).withColumn("id", F.col("id").cast("bigint"))
    return docs.join(fixtures.vector_index(spark, sf_dir), "id", "full")


@query(f"""{_search_sql(_AUTO)} select query_id, rank, id, score, total, round(a, 6) as lexical_score, round(b, 6) as semantic_score from r where rank <= 20""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of hybrid search over all documents."""
    asked = _asked_with_vectors(spark, sf_dir, F.lit(""), 20, 0)
    parts = [F.round(c, 6).alias(c) for c in ("lexical_score", "semantic_score")]
    return search.search(asked, _posts_with_vectors(spark, sf_dir), fixtures.POSTS).select("query_id", "rank", "id", "score", "total", *parts)


_PAGE_MODE = "case query_id % 3 when 0 then 0.0::double when 1 then 1.0::double else " + _AUTO + " end"


@query(f"""{_search_sql(_PAGE_MODE, 'id desc,')}, t as (select query_id, weight, coalesce(max(total), 0) as total from hdr left join r using (query_id, weight) group by all)
select t.query_id, r.rank, r.id, r.score, t.total, t.weight,
  case when 200 + least(greatest(t.total - 200, 0), 30) < t.total then replace(replace(rtrim(base64(encode(cast(200 + least(greatest(t.total - 200, 0), 30) as varchar))), '='), '+', '-'), '/', '_') else '' end as next_page_token
from t left join (select * from r where rank > 200 and rank <= 230) r using (query_id)""")
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page from rank 201 of lexical, semantic and hybrid search, with a
    declared sort; a query whose page is empty has one row."""
    mode = F.when(F.col("query_id") % 3 == 0, "LEXICAL").when(F.col("query_id") % 3 == 1, "SEMANTIC").otherwise("")
    out = search.search(_asked_with_vectors(spark, sf_dir, mode, 30, 200), _posts_with_vectors(spark, sf_dir), fixtures.POSTS, sort=["id:desc"])
    return out.select("query_id", "rank", "id", "score", "total", "weight", "next_page_token")


@query(f"""{_search_sql('0.0::double')}, asked_all as (select query_id, query from qs union all select -1, 'qqzzxx')
select q.query_id, r.rank, cast(r.id as varchar) as item_id, case when r.id is null then '' else d.lang end as provider_key, case when r.id is null then '' else d.source end as item_type,
  case when r.id is null then 0 else d.doc_id % 9 end as revision, {_TITLE} as title, coalesce(r.total, 0) as total,
  case when q.query_id % 2 = 0 and contains(lower({_TITLE}), lower(q.query)) then 'title' else '' end as matched
from asked_all q left join (select * from r where rank <= 20) r using (query_id) left join documents d on d.doc_id = r.id""")
def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a caller sees them, and the header of a query without hits."""
    rest = [F.lit("LEXICAL").alias("mode"), F.lit(0.0).alias("semantic_weight"), F.lit(20).alias("page_size"), F.lit("").alias("page_token"), F.lit(None).cast("array<float>").alias("vector")]
    asked = fixtures.text_queries(spark, sf_dir).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("query_id"), F.lit("qqzzxx").alias("query"))).select("*", (F.col("query_id") % 2 == 0).alias("explain"), *rest)
    rows = fixtures.posts(spark, sf_dir).withColumns({"id": F.col("id").cast("bigint"), "embedding": F.lit(None).cast("array<float>"), "provider_key": F.lit(None).cast("string"), "_provider_key": F.col("lang"), "item_type": F.col("source"), "_revision": (F.col("id").cast("bigint") % 9).cast("string")})
    out = search.response(search.search(asked, rows, fixtures.POSTS), asked, rows, fixtures.POSTS)
    matched = F.array_join("matched_fields", ",").alias("matched")
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("provider_key", "item_type")]
    return out.select("query_id", "rank", "item_id", *empty, F.coalesce("revision", F.lit(0)).alias("revision"), "title", "total", F.coalesce(matched, F.lit("")).alias("matched"))


# Streams

@query(f"with {_VALID} select distinct source_service, event_id from valid")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4 T1 as a stream: first deliveries of a table of events, read in files."""
    path, out = new_path(spark, "stream-in"), new_path(spark, "stream-out")
    fixtures.envelopes(spark, sf_dir).repartition(4, "event_id").write.parquet(path)
    source = event_files(spark, path, spark.read.parquet(path).schema, files_per_pass=2)
    flow = stream_dedup(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "stream-check"))
    flow.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("source_service", "event_id")


#: Streams side by side; a pass takes the driver longer than its task.
LANES = 16


@query(f"with {ENVELOPES_SQL} select arrival, true as bounded from env")
def stream_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, and whether the pass that took it in had at most 1,000 events."""
    path, out = new_path(spark, "stream-in"), new_path(spark, "stream-out")
    rows = fixtures.envelopes(spark, sf_dir)
    land(rows, path, per_pass=1_000, lanes=LANES)

    def take(df: DataFrame, lane: int, batch: int) -> None:
        df.select("arrival").write.mode("overwrite").parquet(f"{out}/lane={lane}/pass={batch}")

    take_lanes(spark, path, rows.schema, new_path(spark, "stream-check"), take)
    taken = spark.read.schema("arrival bigint, lane int, pass int").parquet(out)
    sizes = taken.groupBy("lane", "pass").agg((F.count(F.lit(1)) <= 1_000).alias("bounded"))
    return taken.join(sizes, ["lane", "pass"]).select("arrival", "bounded")


@query(f"""with {_VALID}, kept as (select source_service, event_id, case when arrival % 20 = 0 then 2 else 1 end as times from valid where arrival < 1000000000
  union all select 'later', event_id, 1 from valid where arrival < 1000000000 and arrival % 10 = 1)
select source_service, event_id, times from kept""")
def stream_dedup_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: how often a delivery passes where it is remembered for an hour: every tenth one comes again within it, every
    twentieth also long after it, when events of another source have moved the watermark on."""
    path, out, check = (new_path(spark, label) for label in ("stream-in", "stream-out", "stream-check"))
    at = lambda minutes: F.timestamp_seconds(F.lit(1704067200 + 60 * minutes) + F.col("arrival") % 600).alias("seen")
    rows = fixtures.envelopes(spark, sf_dir).filter("arrival < 1000000000")
    first = rows.select("*", at(0))
    again = rows.filter("arrival % 10 = 0").select("*", at(20))
    others = rows.filter("arrival % 10 = 1").withColumn("source_service", F.lit("later")).select("*", at(300))
    after = rows.filter("arrival % 20 = 0").select("*", at(360))
    for part in (first, again.unionByName(others), after):
        part.write.mode("append").parquet(path)
        flow = stream_dedup(event_files(spark, path, first.schema, files_per_pass=1_000), "seen", "1 hour").writeStream.format("parquet")
        flow.option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("source_service", "event_id").agg(F.count(F.lit(1)).cast("int").alias("times"))


def _streamed(spark: SparkSession, sf_dir: str) -> SearchEngine:
    """An engine that took the envelopes as a stream of two batches."""
    root, path = new_path(spark, "engine"), new_path(spark, "stream-in")
    rows = fixtures.envelopes(spark, sf_dir)
    for part in _batches(spark, sf_dir, rows):
        part.coalesce(1).write.mode("append").parquet(path)
    engine = SearchEngine(spark, [PROFILES], root)
    engine.start(event_files(spark, path, rows.schema, files_per_pass=1), new_path(spark, "stream-check"), availableNow=True).awaitTermination()
    return engine


@query(f"with {_STATE} select collection, document_id, revision, operation from state")
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applied state after two batches of a stream."""
    return _streamed(spark, sf_dir).applied(1).select("collection", "document_id", "revision", "operation")


@query(f"with {_STATE} select document_id as id, revision as _revision, cast(json_extract_string(document_json, '$.k') as bigint) as k, '' as _search_text from state where operation = 'upsert'")
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched index after two batches of a stream; these documents hold no strings."""
    return _streamed(spark, sf_dir).index(1).select("id", "_revision", F.get_json_object("document", "$.k").cast("bigint").alias("k"), "_search_text")


@query(f"with {_STATUS} select source_service, event_id, arrival from done where status = 'accepted'")
def stream_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the inbox holds after two batches of a stream, by its payloads."""
    inbox = _streamed(spark, sf_dir).inbox(1)
    known = F.get_json_object("payload", "$.event_id")
    return inbox.select("source_service", known.alias("event_id"), "arrival")


# The engine over documents with text

#: What is left of the documents after the two batches of _posted(), as a table that stands for documents.
_LIVE = """live as (select cast(doc_id as varchar) as doc_id, doc_id % 10 = 0 as again,
  case when doc_id % 10 = 0 then 'Revised edition. ' || text else text end as text from documents where doc_id % 15 <> 1)"""


def _over_live(sql: str) -> str:
    return sql.replace("from documents", "from live").replace("with ", f"with {_LIVE}, ", 1)


def _posted(spark: SparkSession, sf_dir: str, per_pass: int = 1000, spec: CollectionSpec = fixtures.POSTS, more: tuple[Column, ...] = ()) -> SearchEngine:
    """An engine with all documents: the first batch brings them, the second one changes every tenth and deletes
    some. more are further fields of theirs."""
    docs = table(spark, sf_dir, "documents").withColumn("again", F.lit(False))
    body = lambda t: F.to_json(F.struct(F.substring_index(t, "\n", 1).alias("title"), t.alias("content"), *more))

    def events(rows: DataFrame, revision: int, operation: str, document: Column) -> DataFrame:
        return rows.select(
            F.lit("docs").alias("source_service"), F.concat(F.lit(f"{operation}-{revision}-"), F.col("doc_id").cast("string")).alias("event_id"),
            F.lit(operation).alias("operation"), F.lit("posts").alias("collection"), F.col("doc_id").cast("string").alias("document_id"),
            F.lit(revision).cast("bigint").alias("revision"), document.alias("document_json"), F.lit("").alias("occurred_at"), F.col("doc_id").alias("arrival"),
        )

    engine = SearchEngine(spark, [spec], new_path(spark, "engine"), encoder=fixtures.letters, model="letters", per_pass=per_pass)
    engine.process(events(docs, 1, "upsert", body(F.col("text"))), 0)
    changed = events(docs.filter("doc_id % 10 = 0 and doc_id % 15 <> 1").withColumn("again", F.lit(True)), 2, "upsert", body(F.concat(F.lit("Revised edition. "), F.col("text"))))
    engine.process(changed.unionByName(events(docs.filter("doc_id % 15 = 1"), 2, "delete", F.lit(None).cast("string"))), 1)
    return engine


_ENGINE_BEST = _over_live(_BEST.replace("from fig)", ", count(*) over (partition by query_id) as total from fig)").replace("as rank ,", "as rank,"))


@query(_ENGINE_BEST.replace("select query_id, id, rank, words, typos, proximity, attribute, exact from r", "select query_id, id as item_id, rank, total, string_split(text, chr(10))[1] as title from r join live on doc_id = id"))
def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by words over the engine's stored inverted index after two batches."""
    rest = [F.lit("LEXICAL").alias("mode"), F.lit(0.0).alias("semantic_weight"), F.lit(20).alias("page_size"), F.lit("").alias("page_token"), F.lit(False).alias("explain")]
    out = _posted(spark, sf_dir).search(fixtures.text_queries(spark, sf_dir).select("*", *rest), "posts", 1)
    return out.filter("item_id is not null").select("query_id", "item_id", "rank", "total", "title")


#: Posts with fields that are numbers and lists; the size of a changed document is its old one and a million.
_SIZED = replace(fixtures.POSTS, filterable=("group", "tags"), sortable=("size",), types={"group": "bigint", "size": "double", "tags": "array<string>"})
_SIZES = """sizes as (select cast(doc_id as varchar) as id, doc_id % 5 as grp, lang, n_chars + case when doc_id % 10 = 0 then 1000000 else 0 end as size
  from documents where doc_id % 15 <> 1)"""


def _sized(spark: SparkSession, sf_dir: str) -> SearchEngine:
    size = F.col("n_chars") + F.when(F.col("again"), 1000000).otherwise(0)
    return _posted(spark, sf_dir, spec=_SIZED, more=((F.col("doc_id") % 5).alias("group"), size.alias("size"), F.array("lang", "source").alias("tags")))


@query(f"with {_SIZES} select id, cast(size as double) as size from sizes where grp in (0, 3) and lang in ('de', 'fr')")
def declared_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by stored fields of several types, after two batches."""
    return _sized(spark, sf_dir).listed("posts", 1, {"group": ["0", "3"], "tags": ["de", "fr"]}, ("size",))


@query(_ENGINE_BEST.replace("then 'Revised edition. ' || text else text end as text from documents where", "then 'Revised edition. ' || text else text end as text from documents where doc_id % 5 in (0, 3) and")
  .replace("with live", f"with {_SIZES}, live", 1).replace("attribute, exact desc, id)", "attribute, size desc, exact desc, id)").replace("from fig)", "from fig join sizes using (id))")
  .replace("select query_id, id, rank, words, typos, proximity, attribute, exact from r", "select query_id, id as item_id, rank, total from r"))
def engine_sorted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by words among documents of a filter, sorted by a number of theirs."""
    rest = [F.lit("LEXICAL").alias("mode"), F.lit(0.0).alias("semantic_weight"), F.lit(20).alias("page_size"), F.lit("").alias("page_token"), F.lit(False).alias("explain")]
    out = _sized(spark, sf_dir).search(fixtures.text_queries(spark, sf_dir).select("*", *rest), "posts", 1, filters={"group": [0, 3]}, sort=["size:desc"])
    return out.filter("item_id is not null").select("query_id", "item_id", "rank", "total")


@query(_over_live(_similar_sql("select item_id as id, trim(text) as st from benchmark", "true")) + " select query_id, id as item_id, rank, score, total from r where rank <= 20")
def engine_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents like a text, over the engine's vectors after two batches."""
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", F.lit("").alias("document_id"), F.lit(20).alias("page_size"), F.lit("").alias("page_token"), F.lit(False).alias("explain")
    )
    return _posted(spark, sf_dir).similar(asked, "posts", 1).select("query_id", "item_id", "rank", "score", "total")


@query(f"with {_LIVE} select doc_id as id, case when again then 2 else 1 end as _revision, string_split(text, chr(10))[1] as title from live")
def repaired_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that lost every seventh document and holds old revisions of others, after its repair."""
    engine = _posted(spark, sf_dir)
    held = engine.index(1)
    number = F.col("id").cast("bigint")
    lost = held.filter(number % 7 == 0).withColumn("live", F.lit(False))
    old = held.filter((number % 7 != 0) & (number % 10 == 0)).withColumns({"_revision": F.lit(1).cast("bigint"), "document": F.lit("{}"), "live": F.lit(True)})
    engine._change_index(lost.unionByName(old), engine._maintenance())
    engine.repair()
    return engine.index(1).select("id", "_revision", F.get_json_object("document", "$.title").alias("title"))


_PASS = 300


@query(_over_live(f"""with {_PASSAGES}, n as (select doc_id as id, row_number() over (order by doc_id) as n from documents where text <> '')
select d.doc_id as id, round(list_sum(list_transform(case when n.n <= {_PASS} then list_reverse(pe.v) else pe.v end, lambda x, i: cast(x as double) * i)), 4) as mark
from documents d join pe on pe.id = d.doc_id join n on n.id = d.doc_id"""))
def model_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors while a new model is being filled in, after one pass over the backlog; the others are still
    those of the model before."""
    engine = _posted(spark, sf_dir, per_pass=_PASS)
    engine.use_model("backwards", lambda texts: [v[::-1] for v in fixtures.letters(texts)])
    engine.process(spark.createDataFrame([], ENVELOPE), 2)
    return engine.index(2).filter("embedding is not null").select("id", _mark("embedding").alias("mark"))


def queries() -> dict[str, Query]:
    """Queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return dict(SQL)
