"""The engine: events in, index out, batch by batch.

State lies under a root folder, in tables that grow by the rows that each batch changes (state). A
batch takes its events in, decides on them by what is applied to their documents, enriches and
embeds the documents that change, writes the places of their words to the inverted index, and tries
texts again whose embedding failed before. A batch that runs again writes the same.

Decisions are made on rows without their documents, which are told apart by a number (_row); documents are
read again from the staged events where they are written, and are not shuffled but where very many rows
of a batch count and very many do not.

Batch b is version b * STRIDE of every table. Maintenance (retiring a collection, repairs, a new model)
takes place between batches, in the versions after the newest batch, so it collides with no batch, and
whatever is read as of that batch holds it.

A search reads the vocabulary of a collection, the buckets of the inverted index in which the words
asked lie, and, where a query has a semantic part, vectors; stored documents are only read for the
hits of its pages. Fields that are declared for filters and sorts are stored by type, a table for each
collection, so that a filter reaches its files.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from searchspark.functions.envelope import canonical_payload, decode_payload, digest, reject_reason
from searchspark.functions.stemmer import stem
from searchspark.functions.text import all_text, content_hash, enrich, normalize, semantic_text, spelled_otherwise, with_role
from searchspark.operators import embed, gate, index, ingest, lexical
from searchspark.operators import search as searching
from searchspark.plans.schemas import APPLIED, BACKLOG, CACHE, INBOX, INDEX, POSTINGS, STORED_INDEX, WORDS
from searchspark.plans.spec import ALL, CollectionSpec, by_name
from searchspark.plans.staging import SMALL, few, passing, release, stage
from searchspark.streaming.state import KEPT, ChangeLog

#: Versions of a table from one batch to the next.
STRIDE = 1_000


@dataclass
class ApplyOut:
    """decisions on events, the applied state of their documents, the index of these, refused events."""

    decisions: DataFrame
    applied: DataFrame
    index: DataFrame
    rejected: DataFrame


def apply(events: DataFrame, applied: DataFrame, specs: list[CollectionSpec]) -> ApplyOut:
    """Decide on valid, deduplicated events and work out the state after them. applied need only hold
    the documents that the events are about."""
    known, unknown = gate.split_known(events, [*by_name(specs)])
    decisions = stage(gate.decide(known, applied), "decisions")
    conflicts = decisions.filter("decision = 'conflict'").withColumn("reason", F.lit(gate.CONFLICT))
    rejected = ingest.dead_letters(conflicts, attempts=5, stage="apply").unionByName(
        ingest.dead_letters(unknown, attempts=5, stage="apply")
    )
    state = gate.current_state(decisions, applied)
    return ApplyOut(decisions, state, index.rebuild(state), rejected)


@dataclass
class SearchEngine:
    """State of some collections under a root folder.

    encoder embeds lists of texts; without one, words are hashed. stemmer and transliteration switch the
    enrichment. per_pass bounds the rows of the embedding backlog that one batch tries again.
    """

    spark: SparkSession
    specs: list[CollectionSpec]
    root: str
    encoder: embed.Encoder | None = None
    model: str = embed.MODEL
    stemmer: Callable[[str], str] | None = stem
    transliteration: bool = True
    per_pass: int = 1000
    now: Callable[[], F.Column] = field(default=F.current_timestamp)

    def __post_init__(self) -> None:
        self.root = self.root.rstrip("/")
        self._turn = Lock()
        log = lambda name, key, schema, **dealt: ChangeLog(self.spark, self.root, name, key, schema, **dealt)
        self._inbox = log("inbox", ingest.DELIVERY, INBOX, wide=True)
        self._applied = log("applied", gate.DOCUMENT, APPLIED, wide=True)
        self._index = log("index", index.KEY, STORED_INDEX, wide=True)
        self._cache = log("cache", ["content_hash", "model_version"], CACHE)
        self._backlog = log("backlog", embed.BACKLOG_KEY, BACKLOG)
        # A frequent word has an entry for most documents: its list is spread over some buckets.
        self._postings = log("postings", ["collection", "token", "id"], POSTINGS, dealt_by=["collection", "token"], spread=4, wide=True)
        self._words = log("words", ["collection", "token"], WORDS)
        # A collection whose declared fields change has another table of them.
        declared = {s.name: s.declared() for s in self.specs if s.declared()}
        mark = lambda fields: hashlib.sha256(json.dumps([*fields.items()]).encode()).hexdigest()[:12]
        columns = lambda fields: "".join(f", {c} {fields[f]}" for f, c in index.stored_names(fields).items())
        self._fields = {n: log(f"fields/{quote(n, safe='')}/{mark(f)}", ["id"], "id string" + columns(f)) for n, f in declared.items()}
        self._logs = (self._inbox, self._applied, self._index, self._cache, self._backlog, self._postings, self._words, *self._fields.values())

    def inbox(self, batch: int) -> DataFrame:
        """Deliveries accepted up to a batch, with their payloads."""
        return self._inbox.latest(_after(batch))

    def applied(self, batch: int) -> DataFrame:
        """The applied state after a batch, deletes included."""
        return self._applied.latest(_after(batch))

    def index(self, batch: int) -> DataFrame:
        """The index after a batch: live documents, enriched, with vectors."""
        return self._whole(self._index.latest(_after(batch)))

    def _whole(self, rows: DataFrame) -> DataFrame:
        """Stored rows of the index with the columns that follow from them."""
        other = spelled_otherwise(F.col("_search_text")) if self.transliteration else F.lit(None).cast("string")
        return rows.withColumns({"_translit": other, "semantic_text": self._semantic_text()}).select(*(c.split()[0] for c in INDEX.split(", ")))

    def backlog(self, batch: int) -> DataFrame:
        """Texts whose embedding failed, after a batch."""
        return self._backlog.latest(_after(batch))

    def postings(self, batch: int) -> DataFrame:
        """The inverted index after a batch."""
        return self._postings.latest(_after(batch))

    def newest(self) -> int:
        """The newest batch, -1 before the first."""
        return max((v // STRIDE for v in self._applied.versions()), default=-1)

    def _maintenance(self) -> int:
        """The next version of maintenance after the newest batch."""
        batch = self.newest()
        if batch < 0:
            raise ValueError("there is no batch yet")
        taken = [v for log in self._logs for v in log.versions() if batch * STRIDE <= v < (batch + 1) * STRIDE]
        if max(taken) == _after(batch):
            raise ValueError(f"batch {batch} has no room for more maintenance")
        return max(taken) + 1

    def _semantic_text(self) -> F.Column:
        """The text of a document that is embedded, by its collection; empty where there is none."""
        def of(spec: CollectionSpec) -> F.Column:
            return semantic_text({f: _string(f) for f in spec.semantic}, spec.semantic_weights)

        known = [s for s in by_name(self.specs).values() if s.semantic and s.embedder]
        return F.coalesce(reduce(lambda c, s: c.when(F.col("collection") == s.name, of(s)), known, F.when(F.lit(False), "")), F.lit(""))

    def _entries(self, live: DataFrame) -> DataFrame:
        """Rows of the index (index.entries()) enriched, without vectors yet."""
        rich = enrich(live, F.col("document"), self.stemmer, False).drop("_translit")
        return rich if "content_hash" in live.columns else rich.withColumn("content_hash", content_hash(self._semantic_text()))

    def process(self, events: DataFrame, batch: int) -> None:
        """One batch. Batches are numbered from 0."""
        with self._turn, passing(self.spark, events.sparkSession):
            marked = events.withColumns({"reason": reject_reason(), "digest": digest(), "_row": F.monotonically_increasing_id()})
            self._process(stage(marked, "engine-events"), batch)

    def _process(self, events: DataFrame, batch: int) -> None:
        version = batch * STRIDE
        bare = events.drop("document_json")
        judged = stage(ingest.judged(bare, self._inbox.of(version - 1, bare, [])), "engine-judged")
        n = judged.count()
        accepted = judged.filter("status = 'accepted'").drop("reason", "status")
        taken = _rows(events, accepted, n)
        self._inbox.write(taken.select(*ingest.DELIVERY, canonical_payload().alias("payload"), "arrival"), version)
        known, unknown = gate.split_known(accepted, [*by_name(self.specs)])
        held = self._applied.of(version - 1, known, ["revision", "digest"])
        decisions = stage(gate.decide(known, held), "engine-decisions")
        refused = [
            (judged.filter("status = 'rejected'"), 0, None),
            (decisions.filter("decision = 'conflict'").withColumn("reason", F.lit(gate.CONFLICT)), 5, "apply"),
            (unknown, 5, "apply"),
        ]
        letters = (ingest.dead_letters(events.drop("reason").join(few(rows.select("_row", "reason")), "_row"), tries, where) for rows, tries, where in refused)
        reduce(DataFrame.unionByName, letters).write.mode("overwrite").parquet(f"{self.root}/rejected/batch_id={batch}")
        newest = F.max_by("_row", F.struct("revision", -F.col("arrival"))).alias("_row")
        won = stage(decisions.filter("decision = 'new'").groupBy(*gate.DOCUMENT).agg(newest).select("_row"), "engine-won")
        state = _rows(events, won, n)
        changed = stage(bare.join(few(won), "_row", "left_semi").select(*gate.DOCUMENT, "revision", "operation", "_row"), "engine-changed")
        live = index.entries(state).withColumn("live", F.lit(True))
        gone = changed.filter("operation = 'delete'").select("collection", F.col("document_id").alias("id"), F.lit(False).alias("live"))
        self._post(live.unionByName(gone, allowMissingColumns=True), version)
        numbered = index.entries(state, "_row")
        if any(s.embedder and s.semantic for s in self.specs):
            vectors, late = self._embed(numbered, changed, batch)
            kept = [c.split()[0] for c in STORED_INDEX.split(", ")]
            full = self._entries(numbered.join(few(vectors.select("_row", "content_hash", F.col("vector").alias("embedding"))), "_row", "left"))
            new = full.withColumn("live", F.lit(True)).unionByName(gone, allowMissingColumns=True).select(*kept, "live")
            self._index.write(new.unionByName(late.select(*kept, "live")) if late is not None else new, version)
        else:
            full = self._entries(numbered).withColumns({"embedding": F.lit(None).cast("array<float>"), "live": F.lit(True)})
            self._index.write(full.unionByName(gone, allowMissingColumns=True), version)
        self._applied.write(state.select(*(c.split()[0] for c in APPLIED.split(", "))), version)

    def _places(self, entries: DataFrame) -> DataFrame:
        """Best places of the words in searchable fields of index rows."""
        def of(spec: CollectionSpec) -> DataFrame:
            rows = entries.filter(F.col("collection") == spec.name)
            if ALL in spec.searchable and "_search_text" not in rows.columns:
                rows = rows.withColumn("_search_text", normalize(all_text(F.col("document"))))
            return lexical.best_places(index.materialize(rows, spec), list(_searchable(spec)))

        return reduce(DataFrame.unionByName, map(of, self.specs))

    def _post(self, entries: DataFrame, version: int) -> None:
        """Bring the inverted index up to changed rows of the index (those gone have live = false): words
        that a document no longer has go, and words not met before join the vocabulary."""
        keys = ["collection", "id"]
        new = self._places(entries.filter("live"))
        if self._index.parts(version - 1):
            new = stage(new, "engine-places")
            old = self._places(self._index.of(version - 1, entries.select(*keys), ["document", "_search_text"]))
            gone = old.join(new, [*keys, "token"], "left_anti").withColumn("live", F.lit(False))
            self._postings.write(new.withColumn("live", F.lit(True)).unionByName(gone), version)
            release(new)
        else:
            self._postings.write(new, version)
        self._words.write(self._postings.part(version).filter("live").select("collection", "token").distinct(), version)
        for spec in self.specs:
            if spec.name in self._fields:
                self._shred(entries, spec, version)

    def _shred(self, entries: DataFrame, spec: CollectionSpec, version: int) -> None:
        """Store the declared fields of changed rows of the index by type; those of the whole collection, where they
        were declared after documents came."""
        log = self._fields[spec.name]
        rows = entries.filter(F.col("collection") == spec.name).select("id", "document", "live")
        if not any(v < version for v in log.versions()):
            held = self._index.latest(version - 1, ["document"]).filter(F.col("collection") == spec.name).select("id", "document", F.lit(True).alias("live"))
            rows = rows.unionByName(held.join(rows.select("id"), "id", "left_anti"))
        log.write(index.shredded(rows, spec.declared()), version)

    def _embed(self, rows: DataFrame, changed: DataFrame, batch: int) -> tuple[DataFrame, DataFrame | None]:
        """Vectors (_row, content_hash, vector) of changed documents from the cache or the encoder, and one pass over
        the backlog: due texts are tried again where their revision is still the applied one, late vectors are patched
        in, and what fails is queued or waits longer. Returns the rows of the index to be patched, too."""
        now = self.now()
        version = batch * STRIDE
        waiting = self._backlog.latest(version - 1, ["next_attempt_at", "status"])
        first = stage(embed.due(waiting, now, self.per_pass).select(*embed.BACKLOG_KEY), "engine-due")
        turn = stage(self._backlog.of(version - 1, first), "engine-turn")
        names = changed.select(*gate.DOCUMENT)
        held = self._applied.of(version - 1, turn, ["revision", "operation"])
        now_applied = held.join(few(names), gate.DOCUMENT, "left_anti").unionByName(changed.select(*held.columns))
        current = stage(embed.still_current(turn, now_applied), "engine-current")
        texts = rows.withColumn("semantic_text", self._semantic_text())
        wanted = stage(texts.select(
            "_row", "collection", F.col("id").alias("document_id"), F.col("_revision").alias("revision"),
            content_hash(F.col("semantic_text")).alias("content_hash"), (F.col("semantic_text") != "").alias("some"),
        ), "engine-texts")
        # Of rows with the same text one is encoded; texts of the backlog come with it, as their documents did not change.
        again = current.select("content_hash", "semantic_text")
        asked = wanted.filter("some").select("content_hash", "_row").unionByName(again.select("content_hash", F.lit(None).cast("bigint").alias("_row")))
        model = F.lit(self.model).alias("model_version")
        cache = stage(self._cache.of(version - 1, asked.select("content_hash", model)).select("content_hash", "vector"), "engine-cached")
        one = asked.groupBy("content_hash").agg(F.min("_row").alias("_row")).join(few(cache.select("content_hash")), "content_hash", "left_anti")
        missing = stage(one, "engine-missing")
        fresh = _rows(texts, missing.filter("_row is not null"), wanted.count()).select(content_hash(F.col("semantic_text")).alias("content_hash"), "semantic_text")
        older = again.join(missing.filter("_row is null").select("content_hash"), "content_hash", "left_semi").groupBy("content_hash").agg(F.min("semantic_text").alias("semantic_text"))
        made = stage(self._encoded(fresh.unionByName(older)), "engine-made")
        self._cache.write(made.select("content_hash", model, F.size("vector").alias("dimensions"), "vector"), version)
        known = few(cache.unionByName(made))
        vectors = stage(wanted.join(known, "content_hash", "left"), "engine-vectors")
        found = current.drop("semantic_text").join(known, "content_hash").withColumnRenamed("document_id", "id")
        late = stage(found.select("collection", "id", "vector").dropDuplicates(["collection", "id"]), "engine-late")
        late = late.join(few(names.withColumnRenamed("document_id", "id")), ["collection", "id"], "left_anti")
        patched = embed.patch_vectors(self._index.of(version - 1, late), late).withColumn("live", F.lit(True)) if self._backlog.parts(version - 1) else None
        new = vectors.filter("vector is null and some").join(few(turn.select(*gate.DOCUMENT, "revision")), [*gate.DOCUMENT, "revision"], "left_anti")
        failed = texts.join(few(new.select("_row", "content_hash")), "_row").select("collection", F.col("id").alias("document_id"), F.col("_revision").alias("revision"), "content_hash", "semantic_text", F.lit(None).alias("vector"))
        queued = embed.enqueue_missing(failed, waiting, now, self.model).withColumn("live", F.lit(True))
        retried = embed.retry_or_dead(current.join(known.select("content_hash"), "content_hash", "left_anti"), now).withColumn("live", F.lit(True))
        closed = turn.join(retried.select(*embed.BACKLOG_KEY), embed.BACKLOG_KEY, "left_anti").withColumn("live", F.lit(False))
        self._backlog.write(queued.unionByName(retried.select(*queued.columns)).unionByName(closed), version)
        return vectors, patched

    def _encoded(self, texts: DataFrame) -> DataFrame:
        """content_hash, vector of texts (content_hash, semantic_text) that can be embedded."""
        if self.encoder is None:
            made = embed.hashed_vectors(texts, F.col("semantic_text"))
        else:
            passages = texts.select("content_hash", with_role(F.col("semantic_text"), "passage").alias("_passage"))
            made = embed.embed_texts(passages, "_passage", self.encoder)
        return made.filter("vector is not null").select("content_hash", "vector")

    def retire(self, names: list[str]) -> None:
        """Take collections out of the index, after the newest batch; those it does not hold are no matter."""
        with self._turn, passing(self.spark):
            version = self._maintenance()
            gone = self._index.latest(version).filter(F.col("collection").isin(names)).withColumn("live", F.lit(False))
            self._change_index(gone, version)

    def _change_index(self, rows: DataFrame, version: int) -> None:
        """Write rows of the index (those gone have live = false) and the places of their words."""
        with passing(self.spark):
            rows = stage(rows.select(*self._index.columns, "live"), "engine-maintained")
            self._post(rows, version)
            self._index.write(rows, version)

    def _with_vectors(self, entries: DataFrame, version: int) -> DataFrame:
        cache = self._cache.latest(version).filter(F.col("model_version") == self.model).select("content_hash", F.col("vector").alias("embedding"))
        return entries.join(few(cache), "content_hash", "left")

    def rebuild(self, batch: int) -> DataFrame:
        """The index of a batch from the applied state and the cached vectors alone."""
        return self._whole(self._with_vectors(self._entries(index.entries(self.applied(batch))), _after(batch)))

    def audit(self, batch: int) -> DataFrame:
        """Documents in which the index and the applied state of a batch differ."""
        applied = self._applied.latest(_after(batch), ["revision", "operation"]).withColumn("document_json", F.lit(None).cast("string"))
        return index.audit(applied, self._index.latest(_after(batch), ["_revision"]))

    def repair(self) -> int:
        """Write the documents that an audit finds anew, after the newest batch: those that the index lacks or
        holds in another revision come from the applied state and the cached vectors, those that it should not
        hold go. Returns how many there were. Retired collections are among them, as the applied state still
        holds their documents."""
        with self._turn, passing(self.spark):
            version = self._maintenance()
            wrong = stage(self.audit(self.newest()).select(F.col("collection"), F.col("id").alias("document_id")), "engine-wrong")
            n = wrong.count()
            if n:
                held = index.entries(self._applied.of(version, wrong))
                entries = self._with_vectors(self._entries(held), version).withColumn("live", F.lit(True))
                columns = [*self._index.columns, "live"]
                extra = wrong.withColumnRenamed("document_id", "id").join(held.select(*index.KEY), index.KEY, "left_anti").withColumn("live", F.lit(False))
                self._change_index(entries.select(*columns).unionByName(extra, allowMissingColumns=True), version)
            return n

    def use_model(self, model: str, encoder: embed.Encoder | None) -> int:
        """Embed with another model from now on, and queue the documents that have a text for it, after the newest
        batch; returns how many. Each batch takes per_pass of them, and the vectors of before are searched until a
        document's turn comes. A queue that is there already is not begun again."""
        with self._turn, passing(self.spark):
            self.model, self.encoder = model, encoder
            version = self._maintenance()
            rows = self._index.latest(version, ["_revision", "document"]).withColumn("semantic_text", self._semantic_text()).select(
                "collection", F.col("id").alias("document_id"), F.col("_revision").alias("revision"), content_hash(F.col("semantic_text")).alias("content_hash"), "semantic_text", F.lit(None).alias("vector")
            )
            self._backlog.write(embed.enqueue_missing(rows, few(self._backlog.latest(version, [])), self.now(), model, repeated=False), version)
            return self._backlog.part(version).count()

    def vacuum(self, kept: int = KEPT) -> None:
        """Remove files that none of the newest kept versions of a table needs."""
        with self._turn:
            for log in self._logs:
                log.vacuum(kept)

    def _spec(self, collection: str) -> CollectionSpec:
        spec = by_name(self.specs).get(collection)
        if spec is None:
            raise KeyError("unknown collection")
        return spec

    def documents(self, collection: str, batch: int, ids: DataFrame | None = None) -> DataFrame:
        """The live documents of a collection, or those with ids (id), with their declared fields as columns; an
        unknown collection is an error. Semantic fields that hold no string are null."""
        spec = self._spec(collection)
        if ids is None:
            rows = self._index.latest(_after(batch)).filter(F.col("collection") == spec.name)
        else:
            rows = self._index.of(_after(batch), ids.select(F.lit(spec.name).alias("collection"), F.col("id").cast("string").alias("id")))
        rows = self._whole(rows)
        return index.materialize(rows.withColumns({f: _string(f) for f in spec.semantic if f not in rows.columns}), spec)

    def _as_queries(self, rows: DataFrame, col: str) -> DataFrame:
        """rows with the vector of a text as a query; null where it cannot be had."""
        if self.encoder is None:
            return embed.hashed_vectors(rows, F.col(col))
        prefixed = rows.withColumn("_query", with_role(F.col(col), "query"))
        return embed.embed_texts(prefixed, "_query", self.encoder).drop("_query", "error")

    def listed(self, collection: str, batch: int, filters: dict[str, list] | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
        """id and declared fields, in their types, of the documents that pass filters. Filters reach the stored fields;
        documents are not read, but for collections whose fields were declared after the batch."""
        spec = self._spec(collection)
        declared = spec.declared()
        unknown = [f for f in fields if f not in declared]
        if unknown:
            raise ValueError(f"fields {unknown} are not declared")
        log = self._fields.get(collection)
        names = index.stored_names(declared)
        shown = lambda rows: rows.select("id", *(F.col(names[f]).alias(f) for f in fields))
        if log is not None and any(v <= _after(batch) for v in log.versions()):
            condition = searching.build_filters(filters or {}, spec, columns={**names, "id": "id"})
            return shown(log.matching(_after(batch), condition, [names[f] for f in fields]))
        rows = self._index.latest(_after(batch), ["document"]).filter(F.col("collection") == spec.name).withColumn("live", F.lit(True))
        return shown(index.shredded(rows, declared).filter(searching.build_filters(filters or {}, spec, columns={**names, "id": "id"})))

    def _vectors(self, spec: CollectionSpec, batch: int, filters: dict[str, list] | None, sort: list[str] | None = None) -> DataFrame:
        """id, embedding of the documents of a collection that pass filters, and the fields of a sort."""
        searching.parse_sort(sort or [], spec)
        rows = self._index.latest(_after(batch), ["embedding"]).filter(F.col("collection") == spec.name).drop("collection")
        fields = tuple(dict.fromkeys(f for f in (s.partition(":")[0] for s in sort or []) if f != "id"))
        return rows.join(self.listed(spec.name, batch, filters, fields), "id") if filters or fields else rows

    def search(
        self, queries: DataFrame, collection: str, batch: int, variants: bool = False, filters: dict[str, list] | None = None,
        sort: list[str] | None = None, synonyms: DataFrame | None = None,
    ) -> DataFrame:
        """Answers to queries (query_id, query, mode, semantic_weight, page_size, page_token, explain)
        over the index after a batch. Queries are embedded here; where that fails they are asked by
        words alone."""
        spec = self._spec(collection)
        asked = stage(self._as_queries(queries, "query"), "engine-queries", keep=True)
        with passing(self.spark):
            pages = self._found(asked, spec, batch, variants, filters, sort, synonyms)
        return self._answer(pages, asked, spec, batch)

    def _found(
        self, asked: DataFrame, spec: CollectionSpec, batch: int, variants: bool, filters: dict[str, list] | None, sort: list[str] | None, synonyms: DataFrame | None
    ) -> DataFrame:
        """Staged: the pages of search(), without the fields of their documents."""
        forms = lexical.query_variants(asked, self.stemmer, self.transliteration) if variants else None
        known = self._words.latest(_after(batch)).filter(F.col("collection") == spec.name).select("token")
        wanted = lexical.matching_tokens(lexical.query_words(asked, forms), known, synonyms)
        places = self._postings.of(_after(batch), wanted.select(F.lit(spec.name).alias("collection"), "token"))
        rows = self._vectors(spec, batch, filters, sort)
        if filters:
            places = places.join(rows.select("id"), "id", "left_semi")
        found = lexical.lexical(asked, places, len(_searchable(spec)), variants=forms, wanted=wanted)
        return stage(searching.ranked(asked, rows, spec, found, sort), "engine-pages", keep=True)

    def _answer(self, pages: DataFrame, asked: DataFrame, spec: CollectionSpec, batch: int) -> DataFrame:
        """Staged pages with the fields of their documents."""
        return searching.response(pages, asked, self.documents(spec.name, batch, pages.filter("id is not null").select("id")), spec)

    def similar(self, requests: DataFrame, collection: str, batch: int, filters: dict[str, list] | None = None) -> DataFrame:
        """Answers to requests (query_id, text, document_id, page_size, page_token, explain)."""
        spec = self._spec(collection)
        named = self.documents(spec.name, batch, requests.filter("document_id <> ''").select(F.col("document_id").alias("id")))
        with passing(self.spark):
            answers = searching.similar(requests, self._vectors(spec, batch, filters), spec, lambda df: self._as_queries(df, "text"), named=named)
            pages = stage(answers, "engine-pages", keep=True)
        return self._answer(pages, requests.withColumn("query", F.col("text")), spec, batch)

    def start(self, source: DataFrame, checkpoint: str, **trigger):  # noqa: ANN003, ANN201
        """The same over a stream of envelopes; default a micro-batch every 500 milliseconds."""
        writer = source.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"}))
        return writer.foreachBatch(lambda df, batch: self.process(df, batch)).start()


def _after(batch: int) -> int:
    """The last version that belongs to a batch."""
    return (batch + 1) * STRIDE - 1


def _searchable(spec: CollectionSpec) -> tuple[str, ...]:
    """The searchable fields as columns of the index."""
    return ("_search_text",) if ALL in spec.searchable else spec.searchable


def _string(name: str) -> F.Column:
    """A field of the JSON document that is a string; null for any other value."""
    value = F.try_variant_get(F.try_parse_json("document"), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json("document"), f"$.{name}", "string"))


def _rows(events: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """The events, n of them, whose _row is among chosen. Where few are chosen, or few are not, these numbers are sent to
    all tasks, and no document is shuffled."""
    numbers = chosen.select("_row")
    kept = numbers.count()
    if kept > SMALL and n - kept <= SMALL:
        others = events.select("_row").join(numbers, "_row", "left_anti")
        return events.join(F.broadcast(stage(others, "engine-others")), "_row", "left_anti")
    return events.join(F.broadcast(numbers) if kept <= SMALL else numbers, "_row", "left_semi")


def land(events: DataFrame, path: str, per_pass: int = 1_000, lanes: int = 1) -> None:
    """Add envelopes to a folder in files of at most so many rows, each in the order of arrival. event_files() of one file a
    pass then takes in no more events than that, whatever is waiting. Files that came in one call are taken in any order:
    the newest revision wins whichever comes first. With lanes over 1, deliveries are dealt into folders lane=0 and on,
    repeated ones into the same, for streams side by side."""
    if per_pass < 1 or lanes < 1:
        raise ValueError("a pass takes one event at least")
    if lanes > 1:
        lane = F.pmod(F.xxhash64(*ingest.DELIVERY), F.lit(lanes)).cast("int")
        events = events.withColumn("lane", lane).repartition(lanes, "lane").sortWithinPartitions("lane", "arrival")
        events.write.mode("append").option("maxRecordsPerFile", per_pass).partitionBy("lane").parquet(path)
    else:
        events.sortWithinPartitions("arrival").write.mode("append").option("maxRecordsPerFile", per_pass).parquet(path)


def take_lanes(spark: SparkSession, path: str, schema: StructType, checkpoint: str, take: Callable[[DataFrame, int, int], None]) -> None:
    """Take in what land() has dealt into lanes: a stream for each, side by side, each pass one file. take() gets the
    events of a pass, its lane and its number there. Where one stream fails the others are stopped and its error is raised."""
    there = spark.read.schema(StructType([*schema, StructField("lane", IntegerType())])).parquet(path)
    flows = []
    try:
        for (lane,) in sorted(there.select("lane").distinct().collect()):
            writer = event_files(spark, f"{path}/lane={lane}", schema, files_per_pass=1).writeStream.option("checkpointLocation", f"{checkpoint}/lane={lane}")
            flows.append(writer.trigger(availableNow=True).foreachBatch(lambda df, batch, lane=lane: take(df, lane, batch)).start())
        for flow in flows:
            flow.awaitTermination()
    finally:
        for flow in flows:
            if flow.isActive:
                flow.stop()


def event_files(spark: SparkSession, path: str, schema: str, files_per_pass: int = 10, form: str = "parquet") -> DataFrame:
    """A stream of envelope files, so many for each pass; that bounds what one batch takes in, by events where land()
    wrote the files."""
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_pass).load(path)


def stream_dedup(events: DataFrame, time: str | None = None, within: str | None = None) -> DataFrame:
    """First valid deliveries of a stream, remembered for ever; or, with a column of times and a duration, for so long after
    their time. Then state stays as large as the deliveries of that duration: a delivery within it of the first one is
    dropped, one after the watermark has passed it counts as new, and one that comes later than the watermark, or without
    a time, may be lost. So that is asked for, not the default."""
    valid = events.filter(reject_reason().isNull())
    if (time is None) != (within is None):
        raise ValueError("a bound needs a column of times and a duration")
    return valid.dropDuplicates(ingest.DELIVERY) if time is None else valid.withWatermark(time, within).dropDuplicatesWithinWatermark(ingest.DELIVERY)


def stored_payloads(df: DataFrame, col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Envelopes of stored payloads, and those that do not decode or are not valid."""
    decoded = decode_payload(df, col)
    return decoded.filter("reason is null").drop("reason"), decoded.filter("reason is not null")
