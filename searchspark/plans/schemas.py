"""Layouts of the engine's tables, as Spark DDL."""

ENVELOPE = (
    "source_service string, event_id string, operation string, collection string, document_id string, "
    "revision bigint, document_json string, occurred_at string, arrival bigint"
)
APPLIED = "collection string, document_id string, revision bigint, operation string, digest string, document_json string"
INDEX = (
    "collection string, id string, _revision bigint, document string, _search_text string, _stems array<string>, "
    "_translit string, content_hash string, semantic_text string, embedding array<float>"
)
#: What of it is stored; the other columns follow from these (SearchEngine._whole()).
STORED_INDEX = (
    "collection string, id string, _revision bigint, document string, _search_text string, _stems array<string>, "
    "content_hash string, embedding array<float>"
)
REJECTED = (
    "source_service string, event_id string, collection string, document_id string, revision bigint, "
    "payload string, attempts int, reason string, stage string"
)
CACHE = "content_hash string, model_version string, dimensions int, vector array<float>"
BACKLOG = (
    "collection string, document_id string, revision bigint, content_hash string, model_version string, "
    "semantic_text string, attempts int, next_attempt_at timestamp, status string, last_error string"
)
INBOX = "source_service string, event_id string, payload string, arrival bigint"
POSTINGS = "collection string, token string, id string, field_rank int, pos int"
WORDS = "collection string, token string"
