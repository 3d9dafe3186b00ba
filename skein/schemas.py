"""Table schemas, their keys, foreign keys and legal values."""

from __future__ import annotations

MEETINGS = "id string, source_id string, title string, date timestamp, duration double, raw_transcript string, normalized_transcript string, summary string, source_adapter string, transcript_status string, imported_at timestamp, updated_at timestamp"
CHUNKS = "id string, meeting_id string, chunk_index long, text string, normalized_text string, speaker string, start_time double, end_time double, embedding array<float>"
ENTITIES = "id string, name string, canonical_name string, kind string, summary string, merged_into_id string, mention_count long, first_seen_at timestamp, last_seen_at timestamp"
ALIASES = "id string, entity_id string, alias string, source string"
MENTIONS = "id string, entity_id string, meeting_chunk_id string, confidence double, extraction_run_id string"
RELATIONSHIPS = "id string, source_entity_id string, target_entity_id string, kind string, weight double, confidence double, evidence string, evidence_chunk_refs array<int>, extraction_run_id string"
RUNS = "id string, meeting_id string, model string, prompt_version string, pass_name string, started_at timestamp, completed_at timestamp, status string, error_message string"
JOBS = "id string, kind string, payload binary, status string, priority long, attempts long, max_attempts long, last_error string, created_at timestamp, scheduled_at timestamp, started_at timestamp, completed_at timestamp"

#: The legal values of the text enumerations.
ENTITY_KINDS = ("person", "organization", "project", "concept", "topic", "place", "actionItem", "blogIdea", "idea", "other")
RELATIONSHIP_KINDS = ("worksFor", "worksOn", "manages", "collaborates", "mentions", "cooccurs", "discusses", "relatesTo", "owns", "inspiredBy", "partOf", "reports")
TRANSCRIPT_STATUSES = ("pending", "cached", "chunked", "normalized", "extracted", "failed")
JOB_STATUSES = ("pending", "running", "completed", "failed", "cancelled")
ALIAS_SOURCES = ("auto", "manual")

UNIQUE_KEYS = {"meetings": ("source_id", "source_adapter"), "meeting_chunks": ("meeting_id", "chunk_index"), "entity_aliases": ("entity_id", "alias")}
FOREIGN_KEYS = (
    ("meeting_chunks", "meeting_id", "meetings"),
    ("mentions", "entity_id", "entities"),
    ("entity_aliases", "entity_id", "entities"),
    ("relationships", "source_entity_id", "entities"),
    ("relationships", "target_entity_id", "entities"),
    ("entities", "merged_into_id", "entities"),
)
