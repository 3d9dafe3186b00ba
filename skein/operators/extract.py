"""Prompts, model calls and answers as tables: normalise, format, call, parse with a quarantine, link."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import clean_text, strip_fences

#: Names of types in answers, in lower case, and what they mean.
ENTITY_TYPES = {
    "person": "person", "organization": "organization", "org": "organization", "project": "project", "concept": "concept", "topic": "topic", "place": "place",
    "actionitem": "actionItem", "action_item": "actionItem", "blogidea": "blogIdea", "blog_idea": "blogIdea", "idea": "idea",
}
RELATIONSHIP_TYPES = {k.lower(): k for k in ("worksFor", "worksOn", "manages", "collaborates", "mentions", "cooccurs", "discusses", "relatesTo", "owns", "inspiredBy", "partOf", "reports")}

ENTITY_ANSWER = "entities array<struct<name: string, type: string, confidence: double, mentions: array<struct<surface_form: string, chunk_ordinal: double>>>>"
RELATIONSHIP_ANSWER = "relationships array<struct<from_entity: string, to_entity: string, type: string, confidence: double, evidence_chunk_ordinals: array<double>>>"

ENTITY_TASK = "List the people, organizations, projects, concepts, topics, places, action items and ideas of this meeting as JSON."
THEME_TASK = "Name three to ten themes of this meeting as JSON."
RELATIONSHIP_TASK = "List the relationships among the known entities that this meeting states, as JSON."


def _mapped(text: Column, names: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(text)), F.lit(default))


def entity_kind(text: Column) -> Column:
    return _mapped(text, ENTITY_TYPES, "other")


def relationship_kind(text: Column) -> Column:
    return _mapped(text, RELATIONSHIP_TYPES, "relatesTo")


def normalize_pass(meetings: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Meetings in status chunked become normalized, their chunks get clean text; all else stays."""
    due = meetings.where("transcript_status = 'chunked'").select(F.col("id").alias("meeting_id"), F.lit(True).alias("due"))
    texts = chunks.join(due, "meeting_id", "left").withColumn("normalized_text", F.when(F.col("due"), clean_text(F.col("text"))).otherwise(F.col("normalized_text"))).drop("due")
    return meetings.withColumn("transcript_status", F.when(F.col("transcript_status") == "chunked", "normalized").otherwise(F.col("transcript_status"))), texts


def advance(meetings: DataFrame) -> DataFrame:
    """The status that follows: cached, chunked, normalized, extracted."""
    s = F.col("transcript_status")
    return meetings.withColumn("next_status", F.when(s == "cached", "chunked").when(s == "chunked", "normalized").when(s == "normalized", "extracted").otherwise(s))


def pending(meetings: DataFrame, runs: DataFrame, pass_name: str) -> DataFrame:
    """Meetings without a completed run of the pass: what a retry works on, whatever their status."""
    done = runs.where((F.col("status") == "completed") & (F.col("pass_name") == pass_name)).select(F.col("meeting_id").alias("id"))
    return meetings.join(done, "id", "left_anti")


def format_transcripts(chunks: DataFrame) -> DataFrame:
    """(meeting_id, transcript): lines ``[index] [speaker] text`` in order."""
    line = F.concat(F.lit("["), F.col("chunk_index").cast("string"), F.lit("] "), F.coalesce(F.concat(F.lit("["), "speaker", F.lit("] ")), F.lit("")), F.coalesce("normalized_text", "text"))
    rows = chunks.select("meeting_id", F.struct("chunk_index", line.alias("line")).alias("l"))
    return rows.groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("transcript"))


def _message(meetings: DataFrame, transcripts: DataFrame, *extra: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Meeting: "), "title"), *extra, F.concat(F.lit("Transcript:\n"), "transcript"))


def entity_prompts(meetings: DataFrame, transcripts: DataFrame, attendees: DataFrame | None = None) -> DataFrame:
    """(meeting_id, system, message); ``attendees`` is (meeting_id, attendee)."""
    rows = meetings.select(F.col("id").alias("meeting_id"), "title").join(transcripts, "meeting_id")
    if attendees is None:
        return rows.select("meeting_id", F.lit(ENTITY_TASK).alias("system"), _message(meetings, transcripts).alias("message"))
    names = attendees.groupBy("meeting_id").agg(F.array_join(F.array_sort(F.collect_set("attendee")), ", ").alias("names"))
    who = F.concat(F.lit("Attendees: "), F.coalesce("names", F.lit("")))
    return rows.join(names, "meeting_id", "left").select("meeting_id", F.lit(ENTITY_TASK).alias("system"), _message(meetings, transcripts, who).alias("message"))


def theme_prompts(meetings: DataFrame, transcripts: DataFrame) -> DataFrame:
    rows = meetings.select(F.col("id").alias("meeting_id"), "title").join(transcripts, "meeting_id")
    return rows.select("meeting_id", F.lit(THEME_TASK).alias("system"), _message(meetings, transcripts).alias("message"))


def relationship_prompts(meetings: DataFrame, transcripts: DataFrame, mentions: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """As above with the entities that the meeting's chunks mention; meetings without any are skipped."""
    known = (
        mentions.select("entity_id", F.col("meeting_chunk_id").alias("chunk_id"))
        .join(chunks.select(F.col("id").alias("chunk_id"), "meeting_id"), "chunk_id")
        .join(entities.select(F.col("id").alias("entity_id"), "canonical_name", "kind"), "entity_id")
        .groupBy("meeting_id")
        .agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), "canonical_name", F.lit(" ("), "kind", F.lit(")")))), "\n").alias("known"))
    )
    rows = meetings.select(F.col("id").alias("meeting_id"), "title").join(transcripts, "meeting_id").join(known, "meeting_id")
    return rows.select("meeting_id", F.lit(RELATIONSHIP_TASK).alias("system"), _message(meetings, transcripts, F.concat(F.lit("Known entities:\n"), "known")).alias("message"))


def call_model(prompts: DataFrame, call: Callable[[str, str], str], done: DataFrame | None = None) -> DataFrame:
    """(meeting_id, answer, error): ``call(system, message)`` for each prompt not in ``done`` (meeting_id).

    ``call`` runs on executors; an exception becomes the row's error. Store the result
    before it is used twice, so that no prompt is sent again.
    """
    todo = prompts.join(done.select("meeting_id"), "meeting_id", "left_anti") if done is not None else prompts

    def one(system: str, message: str) -> tuple[str | None, str | None]:
        try:
            return call(system, message), None
        except Exception as e:  # noqa: BLE001  whatever the client raises belongs to the row
            return None, str(e)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [one(s, m) for s, m in zip(p["system"], p["message"], strict=True)]
            yield pd.DataFrame({"meeting_id": p["meeting_id"], "answer": [a for a, _ in got], "error": [e for _, e in got]})

    return todo.select("meeting_id", "system", "message").mapInPandas(run, "meeting_id string, answer string, error string")


def _whole(x: Column) -> Column:
    return x.isNotNull() & (x == F.floor(x))


def parse_entities(answers: DataFrame) -> DataFrame:
    """``answers`` with ``entities`` and ``reason`` (null if accepted): one missing or mistyped field rejects an answer."""
    body = F.from_json(strip_fences(F.col("answer")), ENTITY_ANSWER)["entities"]
    mention = lambda m: m["surface_form"].isNotNull() & _whole(m["chunk_ordinal"])
    fine = F.forall("entities", lambda e: e["name"].isNotNull() & e["type"].isNotNull() & e["confidence"].isNotNull() & e["mentions"].isNotNull() & F.coalesce(F.forall(e["mentions"], mention), F.lit(False)))
    reason = F.when(F.col("entities").isNull(), "not an entity answer").when(~F.coalesce(fine, F.lit(False)), "a field is missing or of another type").when(F.size("entities") == 0, "no entities")
    return answers.withColumn("entities", body).withColumn("reason", reason)


def parse_relationships(answers: DataFrame) -> DataFrame:
    body = F.from_json(strip_fences(F.col("answer")), RELATIONSHIP_ANSWER)["relationships"]
    refs = lambda r: r["evidence_chunk_ordinals"].isNotNull() & F.coalesce(F.forall(r["evidence_chunk_ordinals"], _whole), F.lit(False))
    fine = F.forall("relationships", lambda r: r["from_entity"].isNotNull() & r["to_entity"].isNotNull() & r["type"].isNotNull() & r["confidence"].isNotNull() & refs(r))
    reason = F.when(F.col("relationships").isNull(), "not a relationship answer").when(~F.coalesce(fine, F.lit(False)), "a field is missing or of another type")
    return answers.withColumn("relationships", body).withColumn("reason", reason)


def extracted(parsed: DataFrame) -> DataFrame:
    """(meeting_id, pos, name, canonical_name, kind, confidence, mentions) of accepted answers."""
    rows = parsed.where("reason is null").select("meeting_id", F.posexplode("entities").alias("pos", "e"))
    return rows.select("meeting_id", "pos", "e.name", F.lower("e.name").alias("canonical_name"), entity_kind(F.col("e.type")).alias("kind"), "e.confidence", "e.mentions")


def upsert_entities(found: DataFrame, existing: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(canonical_name, kind, entity_id, name, is_new): the first existing entity of the key, else a new one.

    A new id is taken from the key's hash. With ``roots`` (id, root) matches on merged
    entities go to what they were merged into.
    """
    keys = ["canonical_name", "kind"]
    have = existing.groupBy(*keys).agg(F.min_by("id", F.struct("first_seen_at", "id")).alias("have"))
    if roots is not None:
        have = have.join(roots.toDF("have", "root"), "have", "left").select(*keys, F.coalesce("root", "have").alias("have"))
    incoming = found.groupBy(*keys).agg(F.min_by("name", F.struct("meeting_id", "pos")).alias("name"))
    own = F.substring(F.sha2(F.concat_ws("|", "kind", "canonical_name"), 256), 1, 32)
    return incoming.join(have, keys, "left").select(*keys, F.coalesce("have", own).alias("entity_id"), "name", F.col("have").isNull().alias("is_new"))


def run_id(meeting_id: Column, pass_name: str, prompt_version: str) -> Column:
    """The run of a pass over a meeting with a version of its prompt: made from the three, so a rerun has the same."""
    return F.substring(F.sha2(F.concat_ws("|", meeting_id, F.lit(pass_name), F.lit(prompt_version)), 256), 1, 32)


def _row_id(run: Column, *places: Column) -> Column:
    """The id of what stands at a place of a run's answer."""
    return F.substring(F.sha2(F.concat_ws("|", run, *(p.cast("string") for p in places)), 256), 1, 32)


def build_mentions(found: DataFrame, ids: DataFrame, chunks: DataFrame, prompt_version: str = "v1", pass_name: str = "entities") -> DataFrame:
    """(id, entity_id, meeting_chunk_id, confidence, extraction_run_id); ordinals without a chunk are dropped, duplicates kept.

    The id follows from the run and the places of the entity and of the mention in its answer.
    """
    run = run_id(F.col("meeting_id"), pass_name, prompt_version)
    rows = found.select("meeting_id", "pos", "canonical_name", "kind", "confidence", F.posexplode("mentions").alias("place", "m"))
    rows = rows.withColumns({"chunk_index": F.col("m.chunk_ordinal").cast("long"), "extraction_run_id": run}).withColumn("id", _row_id(F.col("extraction_run_id"), F.col("pos"), F.col("place")))
    at = chunks.select("meeting_id", "chunk_index", F.col("id").alias("meeting_chunk_id"))
    linked = rows.join(at, ["meeting_id", "chunk_index"]).join(ids.select("canonical_name", "kind", "entity_id"), ["canonical_name", "kind"])
    return linked.select("id", "entity_id", "meeting_chunk_id", "confidence", "extraction_run_id")


def mention_counts(mentions: DataFrame, chunks: DataFrame, meetings: DataFrame) -> DataFrame:
    """(entity_id, mention_count, first_seen_at, last_seen_at) from all mentions and the dates of their meetings."""
    dated = chunks.select(F.col("id").alias("meeting_chunk_id"), "meeting_id").join(meetings.select(F.col("id").alias("meeting_id"), "date"), "meeting_id")
    return mentions.join(dated, "meeting_chunk_id").groupBy("entity_id").agg(F.count("*").alias("mention_count"), F.min("date").alias("first_seen_at"), F.max("date").alias("last_seen_at"))


def build_relationships(parsed: DataFrame, known: DataFrame, prompt_version: str = "rel-v1", pass_name: str = "relationships") -> DataFrame:
    """(id, meeting_id, source_entity_id, target_entity_id, kind, weight, confidence, evidence_chunk_refs, extraction_run_id).

    ``known`` is (meeting_id, entity_id, canonical_name, kind). Ends are found by canonical
    name or by "name (kind)", in lower case; of several the least entity_id counts; a
    relationship with an end that isn't found is dropped. The weight is the confidence; the id follows from
    the run and the place in its answer.
    """
    both = known.select("meeting_id", "entity_id", F.lower("canonical_name").alias("key")).union(known.select("meeting_id", "entity_id", F.lower(F.concat("canonical_name", F.lit(" ("), "kind", F.lit(")")))))
    keys = both.groupBy("meeting_id", "key").agg(F.min("entity_id").alias("entity_id"))
    rows = parsed.where("reason is null").select("meeting_id", run_id(F.col("meeting_id"), pass_name, prompt_version).alias("extraction_run_id"), F.posexplode("relationships").alias("place", "r"))
    rows = rows.select(
        _row_id(F.col("extraction_run_id"), F.col("place")).alias("id"), "extraction_run_id", "meeting_id", F.lower("r.from_entity").alias("a"), F.lower("r.to_entity").alias("b"), relationship_kind(F.col("r.type")).alias("kind"),
        F.col("r.confidence").alias("weight"), F.col("r.confidence").alias("confidence"), evidence_refs(F.col("r.evidence_chunk_ordinals")).alias("evidence_chunk_refs"),
    )
    src, dst = keys.toDF("meeting_id", "a", "source_entity_id"), keys.toDF("meeting_id", "b", "target_entity_id")
    return rows.join(src, ["meeting_id", "a"]).join(dst, ["meeting_id", "b"]).select("id", "meeting_id", "source_entity_id", "target_entity_id", "kind", "weight", "confidence", "evidence_chunk_refs", "extraction_run_id")


def evidence_refs(ordinals: Column) -> Column:
    """Chunk ordinals as integers, null if there are none."""
    return F.when(F.size(ordinals) > 0, F.transform(ordinals, lambda x: x.cast("int")))


def extraction_runs(parsed: DataFrame, model: str, prompt_version: str, pass_name: str, started_at: str | None = None, completed_at: str | None = None) -> DataFrame:
    """One audit row for each answer, rejected ones too; a rejected one isn't completed."""
    at = lambda t: F.lit(t).cast("timestamp")
    fine = F.col("reason").isNull()
    return parsed.select(
        run_id(F.col("meeting_id"), pass_name, prompt_version).alias("id"), "meeting_id", F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), F.lit(pass_name).alias("pass_name"),
        at(started_at).alias("started_at"), F.when(fine, at(completed_at)).alias("completed_at"), F.when(fine, "completed").otherwise("failed").alias("status"), F.col("reason").alias("error_message"),
    )
