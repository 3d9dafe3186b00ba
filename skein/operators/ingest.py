"""Source exports to meetings and chunks: typed JSON, de-duplicated pages, incremental import with a quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import parse_iso

DOCUMENT = "id string, title string, created_at string, updated_at string"
DOCUMENT_LIST = f"docs array<struct<{DOCUMENT.replace(' string', ': string')}>>"
PERSON = "struct<name: string, email: string, details: struct<person: struct<name: struct<fullName: string>>>>"
METADATA = f"creator {PERSON}, attendees array<{PERSON}>, duration_seconds long, title string, created_at string, participants array<string>, labels array<string>"
SEGMENT = "struct<id: string, document_id: string, start_timestamp: string, end_timestamp: string, text: string, source: string, is_final: boolean>"


def read_document_list(spark: SparkSession, path: str) -> DataFrame:
    """Documents of exported list files, one row each."""
    return spark.read.schema(DOCUMENT_LIST).json(path, multiLine=True).select(F.explode("docs").alias("d")).select("d.*")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of exported transcripts (a JSON array a file)."""
    return spark.read.schema(SEGMENT.removeprefix("struct<").removesuffix(">").replace(": ", " ")).json(path, multiLine=True)


def document_list(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Documents of JSON text rows: ``pages`` columns but the payload, pos and the document's; rows without an id go."""
    rest = [c for c in pages.columns if c != payload]
    rows = pages.withColumn("_l", F.from_json(payload, DOCUMENT_LIST)).select(*rest, F.posexplode("_l.docs").alias("pos", "d"))
    return rows.where("d.id is not null").select(*rest, "pos", "d.*")


def dedup_pages(documents: DataFrame) -> DataFrame:
    """The first of each id by (page_no, pos)."""
    first = documents.groupBy("id").agg(F.min_by(F.struct("page_no", "pos", *[c for c in documents.columns if c not in ("id", "page_no", "pos")]), F.struct("page_no", "pos")).alias("d"))
    return first.select("id", "d.*")


def metadata(rows: DataFrame, payload: str = "payload") -> DataFrame:
    rest = [c for c in rows.columns if c != payload]
    return rows.withColumn("_m", F.from_json(payload, METADATA)).select(*rest, "_m.*")


def person_name(p: Column) -> Column:
    return F.coalesce(p["name"], p["details"]["person"]["name"]["fullName"], p["email"])


def attendees(meta: DataFrame, key: str) -> DataFrame:
    """(key, pos, attendee): one row an attendee, a null one where there are none."""
    return meta.select(key, F.posexplode_outer("attendees").alias("pos", "p")).select(key, "pos", person_name(F.col("p")).alias("attendee"))


def segments(rows: DataFrame, payload: str = "payload") -> DataFrame:
    rest = [c for c in rows.columns if c != payload]
    return rows.withColumn("_s", F.from_json(payload, f"array<{SEGMENT}>")).select(*rest, F.explode("_s").alias("s")).select(*rest, "s.*")


def meetings_from_documents(documents: DataFrame, adapter: str, as_of: str, since: str | None = None) -> DataFrame:
    """Meetings of documents; a missing title is Untitled, a missing date the update's, then ``as_of``."""
    date = F.coalesce(parse_iso(F.col("created_at")), parse_iso(F.col("updated_at")), F.lit(as_of).cast("timestamp"))
    out = documents.select(F.substring(F.sha2("id", 256), 1, 32).alias("id"), F.col("id").alias("source_id"), F.coalesce("title", F.lit("Untitled")).alias("title"), date.alias("date"), F.lit(adapter).alias("source_adapter"))
    return out.where(F.col("date") >= F.lit(since).cast("timestamp")) if since else out


def with_duration(meetings: DataFrame, meta: DataFrame) -> DataFrame:
    """``meetings`` with duration from ``meta`` (source_id, duration_seconds), 0 where unknown."""
    return meetings.drop("duration").join(meta.select("source_id", "duration_seconds"), "source_id", "left").withColumn("duration", F.coalesce("duration_seconds", F.lit(0)).cast("double")).drop("duration_seconds")


def chunks_from_segments(segs: DataFrame) -> DataFrame:
    """(meeting_id, chunk_index, text, speaker, start_time, end_time): segments in order of their parsed start.

    Times count from a document's first start; segments without a readable start come last,
    by id. A document whose starts are all unreadable has no chunks.
    """
    start, end = parse_iso(F.col("start_timestamp")), parse_iso(F.col("end_timestamp"))
    w = Window.partitionBy("document_id").orderBy(F.col("s").asc_nulls_last(), "id")
    rows = segs.withColumns({"s": start, "e": end}).withColumn("base", F.min("s").over(Window.partitionBy("document_id"))).where("base is not null")
    since = lambda c: (F.unix_micros(c) - F.unix_micros(F.col("base"))) / F.lit(1e6)
    return rows.select(
        F.substring(F.sha2("document_id", 256), 1, 32).alias("meeting_id"),
        (F.row_number().over(w) - 1).cast("long").alias("chunk_index"),
        "text",
        F.col("source").alias("speaker"),
        since(F.col("s")).alias("start_time"),
        since(F.col("e")).alias("end_time"),
    )


def new_meetings(remote: DataFrame, stored: DataFrame) -> DataFrame:
    """Remote meetings that aren't stored for their adapter, once each; stored ones are never refreshed."""
    keys = ["source_id", "source_adapter"]
    return remote.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys)


def stamp(meetings: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    return meetings.withColumns({"transcript_status": F.lit("cached"), "imported_at": now, "updated_at": now})


def sync(remote: DataFrame, stored: DataFrame, payloads: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(imported, quarantined): a new meeting counts as imported only if its transcript, in ``payloads`` (source_id, payload), is a JSON array.

    An empty array is no failure. Quarantined meetings aren't stored, so the next run tries them again.
    """
    fresh = new_meetings(remote, stored)
    good = payloads.where(F.from_json("payload", f"array<{SEGMENT}>").isNotNull() & F.col("payload").rlike(r"^\s*\[")).select("source_id").distinct()
    failed = fresh.join(good, "source_id", "left_anti").withColumn("reason", F.lit("transcript unreadable or missing"))
    return stamp(fresh.join(good, "source_id", "left_semi"), as_of), failed


def extraction_jobs(imported: DataFrame, as_of: str) -> DataFrame:
    """One pending extraction job for each imported meeting."""
    payload = F.to_json(F.struct(F.col("id").alias("meetingID"), F.col("source_adapter").alias("sourceAdapter")))
    now = F.lit(as_of).cast("timestamp")
    return imported.select(F.concat(F.lit("job:"), "id").alias("id"), F.lit("extraction").alias("kind"), payload.cast("binary").alias("payload"), F.lit("pending").alias("status"), now.alias("created_at"), now.alias("scheduled_at"))


def sync_report(remote: DataFrame, imported: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: found, imported, failed, skipped."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(remote, "found").crossJoin(n(imported, "imported")).crossJoin(n(failed, "failed")).withColumn("skipped", F.col("found") - F.col("imported") - F.col("failed"))
