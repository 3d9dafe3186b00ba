"""Ingest, search, ledger, audits and streams."""

from __future__ import annotations

import glob
import json
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from skein.functions import storage, versions
from skein.operators import audit, ingest, ledger, search
from skein.streaming import jobs as streams
from skein.streaming import progress

M = "id string, source_id string, title string, date timestamp, summary string, source_adapter string"


def meetings(spark, rows):
    df = spark.createDataFrame([(i, i, t, None, s, "a") for i, t, s in rows], M)
    return df.withColumn("date", F.lit("2024-01-01").cast("timestamp"))


def test_read_exports(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"docs": [{"id": "1", "title": None, "extra": 3}, {"id": "2", "created_at": "2024-01-01T00:00:00Z"}]}))
    assert sorted((r.id, r.title, r.created_at) for r in ingest.read_document_list(spark, str(tmp_path / "d.json")).collect()) == [("1", None, None), ("2", None, "2024-01-01T00:00:00Z")]
    (tmp_path / "s.json").write_text(json.dumps([{"id": "a", "document_id": "1", "start_timestamp": "x", "end_timestamp": "y", "text": "t", "source": "mic"}]))
    assert ingest.read_segments(spark, str(tmp_path / "s.json")).first().is_final is None


def test_chunks_from_segments(spark):
    rows = [("1", "d", "2024-01-01T00:00:05Z", "2024-01-01T00:00:09.5Z"), ("2", "d", "2024-01-01T00:00:01Z", None), ("3", "d", "never", None), ("4", "e", "2024-01-01", None)]
    df = spark.createDataFrame([(i, d, s, e, "t" + i, "mic") for i, d, s, e in rows], "id string, document_id string, start_timestamp string, end_timestamp string, text string, source string")
    got = sorted((r.chunk_index, r.text, r.start_time, r.end_time) for r in ingest.chunks_from_segments(df).collect())
    assert got == [(0, "t2", 0.0, None), (1, "t1", 4.0, 8.5), (2, "t3", None, None)]


def test_sync(spark):
    remote = meetings(spark, [("1", "a", None), ("2", "b", None), ("3", "c", None), ("3", "c", None), ("4", "d", None)])
    payloads = spark.createDataFrame([("2", "[]"), ("3", '[{"id": "s"}]'), ("4", "{oops")], "source_id string, payload string")
    good, bad = ingest.sync(remote, remote.where("id = '1'"), payloads, "2024-06-01 00:00:00")
    assert sorted(r.id for r in good.collect()) == ["2", "3"] and [r.id for r in bad.collect()] == ["4"]
    assert {r.transcript_status for r in good.collect()} == {"cached"}
    job = ingest.extraction_jobs(good.where("id = '2'"), "2024-06-01 00:00:00").first()
    assert json.loads(bytes(job.payload)) == {"meetingID": "2", "sourceAdapter": "a"}


def search_case(spark):
    m = meetings(spark, [("m1", "Architecture Review", None), ("m2", "Other", "an architecture")])
    c = spark.createDataFrame([(f"c{i:02}", "m1", "the ARCHITECTURE team " + "x" * 300, "Alice" if i else None) for i in range(10)], "id string, meeting_id string, text string, speaker string")
    e = spark.createDataFrame([("e1", "Architecture Team", "architecture team", "actionItem", 3)], "id string, name string, canonical_name string, kind string, mention_count long")
    return c, m, e


def test_search(spark):
    c, m, e = search_case(spark)
    hits = search.search(c, m, e, " architecture ").collect()
    assert [h.type for h in hits] == ["chunk"] * 10 + ["meeting"] * 2 + ["entity"]
    assert hits[1].context == "Speaker: Alice" and hits[0].context is None and len(hits[0].snippet) == 200 and hits[-1].context == "Actionitem"
    assert [h.id for h in search.search(c, m, e, "architecture", 4, 9).collect()] == ["c09", "m1", "m2", "e1"]
    assert search.search(c, m, e, "  ").count() == 0
    with pytest.raises(ValueError, match="negative"):
        search.search(c, m, e, "x", -1)
    q = spark.createDataFrame([("TEAM",), ("zebra",), (" ",)], "query string")
    assert [(r.query, r.rank, r.id) for r in search.batch(c, q, 2).orderBy("rank").collect()] == [("TEAM", 1, "c00"), ("TEAM", 2, "c01")]
    assert search.token_index(c).where("token = 'architecture'").count() == 10


def ledger_case(spark):
    rows = [(1, "x", "pending", 0, 0, "2024-01-01"), (2, "x", "pending", 5, 0, "2024-01-03"), (3, "x", "pending", 5, 0, "2024-01-02"), (4, "y", "failed", 0, 1, "2024-01-01"), (5, "y", "failed", 0, 3, "2024-01-01"), (6, "y", "completed", 0, 1, "2024-01-01"), (7, "y", "cancelled", 0, 1, "2024-01-01"), (8, "y", "running", 0, 9, "2024-01-01")]
    df = spark.createDataFrame([(*r, 3, "e" if r[2] == "failed" else None) for r in rows], "id long, kind string, status string, priority long, attempts long, at string, max_attempts long, last_error string")
    at = F.col("at").cast("timestamp")
    return df.withColumns({"created_at": at, "scheduled_at": at, "completed_at": F.when(F.col("status") == "completed", at)})


def test_ledger(spark):
    j = ledger_case(spark)
    s = ledger.summary(j).first()
    assert (s.active, s.completed, s.failed, s.total) == (4, 1, 2, 7)
    assert [r.id for r in ledger.retryable(j).collect()] == [4]
    assert [(r.kind, r.id) for r in ledger.claimable(j, "2024-01-02 00:00:00").collect()] == [("x", 3)]
    assert j.count() - ledger.cleanup(j, "2024-02-01 00:00:00").count() == 1
    assert {(r.id, r.status, r.attempts, r.last_error) for r in ledger.reset_failed(j).where("id in (4, 6)").collect()} == {(4, "pending", 0, None), (6, "completed", 1, None)}
    assert {r.id: r.delay for r in ledger.backoff(j.withColumn("max_attempts", F.lit(10))).collect()} == {1: 0.5, 2: 0.5, 3: 0.5, 4: 1.0, 5: 4.0, 6: 1.0, 7: 1.0, 8: 60.0}
    assert [r.id for r in ledger.tail(j, 2).collect()] == [2, 3]


def test_audits(spark):
    e = spark.createDataFrame([("1", "person", None), ("2", "alien", "9"), ("3", "person", "1")], "id string, kind string, merged_into_id string")
    assert [(r.key, r.n) for r in audit.duplicates("e", e, ("kind",)).collect()] == [("person", 2)]
    assert [r.id for r in audit.orphans("e", e, "merged_into_id", e).collect()] == ["2"]
    assert [(r.value, r.n) for r in audit.outside("e", e, "kind", ("person",)).collect()] == [("alien", 1)]


def test_deletes_follow_keys(spark):
    t = lambda rows, *cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    tables = {
        "meetings": t([("m",), ("n",)], "id"), "meeting_chunks": t([("c", "m"), ("d", "n")], "id", "meeting_id"), "extraction_runs": t([("r", "m"), ("s", "n")], "id", "meeting_id"),
        "entities": t([("x",), ("y",)], "id"), "entity_aliases": t([("1", "x"), ("2", "y")], "id", "entity_id"),
        "mentions": t([("1", "x", "c", "r"), ("2", "y", "d", "s"), ("3", "y", "d", "r")], "id", "entity_id", "meeting_chunk_id", "extraction_run_id"),
        "relationships": t([("1", "x", "y", "s"), ("2", "y", "y", "s"), ("3", "y", "y", "r")], "id", "source_entity_id", "target_entity_id", "extraction_run_id"),
    }
    ids = lambda d: {k: sorted(r.id for r in v.collect()) for k, v in d.items()}
    left = ids(audit.delete_meetings(tables, t([("m",)], "id")))
    assert (left["meetings"], left["meeting_chunks"], left["extraction_runs"], left["mentions"], left["relationships"]) == (["n"], ["d"], ["s"], ["2"], ["1", "2"])
    left = ids(audit.delete_entities(tables, t([("x",)], "id")))
    assert (left["entities"], left["entity_aliases"], left["mentions"], left["relationships"]) == (["y"], ["2"], ["2", "3"], ["2", "3"])


def test_sync_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    m = meetings(spark, [("1", "a", None), ("2", "b", None)])
    m.union(m).write.parquet(source)
    for _ in range(2):
        streams.sync_stream(spark, spark.readStream.schema(m.schema).parquet(source), target, str(tmp_path / "cp")).awaitTermination(120)
        m.union(meetings(spark, [("3", "c", None)])).write.mode("append").parquet(source)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == ["1", "2"] or sorted(r.id for r in spark.read.parquet(target).collect()) == ["1", "2", "3"]


def test_sync_with_progress(spark, tmp_path):
    """Three batches: new, repeated, stored before, unreadable; the listener hears what the table holds."""
    at = {n: str(tmp_path / n) for n in ("in", "out", "bad", "rows", "cp")}
    progress.seed(meetings(spark, [("0", "old", None)]), at["out"])
    heard = []
    listener = progress.ImportListener(heard.append)
    spark.streams.addListener(listener)

    def run():
        stream = spark.readStream.schema(batches[0].schema).parquet(at["in"])
        progress.sync_with_progress(spark, stream, at["out"], at["bad"], at["rows"], at["cp"], F.col("title") != "?", listener, name="test").awaitTermination(240)

    batches = [meetings(spark, b) for b in ([("0", "new", None), ("1", "a", None), ("1", "a", None), ("2", "?", None)], [("1", "b", None), ("2", None, None), ("3", "c", None)], [("2", "d", None)])]
    try:
        for b in batches:
            b.coalesce(1).write.mode("append").parquet(at["in"])
            run()
        until = time.time() + 60
        while len(heard) < 3 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    want = [(0, 4, 1, 2, 1), (1, 3, 1, 1, 1), (2, 1, 1, 0, 0)]
    rows = spark.read.schema(progress.PROGRESS).parquet(at["rows"]).select("batch", "found", "imported", "skipped", "failed")
    assert sorted(map(tuple, rows.collect())) == want
    assert [tuple(r[c] for c in ("batch", "found", "imported", "skipped", "failed")) for r in heard] == want and heard[0]["rows_per_second"] > 0
    assert sorted((r.id, r.title) for r in spark.read.parquet(at["out"]).collect()) == [("0", "old"), ("1", "a"), ("2", "d"), ("3", "c")]
    assert sorted(r.id for r in spark.read.parquet(at["bad"]).collect()) == ["2", "2"]


def test_progress_of_a_batch_that_runs_again(spark, tmp_path):
    """The third batch's commit is lost, as if the driver had died: it runs again and changes nothing."""
    at = {n: str(tmp_path / n) for n in ("in", "out", "bad", "rows", "cp")}
    m = meetings(spark, [("1", "a", None), ("2", "?", None)])
    m.write.parquet(at["in"])
    for _ in range(2):
        stream = spark.readStream.schema(m.schema).parquet(at["in"])
        progress.sync_with_progress(spark, stream, at["out"], at["bad"], at["rows"], at["cp"], F.col("title") != "?", name="again").awaitTermination(240)
        for f in (tmp_path / "cp" / "commits").glob("*0*"):
            f.unlink()
    got = lambda n: spark.read.parquet(at[n]).collect()
    assert [r.id for r in got("out")] == ["1"] and [r.id for r in got("bad")] == ["2"]
    assert [(r.found, r.imported, r.skipped, r.failed) for r in got("rows")] == [(2, 1, 0, 1)]


def test_published_versions(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert versions.current(spark, table) == 0 and versions.versions(spark, table) == []
    with pytest.raises(FileNotFoundError):
        versions.read(spark, table)
    assert versions.publish(spark, rows(1), table) == 1
    first = versions.read(spark, table)
    assert versions.publish(spark, rows(1, 2), table, expected=1) == 2
    with pytest.raises(versions.Conflict):
        versions.publish(spark, rows(9), table, expected=1)
    assert ids(first) == [1] and ids(versions.read(spark, table)) == [1, 2] and len(list((tmp_path / "t" / "data").iterdir())) == 2
    with versions.pinned(spark, table, 1) as df:
        assert versions.publish(spark, rows(), table) == 3  # an empty version
        assert versions.expire(spark, table, keep=1) == [2] and ids(df) == [1]
    assert ids(versions.read(spark, table)) == [] and versions.read(spark, table).columns == ["id"]
    with pytest.raises(FileNotFoundError), versions.pinned(spark, table, 2):
        pass
    assert versions.expire(spark, table, keep=1) == [1] and versions.versions(spark, table) == [3]
    (tmp_path / "t" / "data" / "left-behind").mkdir()
    assert versions.expire(spark, table, pin_hours=-1) == [] and len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_one_of_two_writers_wins(spark, tmp_path):
    table = str(tmp_path / "t")
    versions.publish(spark, spark.range(1), table)

    def write(k):
        try:
            return versions.publish(spark, spark.range(k), table, expected=1)
        except versions.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        out = list(pool.map(write, (10, 20, 30, 40)))
    assert sorted(out, key=str) == [2, None, None, None]
    assert versions.read(spark, table).count() == (10, 20, 30, 40)[out.index(2)]


def test_counter_stream(spark, tmp_path):
    j = ledger_case(spark)
    j.write.parquet(str(tmp_path / "in"))
    seen = {}
    streams.counter_stream(spark.readStream.schema(j.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, _: seen.update({r.status: r.n for r in df.collect()})).awaitTermination(120)
    assert seen == {r.status: r.n for r in ledger.counts(j).collect()}


def test_mentions_and_relationships_name_their_runs(spark):
    from skein.operators import extract

    answer = json.dumps({"entities": [{"name": n, "type": "person", "confidence": 0.5, "mentions": [{"surface_form": n, "chunk_ordinal": o} for o in (0, 0, 9)]} for n in ("A", "B")]})
    links = json.dumps({"relationships": [{"from_entity": "A", "to_entity": b, "type": "owns", "confidence": 0.75, "evidence_chunk_ordinals": [0]} for b in ("B", "B", "nobody")]})
    answers = lambda text: spark.createDataFrame([("m", text), ("n", text), ("x", "no")], "meeting_id string, answer string")
    chunks = spark.createDataFrame([("m:0", "m", 0), ("n:0", "n", 0)], "id string, meeting_id string, chunk_index long")
    known = spark.createDataFrame([(m, n, n.lower(), "person") for m in "mn" for n in "AB"], "meeting_id string, entity_id string, canonical_name string, kind string")
    ids = known.select("canonical_name", "kind", "entity_id").distinct()
    parsed = extract.parse_entities(answers(answer))
    found = extract.build_mentions(extract.extracted(parsed), ids, chunks).collect()
    assert len(found) == 8 == len({r.id for r in found})  # a chunk that isn't there drops out, duplicates stay
    assert sorted(map(tuple, found)) == sorted(map(tuple, extract.build_mentions(extract.extracted(parsed), ids, chunks).collect()))
    runs = {r.id: r for r in extract.extraction_runs(parsed, "m", "v1", "entities", "2024-01-01", "2024-01-02").collect()}
    assert {runs[r.extraction_run_id].meeting_id for r in found} == {"m", "n"} and sorted(r.completed_at is None for r in runs.values()) == [False, False, True]
    rels = extract.build_relationships(extract.parse_relationships(answers(links)), known).collect()
    assert len(rels) == 4 == len({r.id for r in rels}) and {r.confidence for r in rels} == {0.75} and not {r.extraction_run_id for r in rels} & set(runs)


def test_shuffle_files_of_a_stored_step_go_at_once(spark):
    files = lambda: set(glob.glob(spark.conf.get("spark.local.dir") + "/**/shuffle_*.data", recursive=True))
    before = files()
    rows = storage.stored(spark, spark.range(1000).repartition(7, "id"), "step")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and rows.count() == 1000
