"""Column functions on single values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import extract


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("given", "want"), [("  a \n\n b\t", "a b"), ("a  b　", "a b"), ("\u0085x", "x"), ("", ""), (None, None)])
def test_clean_text(spark, given, want):
    assert one(spark, given, text.clean_text) == want


@pytest.mark.parametrize(("given", "want"), [("2026-01-02T03:04:05Z", "2026-01-02 03:04:05"), ("2026-01-02T03:04:05.250Z", "2026-01-02 03:04:05.250000"), ("2026-01-02T03:04:05+02:00", "2026-01-02 01:04:05"), ("2026-01-02", None), ("2026-13-02T03:04:05Z", None), ("soon", None), (None, None)])
def test_parse_iso(spark, given, want):
    got = one(spark, given, text.parse_iso)
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize(("given", "want"), [("```json\n{}\n```", "{}"), ("  {} ", "{}"), ("```{}```", "```{}```"), ("```\na```b\n``` tail", "a```b"), ("```\nopen", "open"), (None, None)])
def test_strip_fences(spark, given, want):
    assert one(spark, given, text.strip_fences) == want


@pytest.mark.parametrize(("given", "want"), [("Harper   Reed.", "harper reed"), ("Élan Ñandú-x", "elan nandux"), ("Søren", "sren"), ("北京", ""), ("", ""), (None, None)])
def test_normalize_name(spark, given, want):
    assert one(spark, given, text.normalize_name) == want


@pytest.mark.parametrize(("seconds", "want"), [(0.0, "0m"), (3599.0, "59m"), (3600.0, "1h 0m"), (5461.0, "1h 31m")])
def test_duration_label(spark, seconds, want):
    assert one(spark, seconds, text.duration_label, "double") == want


@pytest.mark.parametrize(("query", "wildcards", "want"), [("ACME", False, True), ("a_m", False, False), ("a_m", True, True), ("a%e", True, True), ("É", False, False), ("c\\m", True, False)])
def test_matches(spark, query, wildcards, want):
    assert one(spark, "the acme écru", lambda c: text.matches(c, query, wildcards)) is want


def test_kinds(spark):
    assert [one(spark, t, extract.entity_kind) for t in ("ORG", "action_item", "BlogIdea", "thing", None)] == ["organization", "actionItem", "blogIdea", "other", "other"]
    assert [one(spark, t, extract.relationship_kind) for t in ("WORKSFOR", "works_for", "partOf")] == ["worksFor", "relatesTo", "partOf"]


ANSWERS = [
    ('{"entities": [{"name": "A", "type": "org", "confidence": 0.5, "mentions": [{"surface_form": "a", "chunk_ordinal": 1.0}], "extra": 1}]}', None),
    ('{"entities": [{"name": "A", "type": "org", "confidence": "0.5", "mentions": []}]}', "a field is missing or of another type"),
    ('{"entities": [{"type": "org", "confidence": 0.5, "mentions": []}]}', "a field is missing or of another type"),
    ('{"entities": [{"name": "A", "type": "org", "confidence": 0.5, "mentions": [{"surface_form": "a", "chunk_ordinal": 1.5}]}]}', "a field is missing or of another type"),
    ('{"entities": [{"name": "A", "type": "org", "confidence": 0.5}]}', "a field is missing or of another type"),
    ('{"entities": []}', "no entities"),
    ('{"entities": [', "not an entity answer"),
    ("sorry", "not an entity answer"),
    (None, "not an entity answer"),
]


def test_parse_entities(spark):
    rows = spark.createDataFrame([(str(i), a) for i, (a, _) in enumerate(ANSWERS)], "meeting_id string, answer string")
    assert [r.reason for r in extract.parse_entities(rows).orderBy("meeting_id").collect()] == [w for _, w in ANSWERS]


def test_call_model_keeps_errors_and_skips_done(spark):
    prompts = spark.createDataFrame([("a", "s", "1"), ("b", "s", "x"), ("c", "s", "3")], "meeting_id string, system string, message string")
    done = spark.createDataFrame([("c",)], "meeting_id string")
    got = {r.meeting_id: (r.answer, bool(r.error)) for r in extract.call_model(prompts, lambda s, m: str(int(m) + 1), done).collect()}
    assert got == {"a": ("2", False), "b": (None, True)}
