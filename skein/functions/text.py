"""Column functions on text: cleaning, folding, fences, time stamps and name normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line breaks of Unicode.
SPACE = r"[\x09-\x0D\x20\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: ISO 8601 with time and zone; a date alone doesn't count.
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def clean_text(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def parse_iso(text: Column) -> Column:
    """The time, with or without a fraction of a second; null for anything else."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(text))


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def matches(text: Column, query: str, wildcards: bool = False) -> Column:
    """Whether ``text`` contains ``query``, A-Z aside; with ``wildcards`` % and _ stand for any characters."""
    folded = query.translate(str.maketrans(UPPER, LOWER))
    if wildcards:
        return fold_ascii(text).like("%" + folded.replace("\\", "\\\\") + "%")
    return fold_ascii(text).contains(folded)


def strip_fences(text: Column) -> Column:
    """What stands between a leading fence line and the last fence; texts without a leading fence only trimmed."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*)$", 1)
    inner = F.when(body.contains("```"), F.regexp_extract(body, r"(?s)^(.*)```", 1)).otherwise(body)
    return F.when(t.rlike(r"^```[^\n]*\n"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(t)


def _bare(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: s if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)))


def strip_accents(text: Column) -> Column:
    """Decomposed, without combining marks; letters without a decomposition stay. No built-in function does this."""
    return F.pandas_udf(_bare, "string")(text)


def normalize_name(name: Column) -> Column:
    """Lower case, no diacritics, a-z, 0-9 and single blanks only; ASCII names skip the Python step."""
    low = F.lower(name)
    plain = F.regexp_replace(low, r"[^a-z0-9\s]", "")
    bare = F.regexp_replace(strip_accents(F.when(low.rlike(r"[^\x00-\x7F]"), low)), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(F.when(low.rlike(r"[^\x00-\x7F]"), bare).otherwise(plain), r"\s+", " "))


def duration_label(seconds: Column) -> Column:
    """Nm below an hour, else Hh Mm."""
    minutes = F.floor(seconds / 60).cast("int")
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))
