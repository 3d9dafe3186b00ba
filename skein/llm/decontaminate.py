"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import bounded, packed, stored, unpacked
from skein.llm.words import Hasher, PLAIN, lean, plain_words, text_of

#: Words of an item that make a window; a shorter item is one window.
WINDOW = 10
#: Characters of benchmark text in one automaton; a larger benchmark takes several passes.
BLOCK_CHARS = 1_000_000

SPANS = "array<struct<start:int,end:int>>"


class SuffixAutomaton:
    """Automaton of all substrings (in words) of the items, marking windows and short items.

    ``windows[state]`` holds the items that contain the state's suffix of ``window``
    words; ``shorts[state]`` the (length, item) of items shorter than that.
    """

    def __init__(self, items: list[tuple[int, list[str]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.windows: dict[int, set[int]] = {}
        self.shorts: dict[int, list[tuple[int, int]]] = {}
        for item, words in items:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= window:
                    state = self.cut(state)
                    self.windows.setdefault(state, set()).add(item)
            if 0 < len(words) < window:
                self.shorts.setdefault(state, []).append((len(words), item))
        # nearest state on the suffix path, itself included, with a short item
        self.short_at = [-1] * len(self.len)
        for v in sorted(range(len(self.len)), key=self.len.__getitem__):
            self.short_at[v] = v if v in self.shorts else (self.short_at[self.link[v]] if v else -1)
        vocabulary = {w for _, words in items for w in words}
        pairs = {p for _, words in items for p in zip(words, words[1:], strict=False)}
        self.least = min([window, *(len(w) for _, w in items if w)])
        hashes = _hashes(sorted(vocabulary))
        order = np.argsort(hashes)
        self.word_hashes = hashes[order]
        rank = {w: int(r) for w, r in zip(sorted(vocabulary), np.argsort(order), strict=True)}
        self.pair_codes = np.sort(np.array([rank[a] * len(rank) + rank[b] for a, b in pairs], np.int64))

    def cut(self, state: int) -> int:
        """The state of the suffix of ``window`` words."""
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _clone(self, p: int, q: int, w: str) -> int:
        c = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: str) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, w)
        cur = len(self.len)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, w)
        return cur

    def stream(self, words: list[str], at: int, spans: list[tuple[int, int]], items: set[int]) -> int:
        """Follow ``words`` (the first is word ``at`` of its text): add hit spans and items; return the longest match."""
        state, length, longest = 0, 0, 0
        for i, w in enumerate(words, at + 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            longest = max(longest, length)
            if length >= self.window:
                state_w = self.cut(state)
                spans.append((i - self.window, i))
                items |= self.windows[state_w]
            u = self.short_at[state]
            while u > 0:
                for n, item in self.shorts[u]:
                    if n <= length:
                        spans.append((i - n, i))
                        items.add(item)
                u = self.short_at[self.link[u]]
        return longest


def _hashes(words: list[str]) -> np.ndarray:
    h = Hasher(PLAIN)
    return np.concatenate([np.zeros(0, np.uint64), *(x[-1] for x in h.words(pa.array(words, pa.string())))])


def _candidates(a: SuffixAutomaton, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start, end) of words, within a text, whose neighbours all are neighbours in some item.

    Any match of two or more words lies in such a run, so the automaton need not see the
    other words; runs shorter than the shortest window can't hold one.
    """
    none = np.zeros(0, np.int64)
    if not len(h) or not len(a.word_hashes):
        return none, none
    at = np.minimum(np.searchsorted(a.word_hashes, h), len(a.word_hashes) - 1)
    known = a.word_hashes[at] == h
    n = len(a.word_hashes)
    both = np.flatnonzero(known[:-1] & known[1:])
    linked = np.zeros(len(h) + 1, bool)  # linked[i]: word i goes on from word i - 1
    if len(both) and len(a.pair_codes):
        code = at[both] * n + at[both + 1]
        p = np.minimum(np.searchsorted(a.pair_codes, code), len(a.pair_codes) - 1)
        linked[both[a.pair_codes[p] == code] + 1] = True
    linked[first[first < len(h)]] = False
    starts = np.flatnonzero(known & ~linked[:-1])
    ends = np.flatnonzero(known & ~linked[1:]) + 1
    keep = ends - starts >= a.least
    return starts[keep], ends[keep]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _scan(shared, clean: bool):
    """A mapInArrow function: spans, items and longest match of each text; earlier blocks' findings are kept."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, hasher = shared.value, Hasher(PLAIN)
        for batch in batches:
            n, names = batch.num_rows, batch.schema.names
            texts = batch.column("text")
            old_spans = batch.column("spans").to_pylist() if "spans" in names else [[] for _ in range(n)]
            old_items = batch.column("items").to_pylist() if "items" in names else [[] for _ in range(n)]
            longest = batch.column("longest").to_pylist() if "longest" in names else [0] * n
            n_words = np.zeros(n, np.int64)
            spans, items = [[(x["start"], x["end"]) for x in s] for s in old_spans], [set(s) for s in old_items]
            cleaned: dict[int, str] = {}
            for lo, _, low, starts, ends, first, h in hasher.words(texts):
                n_words[lo : lo + len(first) - 1] = np.diff(first)
                run_s, run_e = _candidates(automaton, h, first)
                owner = np.searchsorted(first, run_s, "right") - 1
                for s, e, k in zip(run_s.tolist(), run_e.tolist(), owner.tolist(), strict=True):
                    words = [text_of(low, starts[j], ends[j]) for j in range(s, e)]
                    longest[lo + k] = max(longest[lo + k], automaton.stream(words, s - int(first[k]), spans[lo + k], items[lo + k]))
            merged = [merge_spans(s) for s in spans]
            cols = {
                "n_words": pa.array(n_words),
                "spans": pa.array([[{"start": s, "end": e} for s, e in m] for m in merged], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                "longest": pa.array(longest, pa.int32()),
            }
            if clean:
                for i, m in enumerate(merged):
                    if m:
                        cleaned[i] = cut_spans(texts[i].as_py(), m)
                cols["cleaned"] = pa.array([cleaned.get(i) for i in range(n)], pa.string())
            keep = [x for x in names if x not in cols]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in keep] + list(cols.values()), [*keep, *cols])

    return scan


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them; a blank stays where a span was."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    _, starts, ends, _ = Hasher(PLAIN).bounds(data, np.array([0, len(data)], np.int64))
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : starts[s]])
        at = int(ends[e - 1])
    out.append(raw[at:])
    return b" ".join(x.strip() for x in out).strip().decode()


def _items(benchmark: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """The benchmark in blocks of about BLOCK_CHARS characters. Items without id or words are left out."""
    own = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    for k in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = [(r.item_id, plain_words(r.text)) for r in part.collect()]
        yield sorted((i, w) for i, w in items if w)


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, clean: bool = False) -> DataFrame:
    """``docs`` with n_words, spans (word ranges inside occurrences of windows), items and longest match.

    One pass over the documents for each block of BLOCK_CHARS benchmark characters, without a
    shuffle. The automaton of one block is broadcast, which bounds its size (a block has one item
    at least, so a longer item is a block of its own), and each pass is stored before the next. With
    ``clean`` also ``cleaned``: the text without the spans, null where there are none.
    Null and empty texts have no words; repeated rows each get their result; without
    items nothing is hit. An input column named like an added one gives way to it.
    """
    added = {"n_words": "bigint", "spans": SPANS, "items": "array<bigint>", "longest": "int"} | ({"cleaned": "string"} if clean else {})
    bounded(spark)
    out = docs.drop(*added)
    for k, block in enumerate(_items(benchmark)):
        out = stored(spark, out, "scanned") if k else out  # so that a task holds one automaton, whatever the benchmark
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name not in added)
        schema += "".join(f", {k} {v}" for k, v in added.items())
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(SuffixAutomaton(block, window)), clean), schema)
    return out


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one per document; scan() has the spans and the longest match.

    Null, empty and wordless texts have no words and no hits, repeated rows each get theirs, and
    an empty table of documents gives no rows, one of items no hits.
    """
    found = scan(spark, docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without the words of benchmark spans, and without documents that they cover by more than ``max_coverage``.

    Documents without a hit stay as they are, nulls and empty texts included.
    """
    found = scan(spark, packed(docs, "text"), benchmark, window, clean=True)
    n_hit = F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    kept = found.where(n_hit <= F.col("n_words") * F.lit(max_coverage))
    changed = {"text": F.coalesce("cleaned", "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("cleaned").isNull(), F.col("row.n_chars")).otherwise(F.length("cleaned").cast("long"))
    return unpacked(kept, docs.columns, **changed)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with b as (select item_id, {_WORDS} as w from benchmark where item_id is not null and text is not null),
i as (select distinct item_id, least(len(w), {WINDOW}) as n, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') as g
      from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as k from b where len(w) > 0)),
d as (select row_number() over () as row, doc_id, coalesce({_WORDS}, []) as w from documents),
n as (select distinct n from i),
g as (select row, k, n, array_to_string(w[k:k + n - 1], ' ') as g from (select row, w, n, unnest(range(1, len(w) - n + 2)) as k from d, n where len(w) >= n)),
h as (select distinct row, k, i.n, item_id from g join i on g.g = i.g and g.n = i.n),
p as (select row, count(distinct p)::bigint as n_hit from (select row, unnest(range(k, k + n)) as p from h) group by row),
q as (select row, count(distinct item_id)::bigint as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from h group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p using (row) left join q using (row)
"""
