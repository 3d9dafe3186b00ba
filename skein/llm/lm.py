"""Language-model scores of whole texts from a sharded Elias-Fano bigram trie.

The model interpolates with absolute discounts, which the counts of counts give:

    p(w)     = (c(w) - D(c)) / N + g / (V + 1)                 g: the discounts' sum over N
    p(w | v) = (c(v w) - D(c)) / c(v) + g(v) p(w)

Every pair seen is stored, those seen once too. A text's log10 probability is a sum of
parts that need not meet in one place:

    log p(w), log g(v)                                   from the word's own entry
    gain(v, w) = log(1 + (c(v w) - D) / (c(v) g(v) p(w)))  from the pair's entry

Entries live in shards by word hash; what a task holds at a time is a flush or a shard, whatever the input. Very common words and pairs (over HOT_SHARE of all,
so a bounded number) are broadcast; pairs of a very common first word are dealt by both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.storage import discard, fresh
from skein.llm.elias_fano import Trie, mapped, pack
from skein.llm.shared import bounded, stored, written
from skein.llm.words import Hasher, SPACED, lean

#: Tokens that a task gathers before it passes them on, and tokens of a shard, about.
FLUSH, SHARD = 1_000_000, 500_000
#: Neighbouring shards that make a group: texts are scored, and counts are asked for, by group, so that rows stay few.
GROUP = 4
#: Bytes of rows that a task passes on at a time, about.
PASS = 1 << 20
#: A word or pair of twice this share of all is known as common; at most 1 / HOT_SHARE are.
HOT_SHARE = 1e-4
#: Stand for the start and the end of a text.
START, END = np.uint64(2), np.uint64(1)
_48, _32 = np.uint64((1 << 48) - 1), np.uint64((1 << 32) - 1)


def token_runs(texts: pa.Array, hasher: Hasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last + 1, tokens, tokens of each text): lower-cased words between white space, then END."""
    for lo, hi, _, _, _, first, h in hasher.words(texts):
        yield lo, hi, np.insert(h, first[1:], END), np.diff(first) + 1


@dataclass
class Pairs:
    """Distinct (previous word, word) pairs of a flush: word table, indexes, counts; and each event's text if asked for."""

    table: np.ndarray
    prev: np.ndarray
    cur: np.ndarray
    count: np.ndarray
    docs: np.ndarray | None


def pairs_of(tokens: np.ndarray, sizes: np.ndarray, with_docs: bool) -> Pairs:
    table, ids = np.unique(np.concatenate([[START], tokens]), return_inverse=True)
    code = ids[:-1].astype(np.int64)
    code[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = ids[0]
    code *= len(table)
    code += ids[1:]
    del ids
    docs = None
    if with_docs:
        order = np.argsort(code, kind="stable")
        code, docs = code[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        del order
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, count = code[at], np.diff(np.append(at, len(code)))
    else:
        code, count = np.unique(code, return_counts=True)
    return Pairs(table, code // len(table), code % len(table), count, docs)


def flushes(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(tokens, tokens of each text, values of ``column``) of about FLUSH tokens at a time; texts stay whole."""
    hasher = Hasher(SPACED)
    held, sizes, ids, n = [], [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            names = b.column(column).slice(at, 256).to_pylist()
            for lo, hi, t, s in token_runs(b.column("text").slice(at, 256), hasher):
                held.append(t)
                sizes.append(s)
                ids += names[lo:hi]
                n += len(t)
                if n >= FLUSH:
                    whole = np.concatenate(held), np.concatenate(sizes), ids
                    held, sizes, ids, n = [], [], [], 0  # the parts go before the whole is worked on
                    yield whole
    if n:
        yield np.concatenate(held), np.concatenate(sizes), ids


@lean
def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and pairs of at least HOT_SHARE of a flush, and its number of tokens (as word 0)."""
    for tokens, sizes, _ in flushes(batches, "doc_id"):
        words, count = np.unique(tokens, return_counts=True)
        least = HOT_SHARE * len(tokens)
        hot = np.append(words[count >= least], START)
        n = np.append(count[count >= least], len(sizes))
        hot, n = hot[np.argsort(hot)], n[np.argsort(hot)]
        before = np.concatenate([[START], tokens[:-1]])
        before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = START
        i, j = (np.minimum(np.searchsorted(hot, x), len(hot) - 1) for x in (before, tokens))
        both = (hot[i] == before) & (hot[j] == tokens)
        code, m = np.unique(i[both] * len(hot) + j[both], return_counts=True)
        code, m = code[m >= least], m[m >= least]
        a = np.concatenate([[0], hot, hot[code // len(hot)]]).astype(np.uint64)
        b = np.concatenate([[0], np.zeros(len(hot)), hot[code % len(hot)]]).astype(np.uint64) if len(code) else np.zeros(len(hot) + 1, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.concatenate([[len(tokens)], n, m]).astype(np.int64))], ["a", "b", "n"])


@dataclass
class Hot:
    """Common words and pairs (sorted), and how many shards there are."""

    words: np.ndarray
    pairs: np.ndarray  # (n, 2)
    shards: int

    @property
    def groups(self) -> int:
        return -(-self.shards // GROUP)

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return self.words[at] == words

    def shard(self, prev: np.ndarray, prev_hot: np.ndarray, cur: np.ndarray) -> np.ndarray:
        """By the first word's low 48 bits; a common first word's pairs are dealt by the second word too."""
        own = (prev & _48) % np.uint64(self.shards)
        also = np.where(prev_hot, (cur & _48) % np.uint64(self.shards), np.uint64(0))
        return ((own + also) % np.uint64(self.shards)).astype(np.int64)


def find_common(docs: DataFrame) -> Hot:
    """One pass over all texts. A share of 2 * HOT_SHARE overall means HOT_SHARE in the flushes that hold half of it."""
    rows = docs.mapInArrow(_common, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    total = rows.where("a = 0").agg(F.sum("n")).first()[0] or 0
    hot = rows.where((F.col("a") != 0) & (F.col("n") >= HOT_SHARE * total)).collect()  # 2 / HOT_SHARE at most
    words = sorted({r.a % (1 << 64) for r in hot if not r.b} | {int(START), int(END)})
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in hot if r.b]
    return Hot(np.array(words, np.uint64), np.array(sorted(pairs), np.uint64).reshape(-1, 2), max(1, math.ceil(total / SHARD)))


def _cut(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal, sorted shard numbers."""
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    for lo, hi in zip(at, np.append(at[1:], len(shard)), strict=True):
        yield int(shard[lo]), slice(int(lo), int(hi))


def _six(x: np.ndarray) -> bytes:
    """Low 48 bits of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _narrow(n: np.ndarray) -> np.ndarray:
    """Counts in four bytes each, or eight where one needs them."""
    return n.astype(np.uint32 if not len(n) or n.max() < 1 << 32 else np.uint64)


BLOB = "shard long, kind int, origin long, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["shard", "kind", "origin", "a", "b", "c", "d", "e"]


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def _passed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of blobs in batches of about PASS bytes, formed as they go."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(map(len, r[3:]))
        if size >= PASS:
            yield _blobs(held)
            held, size = [], 0
    if held:
        yield _blobs(held)


def _dealt(p: Pairs, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """(order of the pairs by shard, their shards)."""
    known, shard = hot.is_hot(p.table), np.empty(len(p.prev), np.int32)
    for at in range(0, len(shard), 1 << 17):  # few temporary copies
        prev, cur = p.prev[at : at + (1 << 17)], p.cur[at : at + (1 << 17)]
        shard[at : at + (1 << 17)] = hot.shard(p.table[prev], known[prev], p.table[cur])
    order = np.argsort(shard, kind="stable")
    return order, shard[order]


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, run lengths) of a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[at], np.diff(np.append(at, len(x)))


def _count_out(shared):
    """Counted pairs of each flush, one row a shard."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Hot = shared.value
        for tokens, sizes, _ in flushes(batches, "doc_id"):
            yield from _passed(rows(pairs_of(tokens, sizes, False), hot))

    def rows(p: Pairs, hot: Hot) -> Iterator[tuple]:
        order, shard = _dealt(p, hot)
        for s, at in _cut(shard):
            ids, n = _grouped(p.prev[order[at]])
            yield s, 0, 0, p.table[ids].tobytes(), n.astype(np.uint32).tobytes(), _six(p.table[p.cur[order[at]]]), p.count[order[at]].astype(np.uint32).tobytes(), b""

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows of each shard, one after another; input is sorted by shard."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in _NAMES), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        shard = ahead[0]

        def own() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == shard:  # noqa: B023
                yield ahead
                ahead = next(rows, None)

        part = own()
        yield shard, part
        for _ in part:
            pass


COUNTED = "shard long, words binary, counts binary, once binary, twice binary, more binary, place binary, next binary, n binary, stats array<long>, hot array<struct<a:long,c:long,n1:long,n2:long,n3:long>>"


def _count_in(shared):
    """One row a shard: its words with counts of their followers, its pairs, counts of counts."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Hot = shared.value
        for shard, rows in _by_shard(batches):
            prev, cur, n = [], [], []
            for r in rows:
                prev.append(np.repeat(np.frombuffer(r[3], np.uint64), np.frombuffer(r[4], np.uint32)))
                cur.append(_unsix(r[5]))
                n.append(np.frombuffer(r[6], np.uint32).astype(np.int64))
            prev, cur, n = np.concatenate(prev), np.concatenate(cur), np.concatenate(n)
            words, place = np.unique(prev, return_inverse=True)
            table, c = np.unique(cur, return_inverse=True)
            code, which = np.unique(place.astype(np.int64) * len(table) + c, return_inverse=True)
            n = np.bincount(which, weights=n).astype(np.int64)
            place, cur = code // len(table), table[code % len(table)]
            sums = [np.bincount(place, weights=w, minlength=len(words)).astype(np.int64) for w in (n, n == 1, n == 2, n > 2)]
            common = hot.is_hot(words)
            own = sums[0][~common]
            stats = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((own == k).sum()) for k in (1, 2, 3, 4)] + [len(own), int(own.sum())]
            partial = [dict(zip(("a", "c", "n1", "n2", "n3"), (int(words[i].astype(np.int64)), *(int(s[i]) for s in sums)), strict=True)) for i in np.flatnonzero(common)]
            blobs = [words.tobytes(), sums[0].tobytes(), *(s.astype(np.uint32).tobytes() for s in sums[1:]), place.astype(np.uint32).tobytes(), _six(cur), _narrow(n).tobytes()]
            kinds = [pa.int64(), *[pa.binary()] * 8, pa.list_(pa.int64()), pa.list_(pa.struct([(k, pa.int64()) for k in ("a", "c", "n1", "n2", "n3")]))]
            names = ["shard", "words", "counts", "once", "twice", "more", "place", "next", "n", "stats", "hot"]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([shard, *blobs, stats, partial], kinds, strict=True)], names)

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 1, 2 and above, from the numbers n[0] .. n[3] of things seen 1 to 4 times."""
    d = [0.5, 0.8, 1.0]
    if min(n[:3]) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.array([min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)])


@dataclass
class Stats:
    """What all shards need: totals, discounts, and the common words' entries."""

    hot: Hot
    n: int
    v: int
    texts: int
    single: np.ndarray
    pair: np.ndarray
    rest: float  # g / (V + 1)
    count: np.ndarray  # of the common words, in their order
    backoff: np.ndarray  # log10 g(v) of the common words
    mass: np.ndarray  # c(v) g(v) of the common words

    def log_p(self, count: np.ndarray) -> np.ndarray:
        """log10 p(w) of words seen ``count`` times."""
        if not self.n:
            return np.zeros(len(count))
        d = np.where(count > 0, self.single[np.clip(count, 1, 3) - 1], 0)
        return np.log10((count - d) / self.n + self.rest)

    def log_base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.n + self.v + 1))

    def hot_place(self, words: np.ndarray) -> np.ndarray:
        """Place among the common words, -1 for others."""
        at = np.minimum(np.searchsorted(self.hot.words, words), len(self.hot.words) - 1)
        return np.where(self.hot.words[at] == words, at, -1)


def summarise(counted: DataFrame, hot: Hot, texts: int) -> Stats:
    sums = [F.sum(F.col("stats")[i]) for i in range(10)]
    *seen, types, tokens = [int(x or 0) for x in counted.agg(*sums).first()]
    rows = counted.select(F.explode("hot").alias("h")).groupBy("h.a").agg(*(F.sum(f"h.{k}").alias(k) for k in ("c", "n1", "n2", "n3"))).collect()  # 1 / HOT_SHARE at most
    place = {int(w): i for i, w in enumerate(hot.words)}
    count, parts = np.zeros(len(hot.words), np.int64), np.zeros((len(hot.words), 3))
    for r in rows:
        i = place[r.a % (1 << 64)]
        count[i], parts[i] = r.c, (r.n1, r.n2, r.n3)
    pair = discounts(seen[:4])
    mass = parts @ pair
    backoff = np.log10(np.where(count > 0, mass / np.maximum(count, 1), 1.0))
    count[place[int(START)]], count[place[int(END)]] = 0, texts  # no token, and one a text
    own = count[count > 0]
    n, v = tokens + int(own.sum()), types + len(own)
    single = discounts([a + int((own == k).sum()) for k, a in enumerate(seen[4:], 1)])
    ones = [seen[4] + int((own == 1).sum()), seen[5] + int((own == 2).sum())]
    left = single @ np.array([*ones, v - sum(ones)])
    return Stats(hot, n, v, texts, single, pair, left / max(n, 1) / (v + 1), count, backoff, mass)


def _ask(shared):
    """From counted shards: their word counts (kind 0) and, for each group of shards, the words whose counts they need (kind 1)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st: Stats = shared.value
        hot48 = np.sort(st.hot.words & _48)
        for b in batches:
            for shard, words, counts, nxt in zip(*(b.column(c).to_pylist() for c in ("shard", "words", "counts", "next")), strict=True):
                w = np.frombuffer(words, np.uint64)
                cold = ~st.hot.is_hot(w)
                rows = [(shard // GROUP, 0, shard, w[cold].tobytes(), np.frombuffer(counts, np.int64)[cold].tobytes(), b"", b"", b"")]
                need = np.unique(_unsix(nxt))
                need = need[~np.isin(need, hot48)]
                to = (need % np.uint64(st.hot.shards)).astype(np.int64) // GROUP
                order = np.argsort(to, kind="stable")
                rows += [(s, 1, shard, need[order[at]].tobytes(), b"", b"", b"", b"") for s, at in _cut(to[order])]
                yield from _passed(rows)

    return run


@lean
def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a group's word counts: what was asked of it, back to the shard that asked."""
    for group, rows in _by_shard(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for r in rows:
            if r[1] == 0:
                keys, counts = np.concatenate([keys, np.frombuffer(r[3], np.uint64) & _48]), np.concatenate([counts, np.frombuffer(r[4], np.int64)])
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
                continue
            need, got = np.frombuffer(r[3], np.uint64), np.zeros(len(r[3]) // 8, np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, need), len(keys) - 1)
                got = np.where(keys[at] == need, counts[at], 0)
            yield _blobs([(r[2], 0, group, r[3], got.tobytes(), b"", b"", b"")])


def _build(shared):
    """From answers (kind 0) and the counted shard (kind 1): the shard's trie."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st: Stats = shared.value
        for shard, rows in _by_shard(batches):
            keys, counts = [st.hot.words & _48], [st.count]
            for r in rows:
                if r[1] == 0:
                    keys.append(np.frombuffer(r[3], np.uint64))
                    counts.append(np.frombuffer(r[4], np.int64))
                    continue
                k, c = np.concatenate(keys), np.concatenate(counts)
                order = np.argsort(k, kind="stable")
                k, c = k[order], c[order]
                parts = mapped(r[3])
                words, count, place, n = parts["words"], parts["counts"], parts["place"].astype(np.int64), parts["n"].astype(np.int64)
                cur = _unsix(parts["next"].tobytes())
                at = st.hot_place(words)
                mass = np.where(at >= 0, st.mass[at], parts["once"] * st.pair[0] + parts["twice"] * st.pair[1] + parts["more"] * st.pair[2])
                backoff = np.where(at >= 0, st.backoff[at], np.log10(mass / np.maximum(count, 1)))
                of = np.minimum(np.searchsorted(k, cur), len(k) - 1)
                gain = np.log10(1 + (n - st.pair[np.clip(n, 1, 3) - 1]) / (mass[place] * (10 ** st.log_p(c))[of]))
                trie = Trie.build(words, np.where(at >= 0, 0, count), backoff, place, (cur >> np.uint64(16)) & _32, gain)
                yield _blobs([(shard, 0, shard, pack(trie), b"", b"", b"", b"")])

    return run


@dataclass
class Model:
    """Totals and common words on the driver; shards of the trie as a table of blobs in shared storage."""

    stats: Stats
    shards: DataFrame


def _dealt_rows(rows: DataFrame, groups: int) -> DataFrame:
    """A task for each group of shards, about; it takes one shard or group after the other."""
    return rows.repartition(max(1, min(groups, 100_000)), "shard").sortWithinPartitions("shard", "kind", "origin")


def train(spark: SparkSession, docs: DataFrame, hot: Hot) -> Model:
    """Counts all of ``docs`` (doc_id, text): pairs are added up in tasks, then by shard; then each shard's trie is built."""
    share = spark.sparkContext.broadcast
    h = share(hot)
    texts = docs.count()
    path = fresh(spark, "counts")
    counted = written(spark, _dealt_rows(docs.mapInArrow(_count_out(h), BLOB), hot.groups).mapInArrow(_count_in(h), COUNTED), path)
    st = summarise(counted, hot, texts)
    s = share(st)
    asked = counted.select("shard", "words", "counts", "next").mapInArrow(_ask(s), BLOB)
    answers = _dealt_rows(asked, hot.groups).mapInArrow(_answer, BLOB)
    parts = counted.drop("stats", "hot").mapInArrow(_as_parts, BLOB)
    built = _dealt_rows(answers.union(parts), hot.groups).mapInArrow(_build(s), BLOB)
    trie = stored(spark, built, "trie")
    discard(spark, path)  # the trie has it all
    return Model(st, trie)


@lean
def _as_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"words": "u8", "counts": "i8", "once": "u4", "twice": "u4", "more": "u4", "place": "u4", "next": "u1"}
    for b in batches:
        for i in range(b.num_rows):
            arrays = {k: np.frombuffer(b.column(k)[i].as_py(), f"<{t}") for k, t in kinds.items()}
            n = b.column("n")[i].as_py()
            arrays["n"] = np.frombuffer(n, "<u4" if len(n) == 4 * len(arrays["place"]) else "<u8")
            shard = b.column("shard")[i].as_py()
            yield _blobs([(shard, 1, shard, pack(arrays), b"", b"", b"", b"")])


def _sums(docs: np.ndarray, n: int, *values: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(docs, weights=v, minlength=n) for v in values]


@dataclass
class HotPairs:
    """Gains of the common pairs; (first word's place) * words + (second word's place), sorted."""

    codes: np.ndarray
    gains: np.ndarray


def _score_out(shared, shared_pairs):
    """Of each flush: what common words and pairs add (kind -1), and one row a group of shards with the other pairs and their texts."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st: Stats = shared.value
        hp: HotPairs = shared_pairs.value
        end = np.array([st.texts])
        part = TaskContext.get().partitionId()
        for k, (tokens, sizes, ids) in enumerate(flushes(batches, "doc_id")):
            origin, n = (part << 20) + k, len(sizes)
            p = pairs_of(tokens, sizes, True)
            where = st.hot_place(p.table)
            a = where[p.prev]
            known = a >= 0
            real = known & (p.table[p.prev] != START)
            count = np.where(real, st.count[a], 0)
            here = np.where(known, st.backoff[a], 0) + np.where(real, st.log_p(count), 0)
            base, seen = np.where(real, st.log_base(count), 0), real & (count > 0)
            b = where[p.cur]
            code = np.where(known & (b >= 0), a * len(st.hot.words) + b, -1)
            at = np.minimum(np.searchsorted(hp.codes, code), max(len(hp.codes) - 1, 0))
            done = (hp.codes[at] == code) if len(hp.codes) else np.zeros(len(code), bool)
            if len(hp.codes):
                here = here + np.where(done, hp.gains[at], 0)
            n_known, base, score = (_sums(p.docs, n, np.repeat(x, p.count))[0] for x in (seen, base, here))  # a number an event, for one sum at a time
            del a, b, known, real, count, here, seen, code, at
            n_known, base, score = n_known + (st.texts > 0), base + st.log_base(end), score + st.log_p(end)
            yield _blobs([(origin, -1, 0, pack({"ids": np.array([x if x is not None else 0 for x in ids], np.int64), "null": np.array([x is None for x in ids], np.uint8), "sizes": sizes.astype(np.int64), "known": n_known, "base": base, "score": score}), b"", b"", b"", b"")])
            yield from _passed(rows(p, st.hot, done, origin, n))

    def rows(p: Pairs, hot: Hot, done: np.ndarray, origin: int, n: int) -> Iterator[tuple]:
        starts = np.concatenate([[0], np.cumsum(p.count)])
        order, shard = _dealt(p, hot)
        left = ~done[order]
        order, shard = order[left], shard[left]
        kind = "u2" if n <= 1 << 16 else "u4"
        for s, cut in _cut(shard // GROUP):
            o = order[cut]
            w, m = _grouped((shard[cut] % GROUP) * np.int64(len(p.table)) + p.prev[o])
            runs = np.bincount(w // len(p.table), minlength=GROUP)  # first words of each shard, which follow each other
            many = p.count[o]
            pick = np.repeat(starts[o] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            yield s, 1, origin, p.table[w % len(p.table)].tobytes(), np.append(m, runs).astype(np.uint32).tobytes(), ((p.table[p.cur[o]] >> np.uint64(16)) & _32).astype(np.uint32).tobytes(), many.astype(np.uint32).tobytes(), p.docs[pick].astype(kind).tobytes()

    return run


def _added(rows: list[tuple], tries: dict[int, Trie], st: Stats) -> Iterator[tuple]:
    """What each of a group's rows of pairs adds to its texts; all are looked up at once."""
    numbers = [np.frombuffer(r[4], np.uint32) for r in rows]
    words, m = np.concatenate([np.frombuffer(r[3], np.uint64) for r in rows]), np.concatenate([x[:-GROUP] for x in numbers])
    nxt = np.concatenate([np.frombuffer(r[5], np.uint32) for r in rows])
    home = np.concatenate([np.repeat(r[0] * GROUP + np.arange(GROUP), x[-GROUP:]) for r, x in zip(rows, numbers, strict=True)])
    of, place = np.repeat(np.arange(len(words)), m), np.full(len(words), -1)
    count, backoff, gain = np.zeros(len(words), np.int64), np.zeros(len(words)), np.zeros(len(nxt))
    for shard, trie in tries.items():
        mine, pairs = np.flatnonzero(home == shard), np.flatnonzero(home[of] == shard)
        place[mine], count[mine], backoff[mine] = trie.lookup(words[mine])
        gain[pairs] = trie.gain_of(place[of[pairs]], nxt[pairs])
    cold = ~st.hot.is_hot(words)
    known, base, own = (cold & (count > 0))[of], np.where(cold, st.log_base(count), 0)[of], np.where(cold, st.log_p(count) + backoff, 0)[of] + gain
    lo = 0
    for r in rows:
        many = np.frombuffer(r[6], np.uint32)
        hi = lo + len(many)
        docs = np.frombuffer(r[7], "u2" if len(r[7]) == 2 * int(many.sum()) else "u4").astype(np.int64)
        ids, at = np.unique(docs, return_inverse=True)
        k, b, s = _sums(at, len(ids), *(np.repeat(x[lo:hi], many) for x in (known, base, own)))
        yield r[2], 1, r[0], ids.astype(np.uint32).tobytes(), k.astype(np.uint32).tobytes(), b.tobytes(), s.tobytes(), b""
        lo = hi


def _score_in(shared):
    """In each group the shards' tries (kind 0), then flushes' pairs (kind 1): rows of what each adds to its texts. Kind -1 passes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st: Stats = shared.value
        for _, rows in _by_shard(batches):
            tries, held, size = {}, [], 0  # tries are mapped from files
            for r in rows:
                if r[1] == -1:
                    yield _blobs([r])
                    continue
                if r[1] == 0:
                    tries[r[2]] = Trie(mapped(r[3]))
                    continue
                held.append(r)
                size += sum(map(len, r[3:]))
                if size >= PASS:
                    yield from _passed(_added(held, tries, st))
                    held, size = [], 0
            if held:
                yield from _passed(_added(held, tries, st))

    return run


@lean
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of each flush (kind -1 comes first) and returns its texts."""
    for _, rows in _by_shard(batches):
        own = {}
        for r in rows:
            if r[1] == -1:
                own = {k: np.array(v) for k, v in mapped(r[3]).items()}
                continue
            ids = np.frombuffer(r[3], np.uint32)
            own["known"][ids] += np.frombuffer(r[4], np.uint32)
            own["base"][ids] += np.frombuffer(r[5], np.float64)
            own["score"][ids] += np.frombuffer(r[6], np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own["ids"], mask=own["null"].astype(bool)), pa.array(own["sizes"]), pa.array(own["known"].astype(np.int64)), pa.array(own["base"]), pa.array(own["score"])],
            ["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )


def _hot_gains(shared):
    """Gains of the common pairs, from the shards that hold them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Hot = shared.value.hot
        pairs = hot.pairs
        mine = hot.shard(pairs[:, 0], np.ones(len(pairs), bool), pairs[:, 1])
        for b in batches:
            for shard, blob in zip(b.column("shard").to_pylist(), b.column("a").to_pylist(), strict=True):
                own = pairs[mine == shard]
                if len(own):
                    trie = Trie(mapped(blob))
                    place = trie.words.find(own[:, 0])
                    gain = trie.gain_of(place, (own[:, 1] >> np.uint64(16)) & _32)
                    yield pa.RecordBatch.from_arrays([pa.array(own[:, 0].astype(np.int64)), pa.array(own[:, 1].astype(np.int64)), pa.array(gain)], ["a", "b", "g"])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, base_score, score), one for each row of ``docs`` (doc_id, text)."""
    st = model.stats
    share = spark.sparkContext.broadcast
    s = share(st)
    rows = model.shards.select("shard", "a").mapInArrow(_hot_gains(s), "a long, b long, g double").collect() if len(st.hot.pairs) else []  # 1 / HOT_SHARE at most
    place = {int(w): i for i, w in enumerate(st.hot.words)}
    codes = np.array([place[r.a % (1 << 64)] * len(st.hot.words) + place[r.b % (1 << 64)] for r in rows], np.int64)
    order = np.argsort(codes)
    pairs = HotPairs(codes[order], np.array([r.g for r in rows], np.float64)[order])
    events = docs.mapInArrow(_score_out(s, share(pairs)), BLOB)
    n = st.hot.groups
    tries = model.shards.withColumn("shard", F.floor(F.col("shard") / GROUP))
    added = _dealt_rows(events.union(tries), n).mapInArrow(_score_in(s), BLOB)
    return _dealt_rows(added, n).mapInArrow(_gather, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_corpus(spark: SparkSession, docs: DataFrame, held_out: Column) -> DataFrame:
    """Train on the rows where ``held_out`` is not true, score all rows.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). A null
    or empty text is its end alone. Repeated rows count and are scored each; a null doc_id
    is not held out. With nothing to train on every probability is 1, the base's too. An empty table
    gives no rows, a very long text is a flush of its own, and other columns are not looked at.
    """
    bounded(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(spark, own.where(~F.coalesce(held_out, F.lit(False))), find_common(own))
    out = score(spark, own, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.stats.n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_corpus(spark, docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
