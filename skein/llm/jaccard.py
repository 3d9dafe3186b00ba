"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.shared import components, small, stored
from skein.llm.words import Hasher, PLAIN, lean, mix

#: Words of a shingle and the least Jaccard similarity of a link.
SHINGLE, THRESHOLD = 5, 0.8
#: Prefix tries, hashes of a full signature prefix, and the recall at THRESHOLD to be reached.
TREES, DEPTH, RECALL = 24, 12, 0.999
#: Texts of one block; blocks are compared two at a time. A larger candidate component is cut in the order of a trie.
BLOCK = 256
SEED = 11


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Matched prefixes are shortened from ``depth`` until a pair at the threshold meets in some trie often enough.

    With prefixes of d hashes in L tries that is 1 - (1 - t^d)^L. Every pair that a longer
    prefix finds, a shorter one finds too, so only the last length need be looked up.
    """
    d = depth
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def shingle_sets(h: np.ndarray, first: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles of a slice, index of each text's first shingle): n words; a shorter text is one shingle."""
    words = np.diff(first)
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    if not len(h):
        return np.zeros(0, np.uint64), at
    own = np.repeat(np.arange(len(words)), count)
    pos = first[:-1][own] + np.arange(at[-1]) - at[:-1][own]
    out = np.zeros(len(pos), np.uint64)
    last = first[1:][own]
    for k in range(n):
        j = pos + k
        w = h[np.minimum(j, len(h) - 1)] * (j < last)
        out = out * np.uint64(0x9E3779B97F4A7C15) + w
    return mix(out), at


def _params(trees: int, depth: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    full = np.iinfo(np.uint64).max
    return rng.integers(0, full, (trees, depth), np.uint64) | np.uint64(1), rng.integers(0, full, (trees, depth), np.uint64)


def _signatures(trees: int, depth: int, shingle: int):
    """A mapInArrow function: (doc_id, sign, text_key, labels, path).

    labels are the prefixes of ``depth`` hashes in each trie; path is the first trie's full
    prefix of DEPTH hashes, whose byte order is the order of that trie's leaves.
    """
    mult, plus = _params(trees, depth)
    further, beyond = _params(1, max(0, DEPTH - depth), SEED + 1)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PLAIN, 1 << 19)
        for batch in batches:
            keys, labels, paths = [], [], []
            for lo, hi, low, starts, ends, first, h in hasher.words(batch.column("text")):
                s, at = shingle_sets(h, first, shingle)
                some = np.flatnonzero(np.diff(at))
                lab = np.zeros((hi - lo, trees), np.uint64)
                path = np.zeros((hi - lo, max(DEPTH, depth)), ">u4")
                for d in range(depth, DEPTH if len(some) else 0):
                    path[some, d] = np.minimum.reduceat(s * further[0, d - depth] + beyond[0, d - depth], at[:-1][some]) >> np.uint64(32)
                for t in range(trees if len(some) else 0):
                    for d in range(depth):
                        least = np.minimum.reduceat(s * mult[t, d] + plus[t, d], at[:-1][some])
                        if not t:
                            path[some, d] = least >> np.uint64(32)
                        lab[some, t] = mix(lab[some, t] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(d))
                # words joined by one blank: the separators become blanks, runs of them one
                for i in range(hi - lo):
                    if first[i] == first[i + 1]:
                        keys.append(None)
                        labels.append(None)
                        paths.append(None)
                        continue
                    raw = low[starts[first[i]] : ends[first[i + 1] - 1]].tobytes()
                    keys.append(hashlib.blake2b(b" ".join(x for x in raw.split(b"\xff") if x), digest_size=16).digest())
                    labels.append(lab[i].view(np.int64))
                    paths.append(path[i].tobytes())
            columns = [batch.column("doc_id"), batch.column("sign"), pa.array(keys, pa.binary()), pa.array(labels, pa.list_(pa.int64())), pa.array(paths, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sign", "text_key", "labels", "path"])

    return run


def _shingles(shingle: int):
    """A mapInArrow function: ``text`` becomes ``set``, its sorted distinct shingle hashes as bytes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PLAIN, 1 << 19)
        for batch in batches:
            sets = []
            for lo, hi, _, _, _, first, h in hasher.words(batch.column("text")):
                s, at = shingle_sets(h, first, shingle)
                sets += [np.unique(s[at[i] : at[i + 1]]).tobytes() for i in range(hi - lo)]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "set"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|a & b| of all a of ``left`` and b of ``right``, as products of 0/1 matrices over the shingles of both sides."""
    vocabulary, count = np.unique(np.concatenate(left + ([] if left is right else right)), return_counts=True)
    if left is right:
        vocabulary = vocabulary[count > 1]
    else:
        vocabulary = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)

    def rows(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        m = np.zeros((len(sets), len(part)), np.float32)
        for i, s in enumerate(sets):
            if len(part):
                at = np.minimum(np.searchsorted(part, s), len(part) - 1)
                m[i, at[part[at] == s]] = 1
        return m

    step = 16384
    for k in range(0, len(vocabulary), step):
        part = vocabulary[k : k + step]
        a = rows(left, part)
        out += a @ (a if left is right else rows(right, part)).T
    return out


def meeting(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether a of ``left`` and b of ``right`` have the same prefix in some trie."""
    a, b = np.stack(left), np.stack(right)
    out = np.zeros((len(a), len(b)), bool)
    for t in range(a.shape[1]):
        out |= a[:, t, None] == b[None, :, t]
    return out


def _verify(threshold: float):
    """A mapInArrow function over rows sorted by (comp, bi, bj): one row a text with its links, and a spanning forest of them.

    Two texts are compared if and only if they share a trie prefix, however they came into one task.
    """

    def links(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        bi, bj = rows[0][1], rows[0][2]
        left = [r for r in rows if r[3] == bi]
        right = left if bi == bj else [r for r in rows if r[3] == bj]
        if not left or not right or (left is right and len(left) < 2):
            return
        met = meeting([r[7] for r in left], [r[7] for r in right])
        if right is left:
            np.fill_diagonal(met, False)
        rows_met, columns_met = np.flatnonzero(met.any(axis=1)), np.flatnonzero(met.any(axis=0))
        if not len(rows_met):
            return
        # of one block with itself the same texts meet as rows and as columns
        met = met[np.ix_(rows_met, columns_met)]
        same, left = right is left, [left[i] for i in rows_met]
        right = left if same else [right[j] for j in columns_met]
        rows = left if same else left + right
        a = [np.frombuffer(r[6], np.uint64) for r in left]
        b = a if same else [np.frombuffer(r[6], np.uint64) for r in right]
        both = overlaps(a, b)
        na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        hit = met & (both >= threshold * (na[:, None] + nb[None, :] - both) - 1e-6)
        copies_b, copies_a = np.array([r[5] for r in right]), np.array([r[5] for r in left])
        found = {r[4]: 0 for r in rows}
        for i, r in enumerate(left):
            found[r[4]] += int(hit[i] @ copies_b)
        if right is not left:
            for j, r in enumerate(right):
                found[r[4]] += int(copies_a @ hit[:, j])
        root = {r[4]: r[4] for r in rows}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, r in enumerate(left):
            # rows of the hit matrix that agree with the one before add no new edges within it
            for j in np.flatnonzero(hit[i]):
                u, v = top(r[4]), top(right[j][4])
                if u != v:
                    root[max(u, v)] = min(u, v)
        for x, n in found.items():
            if n:
                yield x, n, top(x)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ("comp", "bi", "bj", "block", "rep", "copies", "set")

        def done(out: list) -> list:
            if len(held) > 1:
                out += links(held)
            return out

        for batch in batches:
            out: list[tuple[int, int, int]] = []
            prefixes = batch.column("prefixes").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for row in zip(*(batch.column(c).to_pylist() for c in names), prefixes, strict=True):
                if held and held[0][:3] != row[:3]:
                    done(out)
                    held.clear()
                held.append(row)
            if out:
                yield _edges(out)
        if out := done([]):
            yield _edges(out)

    return run


def _edges(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["rep", "n", "low"])


def _sign(text: Column) -> Column:
    """128 bits of the very text: with the doc_id it tells rows apart that are not wholly equal."""
    return F.unhex(F.md5(text))


def _in_order(spark: SparkSession, members: DataFrame) -> DataFrame:
    """(rep, block): runs of BLOCK texts in the order of (component, path), the leaves of the first trie.

    No window over texts: they are dealt to ranges and numbered within them; a range's first
    number follows from the sizes of those before it, a row each.
    """
    order = ["component", "path", "rep"]
    dealt = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id())
    dealt = stored(spark, dealt, "leaves").select("rep", F.shiftright("n", 33).alias("range"), F.col("n").bitwiseAND((1 << 33) - 1).alias("at"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("range").agg(F.count("*").alias("size")).select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("above"))
    return dealt.join(F.broadcast(sizes), "range").select("rep", F.floor((F.col("above") + F.col("at")) / BLOCK).cast("long").alias("block"))  # a row a partition


def _faces(spark: SparkSession, classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, bi, bj): each pair of blocks with a text each under one prefix of some trie, as a row for either block."""
    met = classes.join(small(blocks), "rep").select("block", F.posexplode("labels").alias("tree", "label")).distinct()
    met = stored(spark, met, "met")
    pairs = met.join(met.withColumnRenamed("block", "other"), ["tree", "label"]).where("block <= other").select(F.col("block").alias("bi"), F.col("other").alias("bj")).distinct()
    pairs = stored(spark, pairs, "pairs")
    return pairs.select(F.col("bi").alias("block"), "bi", "bj").union(pairs.where("bi < bj").select("bj", "bi", "bj"))


def _placed(spark: SparkSession, docs: DataFrame, threshold: float, shingle: int, trees: int, recall: float) -> DataFrame:
    """Rows (doc_id, sign, class_id, n_links, component_id, component), one per document; ``component`` is a number for
    each component of links, null where the document links with nothing and is no copy."""
    depth = prefix_depth(threshold, trees, recall=recall)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("sign", _sign(F.col("text")))
    signed = stored(spark, own.mapInArrow(_signatures(trees, depth, shingle), "doc_id long, sign binary, text_key binary, labels array<long>, path binary"), "signatures")
    good = signed.where("doc_id is not null and text_key is not null")
    first = good.groupBy("text_key").agg(F.min(F.struct("doc_id", "sign")).alias("f"), F.count("*").alias("copies"), F.any_value("labels").alias("labels"), F.any_value("path").alias("path"))
    # classes have numbers of their own: several texts may have one doc_id
    classes = stored(spark, first.select(F.monotonically_increasing_id().alias("rep"), "text_key", "f.doc_id", "f.sign", "copies", "labels", "path"), "classes")

    under = classes.select("rep", F.posexplode("labels").alias("tree", "label"))
    shared = under.groupBy("tree", "label").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("tree", "label", "low")
    edges = under.join(shared, ["tree", "label"]).where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    candidates = components(spark, edges)
    sizes = candidates.groupBy("component").agg((F.count("*") > BLOCK).alias("large"))
    prefixes = F.transform("labels", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("prefixes")  # 31 bits of each
    members = candidates.join(sizes, "component").join(classes.select(F.col("rep").alias("node"), "doc_id", "sign", "copies", "path", prefixes), "node")
    members = stored(spark, members.select("doc_id", "sign", F.col("node").alias("rep"), "component", "large", "copies", "path", "prefixes"), "members")

    # texts that share a prefix meet: those of a component of up to BLOCK texts in one task, of larger ones where their blocks face each other.
    # Blocks of -1 or less face none.
    faces, place = None, F.when(~F.col("large"), F.col("component")).otherwise(-1)
    spots = members.select("doc_id", "sign", "rep", "copies", "prefixes", place.alias("comp"), (-1 - F.col("rep")).alias("block"))
    if members.where("large").limit(1).count():
        blocks = stored(spark, _in_order(spark, members.where("large")), "blocks")
        faces = _faces(spark, classes, blocks)
        spots = spots.join(small(blocks.withColumnRenamed("block", "own")), "rep", "left").select("doc_id", "sign", "rep", "copies", "prefixes", "comp", F.coalesce("own", "block").alias("block"))
    texts = own.where("text is not null").join(small(spots), ["doc_id", "sign"])
    if classes.where("copies > 1").join(small(members.select("rep")), "rep", "left_semi").limit(1).count():
        texts = texts.dropDuplicates(["rep"])  # wholly equal rows
    sets = texts.select("text", "comp", "block", "rep", "copies", "prefixes").mapInArrow(_shingles(shingle), "comp long, block long, rep long, copies long, prefixes array<int>, set binary")
    zero = F.lit(0).cast("long")
    if faces is None:
        faced = sets.select("comp", zero.alias("bi"), zero.alias("bj"), zero.alias("block"), "rep", "copies", "set", "prefixes")
    else:
        faced = sets.join(small(faces), "block", "left").select("comp", F.coalesce("bi", zero).alias("bi"), F.coalesce("bj", zero).alias("bj"), F.greatest("block", zero).alias("block"), "rep", "copies", "set", "prefixes")
    verified = faced.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "rep").mapInArrow(_verify(threshold), "rep long, n long, low long")
    verified = stored(spark, verified, "links")

    links = verified.groupBy("rep").agg(F.sum("n").alias("n"))
    linked = components(spark, verified.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    facts = classes.select("text_key", "rep", "doc_id", "copies").join(links, "rep", "left").join(linked, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    facts = stored(spark, facts.select("text_key", F.col("doc_id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component"), "facts")
    least = facts.groupBy("component").agg(F.min("class_id").alias("component_id"))
    facts = facts.join(least, "component")
    placed = signed.select("doc_id", "sign", F.when(F.col("doc_id").isNotNull(), F.col("text_key")).alias("text_key")).join(facts, "text_key", "left")
    return placed.select("doc_id", "sign", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def similar(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """Rows (doc_id, class_id, n_links, component_id, kept), one per document.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Texts with
    the same words are a class, named by its smallest doc_id. Two texts link if the Jaccard
    similarity of their sets of ``shingle``-word shingles (a shorter text is one shingle) is
    at least ``threshold``. n_links counts the other documents linked directly, copies
    included; component_id is the smallest doc_id reachable by links; kept marks the rows that have it.

    1. MinHash signatures of whole texts; classes collapse before anything is paired.
    2. Texts that share a trie prefix get an edge to the smallest of them (never all pairs);
       connected texts are a candidate component.
    3. Two texts are verified if and only if they share a prefix in some trie, in components of
       any size. One of up to BLOCK texts goes to one task. Larger ones are sorted by a trie's
       full prefixes and cut into runs of BLOCK leaves; two runs go to a task only if some
       trie has a text of each under one prefix. Overlaps of shingles are counted exactly, and a task returns a row a text.
    4. Components of the verified links.

    Documents without words (null, empty, punctuation only) link with nothing. A doc_id on
    several rows is several documents, each linked by its own text; rows with a null doc_id
    come back with nulls and link with nothing. Other columns are not looked at, a text may be of
    any length, and an empty table gives no rows. A pair at the threshold is missed once in
    1 / (1 - recall) cases at most, more similar ones less often.
    """
    placed = _placed(spark, docs, threshold, shingle, trees, recall)
    return placed.select("doc_id", "class_id", "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def dedup(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component of links: the first by doc_id and, on ties, by the text's MD5.

    Of wholly equal documents (doc_id and text) one row stays. Documents that link with
    nothing stay, those without words or doc_id too, and all columns, whatever their names. Texts
    may be of any length; an empty table stays empty.
    """
    placed = stored(spark, _placed(spark, docs, threshold, shingle, TREES, RECALL), "placed").where("component is not null")
    stays = placed.groupBy("component").agg(F.min(F.struct("doc_id", "sign")).alias("s"), F.count("*").alias("n")).where("n > 1")
    rows = placed.groupBy("component", "doc_id", "sign").agg(F.count("*").alias("n_rows")).join(stays.select("component", "s"), "component")
    here = (F.col("doc_id") == F.col("s.doc_id")) & (F.col("sign") == F.col("s.sign"))
    gone = stored(spark, rows.where(~here).select(F.col("doc_id").alias("_id"), F.col("sign").alias("_sign")), "gone")
    twice = stored(spark, rows.where(here & (F.col("n_rows") > 1)).select(F.col("doc_id").alias("_id"), F.col("sign").alias("_sign")), "twice")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_id"), _sign(F.col("text")).alias("_sign"))
    kept = own.join(small(gone), ["_id", "_sign"], "left_anti")
    if twice.limit(1).count():
        again = kept.join(small(twice), ["_id", "_sign"], "left_semi").groupBy("_id", "_sign").agg(F.any_value("row").alias("row"))
        kept = kept.join(small(twice), ["_id", "_sign"], "left_anti").select("row").union(again.select("row"))
    return kept.select(*(F.col(f"row.`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with recursive w as (select doc_id, {_WORDS} as w from documents where doc_id is not null and text is not null),
c as (select min(doc_id) as rep, count(*) as copies, w from w where len(w) > 0 group by w),
s as (select rep, list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1), lambda k: array_to_string(w[k:k + {SHINGLE} - 1], ' '))) as g from c),
e as (select rep, len(g) as n, unnest(g) as g from s),
i as (select a.rep as a, b.rep as b, count(*) as common, any_value(a.n) + any_value(b.n) as total from e a join e b on a.g = b.g and a.rep <> b.rep group by a.rep, b.rep),
l as (select a, b from i where common >= {THRESHOLD} * (total - common) - 1e-6),
r as (select rep as a, rep as b from c union select r.a, l.b from r join l on r.b = l.a),
m as (select a as rep, min(b) as component from r group by a),
n as (select l.a as rep, sum(c.copies) as n from l join c on c.rep = l.b group by l.a),
f as (select c.rep, c.w, m.component, coalesce(n.n, 0) + c.copies - 1 as n from c join m on c.rep = m.rep left join n on c.rep = n.rep)
select d.doc_id, coalesce(f.rep, d.doc_id) as class_id, coalesce(f.n, 0)::bigint as n_links, coalesce(f.component, d.doc_id) as component_id,
  coalesce(f.component, d.doc_id) = d.doc_id or d.doc_id is null as kept
from documents d left join w on w.doc_id = d.doc_id left join f on f.w = w.w
"""
