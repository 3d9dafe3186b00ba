"""Embedding near-duplicates: coarse inverted lists, residual product quantisation, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import components, stored
from skein.llm.words import give_back, lean

THRESHOLD = 0.95
#: Cells of a matrix of vectors by lists that a task holds at a time.
CELLS = 1 << 21
#: Vectors of a list, about, and the most lists.
LIST_SIZE, MAX_LISTS = 256, 16_384
#: Vectors (about, by hash) that the lists and codebooks are fitted on: so many, or 8 a list; every vector is indexed.
SAMPLE = 20_000
#: Subspaces and codewords of each.
SUBSPACES, CODEWORDS = 8, 256
#: Vectors of a list that are held in memory at once.
BLOCK = 1024
SEED = 5


@dataclass


class Index:
    """Centroids (lists x dim), codebooks (subspaces x codewords x width) and blocks of each list."""

    centroids: np.ndarray
    codebooks: np.ndarray
    blocks: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def pad(self, x: np.ndarray) -> np.ndarray:
        """Subspaces of equal width, zeros behind the last dimension."""
        width = self.codebooks.shape[2]
        out = np.zeros((len(x), SUBSPACES * width))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), SUBSPACES, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, distance of each vector from what its codes stand for)."""
        lists = (x @ self.centroids.T).argmax(1)
        rest = self.pad(x - self.centroids[lists])
        codes, error = np.zeros((len(x), SUBSPACES), np.uint8), np.zeros(len(x))
        for m in range(SUBSPACES):
            d = ((rest[:, m] ** 2).sum(1)[:, None] - 2 * rest[:, m] @ self.codebooks[m].T) + (self.codebooks[m] ** 2).sum(1)[None, :]
            codes[:, m] = d.argmin(1)
            error += np.maximum(d.min(1), 0)
        return lists, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, list) pairs to be asked, and each vector's own list.

        Two neighbours in lists a and b lie on two sides of the plane that bisects the
        centroids, and their distances from it add up to ``radius`` at most. So one of them is within
        half of it, and asking the lists whose plane is as near as that loses no neighbours.
        """
        found = []
        step = max(1, CELLS // len(self.centroids))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            dots = part @ self.centroids.T
            own = dots.argmax(1)
            mine, which = np.unique(own, return_inverse=True)
            apart = 2 - 2 * self.centroids[mine] @ self.centroids.T  # of the slice's own lists only
            apart = np.sqrt(np.maximum(apart, 1e-12, out=apart), out=apart)
            rows = np.arange(len(part))
            dots = dots[rows, own][:, None] - dots
            near = dots <= (radius / 2 + 1e-9) * apart[which]
            near[rows, own] = True
            vector, other = np.nonzero(near)
            found.append((vector + at, other, own))
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))

    def beside(self, x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Distance of each vector from the plane between its own list and another: row by row, so that it is the same in every task."""
        way = self.centroids[own] - self.centroids[other]
        return (x * way).sum(1) / np.sqrt(np.maximum((way * way).sum(1), 1e-12))

    def distances(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (queries x codes) within one list, from lookup tables."""
        rest = self.pad(x - self.centroids[which])
        out = np.zeros((len(x), len(codes)), np.float32)
        for m in range(SUBSPACES):
            table = (rest[:, m] ** 2).sum(1)[:, None] - 2 * rest[:, m] @ self.codebooks[m].T + (self.codebooks[m] ** 2).sum(1)[None, :]
            out += table.astype(np.float32)[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, unit: bool = False, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([(p @ c.T - (0 if unit else (c**2).sum(1) / 2)).argmax(1) for p in np.array_split(x, len(x) * k // 4_000_000 + 1)])
        order = np.argsort(near, kind="stable")
        ids, at = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], at)
        c[ids] = sums / np.diff([*at, len(x)])[:, None]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision, from bytes of floats or doubles."""
    kind = np.float32 if raw and len(raw[0]) == 4 * dim else np.float64
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(v: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


@lean
def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``v`` (array of floats or doubles) as bytes of the same kind."""
    for b in batches:
        v = b.column("v")
        data, at = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
        names = [n for n in b.schema.names if n != "v"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([data[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())], [*names, "v"])


def fit(reps: DataFrame, n: int, dim: int) -> Index:
    """Lists and codebooks from a sample of about SAMPLE vectors, or 8 a list (those of the smallest hashes)."""
    sample = max(SAMPLE, 8 * min(n // LIST_SIZE, MAX_LISTS))
    share = min(1.0, sample / max(n, 1))
    rows = reps.where((F.xxhash64(F.lit(SEED), "rep") / F.lit(2.0**63)).between(-share, share)).select("v").limit(2 * sample).collect()
    x = unit([bytes(r.v) for r in rows], dim)
    del rows
    lists = max(1, min(n // LIST_SIZE, MAX_LISTS, len(x) // 8))
    centroids = kmeans(x, lists, unit=True)
    width = -(-dim // SUBSPACES)
    index = Index(centroids, np.zeros((SUBSPACES, CODEWORDS, width)), np.ones(lists, np.int64))
    rest = index.pad(x - centroids[(x @ centroids.T).argmax(1)])
    index.codebooks = np.stack([kmeans(rest[:, m], CODEWORDS) for m in range(SUBSPACES)])
    give_back()
    return index


def _assign(shared, radius: float, queries: bool):
    """A mapInArrow function: stored rows (kind 0) of each vector, or its queries (kind 1) to each block it probes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rep, copies = b.column("rep").to_numpy(), b.column("copies").to_numpy()
                raw = b.column("v").to_pylist()
                x = unit(raw, index.dim)
                if queries:
                    row, which, own = index.probes(x, radius)
                    n = index.blocks[which]
                    row, which = np.repeat(row, n), np.repeat(which, n)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    codes, error, kind, home = [None] * len(row), np.zeros(len(row)), 1, own[row]
                else:
                    which, codes, error = index.encode(x)
                    codes = [c.tobytes() for c in codes]
                    row, kind, home = np.arange(len(x)), 0, which
                    spread = rep.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                    block = (spread % index.blocks[which].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which, pa.int64()), pa.array(block, pa.int64()), pa.array(np.full(len(row), kind, np.int32)), pa.array(rep[row]), pa.array(copies[row]), pa.array(codes, pa.binary()), pa.array(error), pa.array(home, pa.int64()), pa.array([raw[i] for i in row], pa.binary())],
                    ["list", "block", "kind", "rep", "copies", "codes", "error", "home", "v"],
                )

    return run


class BlockSearch:
    """One block of a list: its vectors, and the links of the queries that reach it."""

    def __init__(self, index: Index, threshold: float, radius: float):
        self.index, self.threshold, self.radius = index, threshold, radius
        self.stored: list[tuple] = []
        self.asked: list[tuple] = []
        self.out: list[tuple[int, int, int]] = []
        self.ready = False

    def add(self, row: tuple) -> None:
        if row[0] == 0:
            self.stored.append(row)
            return
        self.asked.append(row)
        if len(self.asked) == 256:
            self.search()

    def prepare(self) -> None:
        s = self.stored
        self.rep, self.copies = np.array([r[1] for r in s]), np.array([r[2] for r in s])
        self.codes = np.frombuffer(b"".join(r[3] for r in s), np.uint8).reshape(len(s), SUBSPACES)
        self.error = np.array([r[4] for r in s])
        self.x = unit([r[6] for r in s], self.index.dim)
        self.root = list(range(len(s)))
        self.linked, self.n = np.zeros(len(s), bool), np.zeros(len(s), np.int64)
        self.ready = True

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def search(self, which: int | None = None) -> None:
        if not self.asked or not self.stored:
            self.asked = []
            return
        if not self.ready:
            self.prepare()
        ids = np.array([r[1] for r in self.asked])
        copies, home = np.array([r[2] for r in self.asked]), np.array([r[5] for r in self.asked])
        x = unit([r[6] for r in self.asked], self.index.dim)
        # what the codes stand for is ``error`` away from the vector: nothing within the radius is lost
        near = self.index.distances(x, self.list, self.codes) - self.error[None, :] <= self.radius + 1e-3
        near &= ids[:, None] != self.rep[None, :]
        q, s = np.nonzero(near)
        good = np.zeros(len(q), bool)
        for k in range(0, len(q), 65536):
            part = slice(k, k + 65536)
            good[part] = np.einsum("ij,ij->i", x[q[part]], self.x[s[part]]) >= self.threshold
        q, s = q[good], s[good]
        # neighbours in two lists: the one nearer to the plane between them asks, and counts for both
        far = np.flatnonzero(home[q] != self.list)
        here = np.full(len(far), self.list)
        a, b = self.index.beside(x[q[far]], home[q[far]], here), self.index.beside(self.x[s[far]], here, home[q[far]])
        mine = (a < b) | ((a == b) & (ids[q[far]] < self.rep[s[far]]))
        np.add.at(self.n, s[far[mine]], copies[q[far[mine]]])
        keep = np.ones(len(q), bool)
        keep[far[~mine]] = False
        q, s = q[keep], s[keep]
        self.linked[s] = True
        first = np.searchsorted(q, np.arange(len(ids) + 1))
        for i in np.flatnonzero(np.diff(first)):
            mine = s[first[i] : first[i + 1]]
            self.out.append((int(ids[i]), int(self.copies[mine].sum()), int(self.rep[mine[0]])))
            base = self.top(int(mine[0]))
            for j in mine[1:]:
                t = self.top(int(j))
                if t != base:
                    self.root[t] = base
        self.asked = []

    def close(self) -> list[tuple[int, int, int]]:
        self.search()
        if self.ready:
            self.out += [(int(self.rep[i]), int(self.n[i]), int(self.rep[self.top(int(i))])) for i in np.flatnonzero(self.linked)]
        return self.out


def _search(shared, threshold: float, radius: float):
    """A mapInArrow function over rows sorted by (list, block, kind): (rep, links found, a rep linked with it)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            out: list[tuple] = []
            place = zip(batch.column("list").to_pylist(), batch.column("block").to_pylist(), strict=True)
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "rep", "copies", "codes", "error", "home", "v")), strict=True)
            for key, row in zip(place, rows, strict=True):
                if key != at:
                    if block:
                        out += block.close()
                    at, block = key, BlockSearch(shared.value, threshold, radius)
                    block.list = key[0]
                block.add(row)
            if out:
                yield _links(out)
        if block and (out := block.close()):
            yield _links(out)

    return run


def _links(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["rep", "n", "low"])


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per vector; links are pairs of cosine >= ``threshold``.

    Equal vectors are one representative with a count of copies. Representatives are
    dealt to inverted lists of unit centroids, with codes of the residual; each also asks
    the lists near whose border it lies, so that of two neighbours at least one asks the other's. A list is cut into blocks of about
    BLOCK vectors, which stream through tasks: table-lookup distances less the coding error
    leave candidates, whose cosine is taken in double precision. A block returns a row for
    each vector with links and a spanning forest, never the pairs.

    Vectors of each length that occurs are linked among themselves, one length after another.
    Null, empty and zero vectors, and vectors with null or non-finite components, link with
    nothing. Repeated rows, and several vectors of one vec_id, are vectors of their own, and
    component_id is the smallest vec_id of a component; rows with a null vec_id come back
    with nulls and link with nothing. Other columns are not looked at, and an empty table gives no rows.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if element == "float" else F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("fine", usable(F.col("v")) & F.col("vec_id").isNotNull())
    key = F.when(F.col("fine"), F.md5(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ",")))  # -0.0 is 0.0
    keyed = stored(spark, rows.select("vec_id", "v", key.alias("key"), F.size("v").alias("d")), "keyed")
    classes = keyed.where("key is not null").groupBy("key", "d").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    # classes have numbers of their own: several vectors may have one vec_id
    reps = stored(spark, classes.select(F.monotonically_increasing_id().alias("rep"), "*").mapInArrow(_bytes, "rep long, key string, d int, vec_id long, copies long, v binary"), "vectors")
    facts = None
    for r in reps.groupBy("d").count().orderBy("d").collect():  # one row a length
        own = _linked(spark, reps.where(F.col("d") == r.d), r["count"], r.d, threshold)
        facts = own if facts is None else facts.union(own)
    if facts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    facts = stored(spark, facts, "facts")
    least = facts.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    facts = facts.join(least, "component").select("key", "n", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return keyed.select("vec_id", "key").join(facts, "key", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _linked(spark: SparkSession, reps: DataFrame, n: int, dim: int, threshold: float) -> DataFrame:
    """(key, vec_id, n, component) of the ``n`` representatives of one length."""
    index = fit(reps, n, dim)
    radius = float(np.sqrt(2 - 2 * threshold))
    plain = spark.sparkContext.broadcast(index)
    schema = "list long, block long, kind int, rep long, copies long, codes binary, error double, home long, v binary"
    lists = reps.select("rep", "copies", "v").mapInArrow(_assign(plain, radius, False), schema).groupBy("list").count().collect()  # one row a list
    blocks = np.ones(len(index.centroids), np.int64)
    for r in lists:
        blocks[r["list"]] = -(-r["count"] // BLOCK)
    sized = spark.sparkContext.broadcast(Index(index.centroids, index.codebooks, blocks))
    both = [reps.select("rep", "copies", "v").mapInArrow(_assign(sized, radius, q), schema) for q in (False, True)]
    dealt = both[0].union(both[1]).repartition("list", "block").sortWithinPartitions("list", "block", "kind", "rep")
    found = stored(spark, dealt.mapInArrow(_search(sized, threshold, radius), "rep long, n long, low long"), "links")
    plain.destroy()
    sized.destroy()

    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    linked = components(spark, found.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    facts = reps.select("key", "vec_id", "rep", "copies").join(links, "rep", "left").join(linked, "rep", "left")
    return facts.select("key", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = f"""
with recursive v as (select vec_id, embedding::double[] as e, len(embedding) as d from embeddings where vec_id is not null and embedding is not null
    and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and a.d = b.d and list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a),
m as (select a, min(b) as component from r group by a),
n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(component, vec_id) as component_id, coalesce(component, vec_id) = vec_id as kept
from embeddings left join n on n.a = vec_id left join m on m.a = vec_id
"""
