"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.shared import packed, stored, unpacked
from skein.llm.words import lean

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (5, 2, 1)
#: Times a source may be repeated.
MAX_REPEAT = 3
#: Words of a block of the mix; larger where there would be over MAX_BLOCKS blocks.
BLOCK, MAX_BLOCKS = 4096, 500_000_000
#: Output shards at least, words of one where there are more, and the most of sources times shards: what the driver plans with.
SHARDS, SHARD_WORDS, MAX_CELLS = 64, 200_000_000, 4_000_000
#: The most sources whose totals the driver plans with.
MAX_SOURCES = 100_000
#: Draws of a shard that are sorted in one task, about.
PART_DRAWS = 200_000
#: Rounds of the network that permutes blocks, and steps of a walk back into its range.
ROUNDS, WALK = 6, 64
SEED = 17
#: Documents of a source in one window of the running sum, about.
BUCKET_DOCS = 2000


@dataclass
class SourcePlan:
    source: str | None
    size: int
    docs: int
    target: float = 0.0
    quota: int = 0
    starts: list[int] | None = None


def targets(sizes: list[int], weights: list[int], max_repeat: int = MAX_REPEAT) -> list[float]:
    """Shares by weight of the whole size, none above ``max_repeat`` times its own size.

    Capped sources are those with the least cap for their weight; the first level at which
    the next one is under its cap is where resharing the excess ends.
    """
    total = sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (max_repeat * sizes[i] / weights[i], i))
    caps, weight = 0, sum(weights)
    for k, i in enumerate(order):
        if (total - caps) * weights[i] <= max_repeat * sizes[i] * weight:
            break
        caps, weight = caps + max_repeat * sizes[i], weight - weights[i]
    else:
        k = len(order)
    capped = set(order[:k])
    return [float(max_repeat * n) if i in capped else float(total - caps) * weights[i] / weight for i, n in enumerate(sizes)]


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source in each shard (shards x sources).

    A tree halves the shards; at each node the blocks that go left are a multivariate-
    hypergeometric draw from the node's blocks, as if all blocks had been shuffled. Rows add
    up to equal shards (one block apart at most), columns to the quotas exactly. A node's
    draw depends on the seed and its place only.
    """
    total = sum(quotas)
    edges = [total * i // shards for i in range(shards + 1)]
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, edges[mid] - edges[lo], method="marginals")
        split(lo, mid, left)
        split(mid, hi, have - left)

    split(0, shards, np.asarray(quotas, np.int64))
    return out


def doc_size(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def plan(sized: DataFrame, shards: int | None, seed: int) -> tuple[list[SourcePlan], int]:
    """Targets, block quotas and the first permuted block of each shard, for each source; and the block size."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources; map them to fewer before mixing")
    sources = [SourcePlan(r.source, r["size"], r.docs) for r in sorted(rows, key=lambda r: (r.source is None, r.source or ""))]
    total = sum(s.size for s in sources)
    block = max(BLOCK, math.ceil(total / MAX_BLOCKS))
    for s, t in zip(sources, targets([s.size for s in sources], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))]) if total else [0.0] * len(sources), strict=True):
        s.target, s.quota = t, math.ceil(int(t) / block)
    shards = shards or max(1, min(max(SHARDS, total // SHARD_WORDS), MAX_CELLS // max(1, len(sources))))
    if sources:
        starts = np.cumsum(split_quotas([s.quota for s in sources], shards, seed), axis=0)
        for j, s in enumerate(sources):
            s.starts = [0, *starts[:-1, j].tolist()]
    return sources, block


PLAN_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("source_size", T.LongType()),
    T.StructField("buckets", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("words", T.LongType()),
    T.StructField("quota", T.LongType()), T.StructField("bits", T.IntegerType()),
])


def permuted(k: Column, quota: Column, bits: Column, seed: int, rank: Column) -> Column:
    """The place of block ``k`` in a keyed permutation of 0 .. quota - 1.

    A Feistel-like network permutes the numbers of ``bits`` bits: each round flips the low half
    by a hash of the rest and rotates. A number beyond the quota is permuted again until it is
    one of the quota's (the range is less than twice the quota, or of 4 numbers): a few short
    walks for nearly all, a long one for the rest.
    """
    low = F.floor(bits / 2).cast("int")
    left, right = (lambda name: lambda x, n: F.call_function(name, x, n))("shiftleft"), (lambda name: lambda x, n: F.call_function(name, x, n))("shiftright")
    one = F.lit(1).cast("long")

    def once(x: Column) -> Column:
        def turn(x: Column, r: Column) -> Column:
            mask = left(one, low) - 1
            flipped = x.bitwiseXOR(F.xxhash64(F.lit(seed), rank, r, right(x, low)).bitwiseAND(mask))
            return left(flipped.bitwiseAND(mask), bits - low).bitwiseOR(right(flipped, low))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)

    def walk(x: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda x, _: F.when(x < quota, x).otherwise(once(x)))

    more = lambda x, steps: F.when(x < quota, x).otherwise(walk(x, steps))
    return F.aggregate(F.array(F.lit(2), F.lit(6), F.lit(WALK)), once(k), lambda x, n: F.when(n == 2, more(x, 2)).when(n == 6, more(x, 6)).otherwise(more(x, WALK)))


def mix(spark: SparkSession, docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """Rows (row, doc_id, source, size, source_size, target, draws), one per document; ``row`` tells them apart.

    ``draws`` lists what the mix takes of the document: (shard, block, first_word, n_words,
    order_key); repeats are draws of their own. A source's documents stand in a fixed random
    order (MD5 of seed and doc_id) on a line of words that is run through again up to
    MAX_REPEAT times; the line, ended at the target, is cut into blocks; blocks are permuted
    and handed out in the quotas of the splitting tree. Within a shard the draws are to be
    ordered by order_key. Only a source's last document is cut.

    The running sum over a source is taken in buckets of about BUCKET_DOCS documents and
    over the buckets' sums, so a source with a third of all rows is no single task.
    Null texts and texts without words have size 0 and no draws; null doc_ids count as the
    empty id; repeated rows are documents of their own. An empty table gives no rows.
    """
    sized = stored(spark, docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", doc_size(F.col("text")).alias("size")), "sizes")
    return draws(spark, sized, shards, seed)


def draws(spark: SparkSession, sized: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """mix() of a stored table (row, doc_id, source, size)."""
    sources, block = plan(sized, shards, seed)
    rows = [(s.source, i, s.size, max(1, math.ceil(s.docs / BUCKET_DOCS)), s.target, int(s.target), s.quota, max(2, (s.quota - 1).bit_length())) for i, s in enumerate(sources)]
    plans = F.broadcast(spark.createDataFrame(rows, PLAN_SCHEMA))  # at most MAX_SOURCES rows
    short = plans.drop("bits", "quota", "words", "target", "source_size")
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = (
        sized.withColumn("source", F.col("source").cast("string"))
        .join(short.withColumnRenamed("source", "p_source"), F.col("source").eqNullSafe(F.col("p_source")))
        .drop("p_source")
        .withColumn("place", place)
        .withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(2.0**32)))
    )
    in_bucket = Window.partitionBy("rank", "bucket").orderBy("place", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("s")).select("rank", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    lined = (
        placed.withColumn("run", F.sum("size").over(in_bucket))
        .join(sums, ["rank", "bucket"])
        .withColumn("begin", F.col("base") + F.col("run") - F.col("size"))
        .drop("base", "run", "bucket", "buckets", "source")
        .join(plans, "rank")
    )
    epochs = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(MAX_REPEAT - 1).cast("long")), lambda e: e * F.col("source_size") + F.col("begin"))
    parts = F.transform(F.filter(epochs, lambda b: (F.col("size") > 0) & (b < F.col("words"))), lambda b: F.struct(b.alias("b"), F.least(b + F.col("size"), F.col("words")).alias("e")))

    def cut(p: Column) -> Column:
        last = F.floor((p["e"] - 1) / block)

        def draw(placed: Column) -> Column:
            k, at = placed["k"], placed["at"]
            lo, hi = F.greatest(p["b"], k * block), F.least(p["e"], (k + 1) * block)
            return F.struct(
                at.alias("at"),
                k.alias("block"),
                F.pmod(lo - F.col("begin"), F.col("source_size")).alias("first_word"),
                (hi - lo).alias("n_words"),
                F.xxhash64(F.lit(seed), F.col("rank"), k, lo).alias("order_key"),
            )

        places = F.transform(F.sequence(F.floor(p["b"] / block), last), lambda k: F.struct(k.alias("k"), permuted(k, F.col("quota"), F.col("bits"), seed, F.col("rank")).alias("at")))
        return F.transform(places, draw)

    # where each source's blocks of a shard begin: MAX_CELLS numbers at most, sent once to each executor
    starts = spark.sparkContext.broadcast([np.array(s.starts, np.int64) for s in sources])

    fields = ("block", "first_word", "n_words", "order_key")

    @lean
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, rank = b.column("draws"), b.column("rank").to_numpy()
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            at, of = flat.field("at").to_numpy(), np.repeat(rank, n)
            shard = np.zeros(len(at), np.int32)
            for r in np.unique(of):
                shard[of == r] = np.searchsorted(starts.value[r], at[of == r], "right") - 1
            draws = pa.StructArray.from_arrays([pa.array(shard), *(flat.field(f) for f in fields)], ["shard", *fields])
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), draws)
            yield pa.record_batch([b.column(c) for c in out[:-1]] + [rows], out)

    out = ["row", "doc_id", "source", "size", "source_size", "target", "draws"]
    drawn = lined.select(*out[:-1], "rank", F.flatten(F.transform(parts, cut)).alias("draws"))
    schema = T.StructType([drawn.schema[c] for c in out[:-1]]).add("draws", T.ArrayType(T.StructType([T.StructField("shard", T.IntegerType()), *(T.StructField(f, T.LongType()) for f in fields)])))
    return drawn.mapInArrow(named, schema)


def shard_rows(spark: SparkSession, mixed: DataFrame) -> DataFrame:
    """The mix itself: rows (shard, part, order_key, source, block, row, doc_id, first_word, n_words), each shard shuffled by order_key.

    A shard is read part by part; a part has about PART_DRAWS draws, a range of order_key,
    and is what one task sorts.
    """
    rows = mixed.select("row", "doc_id", "source", F.explode("draws").alias("d"))
    n = rows.agg(F.count("*").alias("n"), F.countDistinct("d.shard").alias("shards")).first()
    parts = max(1, math.ceil(n.n / max(1, n.shards) / PART_DRAWS))
    part = F.least(F.floor((F.col("d.order_key") / F.lit(2.0**64) + 0.5) * parts), F.lit(parts - 1)).cast("int")
    rows = rows.select("d.shard", part.alias("part"), "d.order_key", "source", "d.block", "row", "doc_id", "d.first_word", "d.n_words")
    return rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "order_key", "row")


def with_taken(spark: SparkSession, mixed: DataFrame) -> DataFrame:
    """``mixed`` with ``taken``: the words that the written mix has of each document, repeats counted."""
    mixed = stored(spark, mixed, "draws")
    rows = stored(spark, shard_rows(spark, mixed), "mix")
    taken = rows.groupBy(F.col("row").alias("_row")).agg(F.sum("n_words").alias("taken"))
    return mixed.join(taken, F.col("row") == F.col("_row"), "left").drop("_row").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mix_documents(spark: SparkSession, docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, taken and draws: the texts and what the mix takes of each.

    Columns of these names give way to the new ones; all rows stay, those of which nothing is taken too.
    """
    added = ("size", "source_size", "target", "taken", "draws")
    base = packed(docs.drop(*added), "text").withColumns({"_row": F.monotonically_increasing_id(), "size": doc_size(F.col("text"))})
    base = stored(spark, base, "texts")
    mixed = with_taken(spark, draws(spark, base.select(F.col("_row").alias("row"), "row.doc_id", "row.source", "size"), shards, seed))
    facts = mixed.select(F.col("row").alias("_row"), "source_size", "target", "taken", "draws")
    kept = [c for c in docs.columns if c not in added]
    return unpacked(base.join(facts, "_row"), [*kept, *added], **{c: F.col(c) for c in added})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return with_taken(spark, mix(spark, docs)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
        md5('{SEED}:' || coalesce(doc_id::varchar, '')) as place from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
w as (select *, case rank % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end as weight, sum(source_size) over ()::bigint as total from s),
o as (select *, row_number() over (order by {MAX_REPEAT}.0 * source_size / weight, rank) as k from w),
c as (select *, coalesce(sum({MAX_REPEAT} * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint as caps,
        sum(weight) over (order by k rows between current row and unbounded following)::bigint as rest from o),
e as (select coalesce(min(k), 1000000000) as k from c where (total - caps) * weight <= {MAX_REPEAT} * source_size * rest),
f as (select c.caps, c.rest from c, e where c.k = e.k),
t as (select source, source_size, case when c.k < e.k then ({MAX_REPEAT} * source_size)::double
        else (total - f.caps)::double * weight / f.rest end as target from c cross join e left join f on true),
l as (select d.*, source_size, target, sum(size) over (partition by d.source order by place, doc_id, size rows unbounded preceding) - size as b
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (case when source_size = 0 then 0 else (floor(target)::bigint // source_size) * size
     + greatest(0, least(floor(target)::bigint % source_size - b, size)) end)::bigint as taken from l
"""
