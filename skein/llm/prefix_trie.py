"""The trie of rebuilt conversations' prefixes, from fingerprints that are combined without rebuilding any text.

A rebuilt conversation is the head of its base and its own turns after that. A run of turns has
the product (H, B^n) of a monoid, H the polynomial of its turns' hashes modulo 2^127 - 1. So the
product of every prefix of a rebuilt conversation follows from those of the base's head and
of its own turns. Prefixes of one depth and product are a node if they end in one and the same turn, which
is checked for all; as H(prefix) = H(prefix before) * B + turn, that proves them equal turn by turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.shared import in_ranges, stored
from skein.llm.words import lean

#: Conversations share the base c - c % BASES; their heads have fewer than HEADS turns.
BASES, HEADS = 5, 9
PRIME = (1 << 127) - 1
#: Depths of one window of running sums; characters of one piece of a list of ids.
BUCKET, PIECE = 4096, 1 << 16
#: Times that all is done with other hashes if two turns or prefixes are mistaken for one.
TRIES = 4


def _base(salt: int) -> int:
    return int.from_bytes(hashlib.sha256(b"base %d" % salt).digest(), "big") % PRIME


def _powers(base: int):
    known = [1]

    def power(n: int) -> int:
        if n >= 1 << 16:
            return pow(base, n, PRIME)
        while len(known) <= n:
            known.append(known[-1] * base % PRIME)
        return known[n]

    return power


_int = lambda b: int.from_bytes(b, "big") if b is not None else 0


def head_length(conv_id: Column) -> Column:
    """Turns that a conversation takes from its base: unsigned CRC-32 of its decimal id, modulo HEADS."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def turn_hash(salt: int) -> Column:
    named = F.concat(F.lit(f"{salt} "), F.length("role").cast("string"), F.lit(":"), "role", "text")
    return F.substring(F.unhex(F.sha2(named, 256)), 1, 16)


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def products(spark: SparkSession, turns: DataFrame, salt: int) -> DataFrame:
    """(conv_id, k, turn, bytes, product): the product of the first k turns of each conversation as it is.

    Rows are ranged over tasks by (conv_id, turn, role, text), so a long conversation lies in
    several, which walk their parts alone; what stands before a part comes to the driver only for
    conversations that lie across a border: two rows a task at most.
    """
    base = _base(salt)

    @lean
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, k, h = None, 0, 0
        for b in batches:
            ks, hs = [], []
            for c, t in zip(b.column("conv_id").to_pylist(), b.column("turn").to_pylist(), strict=True):
                if c != last:
                    last, k, h = c, 0, 0
                k, h = k + 1, (h * base + _int(t)) % PRIME
                ks.append(k)
                hs.append(h.to_bytes(16, "big"))
            yield pa.record_batch({"conv_id": b.column("conv_id"), "part": b.column("part"), "k": pa.array(ks, pa.int64()), "turn": b.column("turn"), "bytes": b.column("bytes"), "product": pa.array(hs, pa.binary())})

    narrow = in_ranges(turns, "conv_id", "turn", "role", "text").select("conv_id", F.spark_partition_id().cast("long").alias("part"), turn_hash(salt).alias("turn"), F.octet_length("text").cast("long").alias("bytes"))
    rows = stored(spark, narrow.mapInArrow(walk, "conv_id long, part long, k long, turn binary, bytes long, product binary"), "trie-turns")
    parts = rows.groupBy("conv_id", "part").agg(F.max("k").alias("n"), F.max_by("product", "k").alias("product"))
    across = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "product"))).alias("parts")).where("size(parts) > 1")
    before, power = {}, _powers(base)
    for r in across.collect():
        n, h = 0, 0
        for p in r.parts:
            before[r.conv_id, p.part] = n, h
            n, h = n + p.n, (h * power(p.n) + _int(p.product)) % PRIME

    @lean
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = _powers(base)
        for b in batches:
            at = [before.get(cp, (0, 0)) for cp in zip(b.column("conv_id").to_pylist(), b.column("part").to_pylist(), strict=True)]
            ks = [k + n for k, (n, _) in zip(b.column("k").to_pylist(), at, strict=True)]
            hs = [((h * power(k) + _int(p)) % PRIME).to_bytes(16, "big") if h else p for k, p, (_, h) in zip(b.column("k").to_pylist(), b.column("product").to_pylist(), at, strict=True)]
            yield pa.record_batch({"conv_id": b.column("conv_id"), "k": pa.array(ks, pa.int64()), "turn": b.column("turn"), "bytes": b.column("bytes"), "product": pa.array(hs, pa.binary())})

    out = "conv_id long, k long, turn binary, bytes long, product binary"
    return rows.mapInArrow(placed, out) if before else rows.select("conv_id", "k", "turn", "bytes", "product")


def prefixes(spark: SparkSession, turns: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """(prefixes, conversations): (conv_id, depth, turn, bytes, product) of each prefix of a turn or more of the rebuilt conversations, and their ids."""
    own, base = products(spark, turns, salt), _base(salt)
    h, c = head_length(F.col("conv_id")), F.col("conv_id")
    head = F.when((F.col("k") < HEADS) & (c % BASES == 0), F.struct("k", "turn", "bytes", "product"))
    convs = own.groupBy("conv_id").agg(F.max(F.when(F.col("k") == h, F.col("product"))).alias("own"), F.collect_list(head).alias("head"))
    convs = stored(spark, convs.withColumn("head", F.array_sort("head")), "trie-convs")
    heads = convs.where(c % BASES == 0).select(c.alias("base"), F.col("head").alias("taken"))
    plan = convs.select("conv_id", h.alias("h"), "own", (c - c % BASES).alias("base")).join(heads, "base", "left")
    plan = plan.select("conv_id", "h", "own", F.slice(F.coalesce("taken", F.array().cast(heads.schema["taken"].dataType)), F.lit(1), F.col("h").cast("int")).alias("taken"))
    plan = stored(spark, plan, "trie-plan")
    first = plan.select("conv_id", F.explode("taken").alias("t")).select("conv_id", F.col("t.k").alias("depth"), "t.turn", "t.bytes", "t.product")

    @lean
    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = _powers(base)
        for b in batches:
            n = b.column("n").to_pylist()
            shift = [(_int(x) - _int(y)) % PRIME for x, y in zip(b.column("base").to_pylist(), b.column("own").to_pylist(), strict=True)]
            hs = [((_int(p) + s * power(m)) % PRIME).to_bytes(16, "big") if s else p for p, s, m in zip(b.column("product").to_pylist(), shift, n, strict=True)]
            yield pa.record_batch({"conv_id": b.column("conv_id"), "depth": b.column("depth"), "turn": b.column("turn"), "bytes": b.column("bytes"), "product": pa.array(hs, pa.binary())})

    about = plan.select("conv_id", "h", "own", F.size("taken").cast("long").alias("taken"), F.try_element_at("taken", F.lit(-1))["product"].alias("base"))
    rest = own.join(about, "conv_id").where("k > h").select("conv_id", (F.col("taken") + F.col("k") - F.col("h")).alias("depth"), "turn", "bytes", "product", (F.col("k") - F.col("h")).alias("n"), "base", "own")
    rest = rest.mapInArrow(combined, "conv_id long, depth long, turn binary, bytes long, product binary")
    return stored(spark, first.union(rest), "trie-prefixes"), convs.select("conv_id")


def mistaken(turns: DataFrame, nodes: DataFrame, salt: int) -> bool:
    """Whether two different turns have one hash, or prefixes of one product end in different turns."""
    texts = turns.groupBy(turn_hash(salt).alias("t")).agg(F.min("role").alias("r"), F.max("role").alias("s"), F.min("text").alias("x"), F.max("text").alias("y")).where("r <> s or x <> y")
    return bool(nodes.where("turn <> other").limit(1).count() or texts.limit(1).count())


def sums_below(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` (conv_id, depth, ...) with each of ``columns`` summed over the same conv_id's rows of that depth and below.

    Windows hold BUCKET depths; the sums of whole buckets are added where there are several.
    """
    b = rows.withColumn("bucket", F.floor(F.col("depth") / BUCKET))
    down = Window.partitionBy("conv_id", "bucket").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("conv_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    deep = b.where(f"depth >= {BUCKET}").select("conv_id").distinct()
    totals = b.join(deep, "conv_id", "left_semi").groupBy("conv_id", "bucket").agg(*(F.sum(c).alias(c) for c in columns))
    totals = totals.select("conv_id", "bucket", *(F.sum(c).over(after).alias(f"_{c}") for c in columns))
    out = b.withColumns({c: F.sum(c).over(down) for c in columns}).join(totals, ["conv_id", "bucket"], "left")
    return out.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in columns}).select(*rows.columns)


def id_hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of the comma-joined ``member`` ids of each (conv_id, depth), ascending.

    Ids are ranged and joined to pieces in many tasks; the hash, which has no other way than
    from first to last, runs over the pieces, one at a time.
    """

    @lean
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, texts, size, seq, part, done = None, [], 0, 0, 0, []

        def flush() -> None:
            nonlocal texts, size, seq
            if texts:
                done.append((*node, part, seq, ",".join(texts)))
                texts, size, seq = [], 0, seq + 1

        def out() -> pa.RecordBatch:
            cols = zip(*done, strict=True) if done else [[]] * 5
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], ["conv_id", "depth", "part", "seq", "ids"])
            done.clear()
            return batch

        for b in batches:
            for c, d, p, m in zip(*(b.column(x).to_pylist() for x in ("conv_id", "depth", "part", "member")), strict=True):
                if (c, d) != node:
                    flush()
                    node, seq = (c, d), 0
                part = p
                texts.append(str(m))
                size += len(texts[-1]) + 1
                if size >= PIECE:
                    flush()
            yield out()
        flush()
        yield out()

    @lean
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for b in batches:
            done = []
            for c, d, ids in zip(*(b.column(x).to_pylist() for x in ("conv_id", "depth", "ids")), strict=True):
                if (c, d) != node:
                    if node:
                        done.append((*node, h.hexdigest()))
                    node, h = (c, d), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield from out(done)
        if node:
            yield from out([(*node, h.hexdigest())])

    def out(done: list) -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [pa.int64(), pa.int64(), pa.string()], strict=True)], ["conv_id", "depth", "ends_sha256"])

    cut = in_ranges(rows, "conv_id", "depth", "member").withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(pieces, "conv_id long, depth long, part long, seq long, ids string")
    return cut.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part", "seq").select("conv_id", "depth", "ids").mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node's smallest member stays the smallest of all deeper prefixes of its own that it is the
    smallest of, so nodes fall into paths, one a conversation at most. A path adds its sums
    to each path that it descends from, at the depth where it leaves it: not more rows than turns.

    Turns are ordered by (turn, role, text), null turns first; null roles and texts are empty;
    repeated rows are turns of their own; rows without conv_id are left out; an empty table has no
    nodes, not even a root. Texts of any length stay where they are but for one shuffle, which orders them, and
    their comparison by hash. Other columns are not looked at.
    """
    turns = _turns(conversations)
    for salt in range(TRIES):
        rows, convs = prefixes(spark, turns, salt)
        nodes = rows.groupBy("depth", "product").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min("turn").alias("turn"), F.max("turn").alias("other"))
        nodes = stored(spark, nodes, "trie-nodes")
        if not mistaken(turns, nodes, salt):
            break
    else:
        raise RuntimeError("different turns or prefixes have equal hashes")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    owned = rows.select("conv_id", "depth", "product").join(nodes.select("depth", "product", F.col("conv_id").alias("owner")), ["depth", "product"]).select("conv_id", "depth", "owner")
    if root.conv_id is not None:
        owned = owned.union(convs.select("conv_id", F.lit(0).cast("long"), F.lit(root.conv_id).cast("long")))
    along = owned.groupBy("conv_id", "owner").agg(F.max("depth").alias("low"))
    along = stored(spark, along, "trie-along")

    costs = nodes.select("conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    if root.conv_id is not None:
        costs = costs.union(spark.range(1).select(F.lit(root.conv_id).cast("long"), F.lit(0).cast("long"), F.lit(root.n_convs).cast("long"), F.lit(0).cast("long")))
    paths = along.where("conv_id = owner").select("conv_id", "low")
    above = along.where("conv_id <> owner").join(paths.select("conv_id"), "conv_id", "left_semi")
    tops = stored(spark, above.groupBy("conv_id").agg(F.max_by("owner", "low").alias("parent"), F.max("low").alias("at")), "trie-tops")
    hooks = stored(spark, tops.groupBy("parent", "at").agg(F.count("*").alias("kids")), "trie-hooks")
    ends = paths.join(hooks.select(F.col("parent").alias("conv_id"), F.col("at").alias("low")), ["conv_id", "low"], "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    own = costs.groupBy("conv_id").agg(F.sum("saved").alias("saved")).join(ends, "conv_id", "left").select("conv_id", "saved", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    own = stored(spark, own, "trie-paths")
    given = above.join(own, "conv_id").groupBy(F.col("owner").alias("conv_id"), F.col("low").alias("depth")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    lows = paths.join(own.select("conv_id", "leaf"), "conv_id")
    shape = lambda df, depth, n=zero, saved=zero, leaves=zero, kids=zero, parent=none, last=zero: df.select("conv_id", depth.alias("depth"), n.alias("n_convs"), saved.alias("saved"), leaves.alias("leaves"), kids.alias("kids"), parent.alias("parent"), last.alias("last"))
    d = F.col("depth")
    parts = shape(costs, d, n=F.col("n_convs"), saved=F.col("saved")).union(shape(given, d, saved=F.col("saved"), leaves=F.col("leaves"))).union(shape(tops, F.col("at") + 1, parent=F.col("parent")))
    parts = parts.union(shape(lows, F.col("low"), leaves=F.col("leaf"), last=F.lit(1).cast("long"))).union(shape(hooks.withColumnRenamed("parent", "conv_id"), F.col("at"), kids=F.col("kids")))
    merged = parts.groupBy("conv_id", "depth").agg(*(F.max(c).alias(c) for c in ("n_convs", "parent", "last", "kids")), *(F.sum(c).alias(c) for c in ("saved", "leaves")))
    merged = sums_below(stored(spark, merged, "trie-merged"), "saved", "leaves")
    whole = along.groupBy(F.col("conv_id").alias("member")).agg(F.max_by("owner", "low").alias("conv_id"), F.max("low").alias("depth"))
    hashes = id_hashes(whole.select("conv_id", "depth", "member"))
    parent = F.when(d > 0, F.coalesce("parent", "conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return merged.join(hashes, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", (F.col("kids") + 1 - F.col("last")).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = f"""
with bits as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: case when a % 2 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end) order by i) as t from (select unnest(range(256))::bigint as i)),
ids as (select distinct conv_id as c from conversations where conv_id is not null),
o as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
z as (select c, (select count(*) from o where o.c = ids.c) as n,
        xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(c::varchar, ''), lambda s: ascii(s)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::bigint) % {HEADS} as h from ids, bits),
r as (select z.c, o.k as d, role, text from z join o on o.c = z.c - z.c % {BASES} and o.k <= z.h
      union all select z.c, least(z.h, coalesce(b.n, 0)) + o.k - z.h, role, text from z join o on o.c = z.c and o.k > z.h left join z b on b.c = z.c - z.c % {BASES}),
p as (select c, d, strlen(text) as bytes, sha256(string_agg(sha256(length(role) || ':' || role || text), '') over (partition by c order by d)) as g from r union all select c, 0, 0, '' from z),
n as (select g, d, min(c) as c, count(*) as n_convs, (count(*) - 1) * max(bytes) as cost from p group by g, d),
up as (select n.g, n.d, q.g as pg, m.c as pc from n join p q on q.c = n.c and q.d = n.d - 1 join n m on m.g = q.g and m.d = q.d),
kids as (select pg as g, d - 1 as d, count(*) as n from up group by all),
below as (select a.g, a.d, sum(n.cost) as saved, count(*) filter (k.n is null) as leaves from n join p a on a.c = n.c and a.d <= n.d left join kids k on k.g = n.g and k.d = n.d group by a.g, a.d),
last as (select c, arg_max(g, d) as g, max(d) as d from p group by c),
fin as (select g, d, sha256(string_agg(c::varchar, ',' order by c)) as s from last group by g, d)
select n.c as conv_id, n.d::bigint as depth, up.pc as parent_conv_id, n.n_convs, coalesce(kids.n, 0)::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, coalesce(fin.s, sha256('')) as ends_sha256
from n left join up on up.g = n.g and up.d = n.d left join kids on kids.g = n.g and kids.d = n.d join below on below.g = n.g and below.d = n.d left join fin on fin.g = n.g and fin.d = n.d
"""
