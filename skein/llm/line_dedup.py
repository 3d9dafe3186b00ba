"""Removal of repeated multi-line chunks with content-defined bounds; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.shared import packed, stored, unpacked

#: One line in MODULUS, about, ends a chunk.
MODULUS = 2
#: A single line of so many words is a chunk of its own.
LONG_LINE = 50
_PRIME = 1_000_003


def line_hash(line: Column) -> Column:
    """60 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _key, 128 bits of doc_id and text, and the text's lines."""
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return docs.withColumn("_key", F.unhex(F.md5(own))).withColumn("_lines", F.split("text", "\n", -1))


def _repeated(spark: SparkSession, rows: DataFrame, column: str) -> DataFrame:
    """The ``rows`` (with ``at``, the place of each) whose ``column`` stands in two places or more, and ``n``, in how many rows.

    Counted before the shuffle; what comes back is a join of two plain shuffles, whose hot
    values adaptive execution splits.
    """
    often = rows.groupBy(column).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n")).where("lo < hi").select(column, "n")
    return rows.join(stored(spark, often, "often").hint("merge"), column)


def line_pairs(docs: DataFrame) -> DataFrame:
    """Rows (_key, doc_id, start, pos, idx, before, h, pair, at): each line with the one before it; blank lines are passed over.

    start and pos count all lines of the text, idx those that aren't blank; pair is the hash of the two
    lines, at that of the place.
    """
    line = F.transform("_lines", lambda x, i: F.struct(x.alias("x"), i.alias("pos")))
    full = F.filter(line, lambda s: F.trim(s["x"]) != "")
    hashed = _keyed(docs).where("text is not null").select("_key", "doc_id", F.transform(full, lambda s: F.struct(s["pos"].alias("pos"), line_hash(s["x"]).alias("h"))).alias("l"))
    both = F.arrays_zip(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))).alias("a"), F.slice("l", 2, F.size("l")).alias("b"))
    rows = hashed.where(F.size("l") > 1).select("_key", "doc_id", F.posexplode(both).alias("idx", "p"))
    rows = rows.select("_key", "doc_id", F.col("p.a.pos").alias("start"), F.col("p.b.pos").alias("pos"), "idx", F.col("p.a.h").alias("before"), F.col("p.b.h").alias("h"))
    return rows.withColumns({"pair": F.xxhash64("before", "h"), "at": F.xxhash64("_key", "idx")})


def long_lines(docs: DataFrame) -> DataFrame:
    """Rows (_key, doc_id, pos, h, at) of the lines of LONG_LINE words or more."""
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    line = F.transform("_lines", lambda x, i: F.struct(x.alias("x"), i.alias("pos")))
    full = F.filter(line, lambda s: (F.length(s["x"]) >= 2 * LONG_LINE - 1) & (words(F.trim(s["x"])) >= LONG_LINE))
    rows = _keyed(docs).where("text is not null").select("_key", "doc_id", F.explode(F.transform(full, lambda s: F.struct(s["pos"].alias("pos"), line_hash(s["x"]).alias("h")))).alias("l"))
    return rows.select("_key", "doc_id", "l.pos", "l.h").withColumn("at", F.xxhash64("_key", "pos"))


def chunks(pairs: DataFrame) -> DataFrame:
    """Rows (_key, doc_id, start, end, chunk_hash): runs of repeated pairs of lines, cut where a rolling hash says so.

    A run is a stretch of lines in which each stands next to the same one somewhere else
    too. The rolling hash covers a line and the one before it; where it is 0 modulo MODULUS
    the line ends a chunk and also begins the next, and so does a line that stands more, or less,
    often beside the next one than beside the one before: there a shared passage begins or
    ends. Every chunk has two lines or more, and bounds depend on what the lines next to
    them say, not on where they stand; so a passage that is copied whole is cut alike everywhere.
    """
    ordered = Window.partitionBy("_key").orderBy("idx")
    in_run = Window.partitionBy("_key", "run").orderBy("idx")
    cut = (F.col("h") % _PRIME + 31 * (F.col("before") % _PRIME)) % MODULUS == 0
    opens = F.coalesce(F.lag(cut).over(in_run) | (F.lag("n").over(in_run) != F.col("n")), F.lit(False)).cast("int")
    once = pairs.repartition("_key").dropDuplicates(["_key", "idx"])  # rows with equal doc_id and text are one
    cutting = once.withColumn("run", F.col("idx") - F.row_number().over(ordered)).withColumn("opens", opens).withColumn("chunk", F.sum("opens").over(in_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = cutting.groupBy("_key", "doc_id", "run", "chunk").agg(F.min("start").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"), F.bit_xor("pair").alias("x"))
    return found.select("_key", "doc_id", "start", "end", F.xxhash64("n", "x").alias("chunk_hash"))


def found_chunks(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Chunks of runs, and repeated lines of LONG_LINE words, which are chunks of their own."""
    single = _repeated(spark, long_lines(docs), "h").dropDuplicates(["_key", "pos"])
    single = single.select("_key", "doc_id", F.col("pos").alias("start"), F.col("pos").alias("end"), F.xxhash64(F.lit(1).cast("long"), "h").alias("chunk_hash"))
    return stored(spark, chunks(_repeated(spark, line_pairs(docs), "pair")).union(single), "chunks")


def removals(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows (_key, ranges): line ranges to remove, those of chunks that occur before.

    Of equal chunks the first by (doc_id, start) stays. Chunks that agree by hash are
    compared byte by byte: they are grouped by their very text. Texts meet their chunks in
    merge joins at every size: rows with arrays have no bound that would let them be broadcast.
    """
    found = found_chunks(spark, docs)
    twice = found.groupBy("chunk_hash").count().where("count > 1").select("chunk_hash")
    wanted = found.join(stored(spark, twice, "twice").hint("merge"), "chunk_hash", "left_semi").groupBy("_key").agg(F.collect_list(F.struct("start", "end", "chunk_hash")).alias("found"))
    body = F.array_join(F.filter(F.slice("_lines", F.col("c.start") + 1, F.col("c.end") - F.col("c.start") + 1), lambda x: F.trim(x) != ""), "\n")
    texts = (
        _keyed(docs.select("doc_id", "text")).join(stored(spark, wanted, "wanted").hint("merge"), "_key")
        .select("_key", "doc_id", "_lines", F.explode("found").alias("c"))
        .select("_key", "doc_id", "c.*", body.alias("body"))
    )
    texts = stored(spark, texts.withColumn("sign", F.md5("body")), "bodies")
    first = (
        texts.groupBy("chunk_hash", "sign", "body")
        .agg(F.min(F.struct("doc_id", "start", "_key")).alias("first"), F.count("*").alias("n"))
        .groupBy("chunk_hash", "sign")
        .agg(F.count("*").alias("bodies"), F.first("first").alias("first"), F.first("n").alias("n"))
        .where("bodies = 1 and n > 1")
    )
    first = stored(spark, first.select("chunk_hash", "sign", "first"), "firsts")  # plain shuffles on both sides: hot chunks can be split
    again = texts.drop("body").join(first.hint("merge"), ["chunk_hash", "sign"])
    again = again.where("not (_key = first._key and start = first.start)").select("_key", "start", "end").distinct()
    # overlapping ranges of a text become one
    upto = Window.partitionBy("_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    islands = again.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(upto), F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(Window.partitionBy("_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = islands.groupBy("_key", "island").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    return stored(spark, merged.groupBy("_key").agg(F.collect_list(F.struct("s", "e")).alias("_ranges")), "ranges")


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its repeated chunks, and n_lines and n_removed.

    Null texts stay null with 0 lines; an empty text has one (blank) line. A text wholly
    repeated becomes empty. Rows with equal doc_id and text count as one and get the same
    result. Columns named n_lines or n_removed give way to the new ones. An empty table
    gives no rows; a text, however long, is one row of a task.
    """
    rest = packed(docs, "doc_id", "text")
    joined = _keyed(rest).join(removals(spark, docs).hint("merge"), "_key", "left")
    kept = F.filter("_lines", lambda x, i: ~F.exists("_ranges", lambda r: i.between(r["s"], r["e"])))
    out = joined.withColumn("_kept", F.when(F.col("_ranges").isNotNull(), kept))
    text = F.when(F.col("_ranges").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    n_removed = F.when(F.col("_ranges").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long")
    old = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return unpacked(out.withColumns({"n_lines": n_lines, "n_removed": n_removed, "text": text}), [*old, "n_lines", "n_removed"], n_lines=F.col("n_lines"), n_removed=F.col("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = f"""
with d as (select doc_id, text, count(*) as copies from documents where text is not null group by doc_id, text),
l as (select doc_id, text, copies, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as pos from d),
b as (select *, row_number() over (partition by doc_id, text order by pos) - 1 as idx, ('0x' || substr(md5(x), 1, 15))::bigint as h from l where trim(x) <> ''),
y as (select *, lag(x) over w as px, lag(h) over w as prev, lag(pos) over w as start from b window w as (partition by doc_id, text order by idx)),
q as (select px, x, sum(copies) as n from y where px is not null group by px, x having count(*) > 1),
o as (select y.*, q.n, idx - row_number() over (partition by doc_id, text order by idx) as run, (h % {_PRIME} + 31 * (prev % {_PRIME})) % {MODULUS} = 0 as cut from y join q on y.px = q.px and y.x = q.x),
r as (select *, coalesce(lag(cut) over w or lag(n) over w <> n, false)::int as opens from o window w as (partition by doc_id, text, run order by idx)),
k as (select *, sum(opens) over (partition by doc_id, text, run order by idx rows unbounded preceding) as chunk from r),
m as (select doc_id, text, min(start) as s, max(pos) as e, min(idx) - 1 as i, max(idx) as j from k group by doc_id, text, run, chunk),
f as (select m.doc_id, m.text, s, e, string_agg(x, chr(10) order by b.pos) as body from m join b on m.doc_id is not distinct from b.doc_id and m.text = b.text and b.idx between i and j group by m.doc_id, m.text, s, e
      union all select doc_id, text, pos, pos, x from b where length(trim(x)) - length(replace(trim(x), ' ', '')) + 1 >= {LONG_LINE} and x in (select x from b group by x having count(*) > 1)),
n as (select *, row_number() over (partition by body order by doc_id, s) as k from f),
g as (select distinct doc_id, text, unnest(range(s, e + 1)) as pos from n where k > 1),
t as (select l.doc_id, l.text, count(*)::bigint as n_lines, count(g.pos)::bigint as n_removed, string_agg(l.x, chr(10) order by l.pos) filter (g.pos is null) as rest
      from l left join g on l.doc_id is not distinct from g.doc_id and l.text = g.text and l.pos = g.pos group by l.doc_id, l.text)
select d.doc_id, case when t.n_removed = 0 or d.text is null then d.text else coalesce(rest, '') end as text, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed
from documents d left join t on d.doc_id is not distinct from t.doc_id and d.text = t.text
"""
