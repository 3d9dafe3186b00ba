"""Collapse logged conversation snapshots, then render what is left as chat text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.shared import in_ranges, small, stored

#: Turns of one window, and of one rendered part; only longer conversations take several.
PART_TURNS = 5000


def _turn_hash(role: Column, text: Column) -> Column:
    field = lambda c: F.sha2(F.coalesce(F.concat(F.lit("v"), c), F.lit("n")), 256)  # noqa: E731  null differs from empty
    return F.concat(field(role), field(text))


def parted(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, bool]:
    """((conv_id, part, turn, role, text), whether any conversation has several parts): PART_TURNS turns a part, in order, whatever their numbers.

    Only the rows of conversations of over PART_TURNS are numbered: by ranges of (conv_id, turn, role, text),
    within a range and from the sizes of the ranges before it, so neither a long conversation nor
    equal turn numbers make one task. Which conversations are long is counted before it is broadcast.
    """
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    long = stored(spark, own.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > PART_TURNS).select("conv_id"), "long")
    if not long.limit(1).count():
        return own.select("conv_id", F.lit(0).cast("long").alias("part"), "turn", "role", "text"), False
    rows = in_ranges(own.join(small(long), "conv_id", "left_semi"), "conv_id", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())
    rows = stored(spark, rows.withColumn("range", F.shiftright("at", 33)), "ranged")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    sizes = stored(spark, sizes.select("conv_id", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above")), "ranges")
    k = F.col("above") + F.col("at") - F.col("first")
    cut = rows.join(small(sizes), ["conv_id", "range"]).select("conv_id", F.floor(k / PART_TURNS).alias("part"), "turn", "role", "text")
    short = own.join(small(long), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("part"), "turn", "role", "text")
    return short.union(cut), True


def prefixes(spark: SparkSession, parts: DataFrame, several: bool) -> DataFrame:
    """(conv_id, k, whole, p, q): two rolling hashes of the first k turns, for each turn; ``whole`` marks the last.

    A turn's place and content make a term; a prefix is known by the terms' running exclusive
    or, in two independent hashes of 64 bits, which rolls along windows of one part and, if there are ``several``, over
    the parts' totals. Turns are ordered by (turn, role, text), nulls first.
    """
    w = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    k = F.row_number().over(w).cast("long") + F.col("part") * PART_TURNS
    turn = parts.select("conv_id", "part", k.alias("k"), _turn_hash(F.col("role"), F.col("text")).alias("h"))
    terms = turn.select("conv_id", "part", "k", F.xxhash64(F.lit(1), "k", "h").alias("p"), F.xxhash64(F.lit(2), "k", "h").alias("q"))
    along = Window.partitionBy("conv_id", "part").orderBy("k")
    run = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.lead("k").over(along).isNull()
    if not several:
        return terms.select("conv_id", "k", last.alias("whole"), F.bit_xor("p").over(run).alias("p"), F.bit_xor("q").over(run).alias("q"))
    terms = stored(spark, terms, "turns")
    over = Window.partitionBy("conv_id").orderBy("part")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    total = terms.groupBy("conv_id", "part").agg(F.bit_xor("p").alias("bp"), F.bit_xor("q").alias("bq"))
    total = total.join(total.where("part > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    final = F.lead("part").over(over).isNull().alias("final")
    total = stored(spark, total.select("conv_id", "part", final, *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("bp", "bq"))), "totals")
    rolled = terms.join(small(total), ["conv_id", "part"], "left")
    roll = lambda c: F.bit_xor(c).over(run).bitwiseXOR(F.coalesce(f"b{c}", F.lit(0)))
    return rolled.select("conv_id", "k", (last & F.coalesce("final", F.lit(True))).alias("whole"), roll("p").alias("p"), roll("q").alias("q"))


def maximal(spark: SparkSession, parts: DataFrame, several: bool) -> DataFrame:
    """(conv_id, n_turns) of the conversations that stay.

    A conversation that is a proper prefix of a longer one goes, and of equal ones the
    smallest conv_id stays: anti- and semi-joins of narrow rows, counted before the shuffle.
    """
    rows = stored(spark, prefixes(spark, parts, several), "prefixes")
    whole = rows.where("whole").select("k", "p", "q", "conv_id")
    proper = rows.where("not whole").select("k", "p", "q").distinct()
    first = whole.groupBy("k", "p", "q").agg(F.min("conv_id").alias("conv_id"))
    return stored(spark, first.join(proper, ["k", "p", "q"], "left_anti").select("conv_id", F.col("k").alias("n_turns")), "maximal")


def render(turns: Column) -> Column:
    """ChatML-like text; a null role is 'unknown', a null text empty."""
    line = lambda t: F.concat(F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|im_end|>"))
    return F.array_join(F.transform(turns, line), "\n")


def collapse(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Maximal conversations: (conv_id, part, n_turns, rendered), a row for each part, from 0.

    n_turns counts the whole conversation; the parts of a long one, joined by line ends, are
    its text. Fully repeated turn rows stay as they are, rows with a null conv_id are
    left out, a null or empty text is an empty message, other columns are not looked at, and
    an empty table gives no rows. Turn numbers may have gaps, repeat or be of any size. A text may be of any length; a part, which is
    one row, has PART_TURNS texts at most.
    """
    parts, several = parted(spark, turns)
    kept = parts.join(maximal(spark, parts, several), "conv_id")
    rows = kept.groupBy("conv_id", "part").agg(F.first("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return rows.select("conv_id", "part", "n_turns", render(F.col("turns")).alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = f"""
with t as (select *, (k - 1) // {PART_TURNS} as part from (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k, role, text from conversations where conv_id is not null)),
h as (select conv_id, k, sha256(string_agg(coalesce('v' || replace(role, '|', '||'), 'n') || '|r|' || coalesce('v' || replace(text, '|', '||'), 'n') || '|t|', '') over (partition by conv_id order by k)) as h from t),
s as (select conv_id, max(k) as n_turns, arg_max(h, k) as h from h group by conv_id),
w as (select min(conv_id) as conv_id, n_turns from s group by h, n_turns having h not in (select h.h from h join s using (conv_id) where k < n_turns))
select conv_id, part, n_turns, string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>', chr(10) order by k) as rendered
from t join w using (conv_id) group by conv_id, part, n_turns
"""
