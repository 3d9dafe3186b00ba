"""URL rules behind a blocked Bloom filter, with an exact hash join after it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.shared import BROADCAST_ROWS

#: 64-bit words of a block, one bit set in each; and the most blocks a filter has (64 MB).
BLOCK_WORDS, MAX_BLOCKS = 8, 1 << 20

RULE_SCHEMA = "host string, path string, action string"
#: The fixed rules of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class BlockedBloom:
    """Eight bits of one 512-bit block for each key; a key's bits all lie in one cache line."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    def may_have(self, h: np.ndarray) -> np.ndarray:
        block, bits = bloom_bits(h, len(self.blocks))
        return ((self.blocks[block] & bits) == bits).all(axis=1)


def bloom_bits(h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, the bit of each of its words) for 64-bit key hashes."""
    h = h.astype(np.int64).view(np.uint64)
    block = ((h >> np.uint64(32)) % np.uint64(n_blocks)).astype(np.int64)
    odd = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)
    low = (h & np.uint64(0xFFFFFFFF))[:, None] * odd[None, :]
    return block, np.uint64(1) << ((low >> np.uint64(26)) & np.uint64(63))


def bloom_filter(keys: DataFrame, n_keys: int) -> BlockedBloom:
    """The filter of the long column ``h`` of ``keys``: bits are set in tasks and merged by block.

    A block has room for about 40 keys; beyond MAX_BLOCKS blocks more keys only mean more
    false positives, which the join removes. What reaches the driver is at most MAX_BLOCKS blocks.
    """
    n_blocks = min(MAX_BLOCKS, max(1, math.ceil(n_keys / 40)))
    names = [f"w{i}" for i in range(BLOCK_WORDS)]

    def bits(batches):
        for pdf in batches:
            block, b = bloom_bits(pdf["h"].to_numpy(), n_blocks)
            yield pd.DataFrame({"block": block} | dict(zip(names, b.view(np.int64).T, strict=True)))

    rows = keys.mapInPandas(bits, "block long, " + ", ".join(f"{n} long" for n in names)).groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names))
    table = rows.toPandas()
    blocks = np.zeros((n_blocks, BLOCK_WORDS), np.uint64)
    blocks[table["block"].to_numpy(np.int64)] = table[names].to_numpy(np.int64).view(np.uint64)
    return BlockedBloom(blocks)


def judge(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Rows (page_id, url, host, path, rule, verdict), one for each row of ``pages``.

    A rule (host, path, action) fits its host and all subdomains if the url's path starts
    with the rule's; the longest host wins, then the longest path. Candidates of a url are
    its host suffixes, each with its path prefixes of the lengths that rules have; those
    that pass the Bloom filter of the listed canonical keys are joined with the rules by
    exact key. Where no listed key fits, the verdict is ``default``.

    Null urls and urls without :// have an empty host and path and fit no rule. Equal rules
    with different actions: block wins; hosts are equal in any case of A-Z. Rules with a null or
    empty host, or a null path, are left out. Repeated pages each keep their row, other columns
    are not looked at, no pages give no rows, and without rules every verdict is ``default``.
    """
    listed = (
        rules.where("host <> '' and path is not null")
        .groupBy(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("action").alias("action"))
        .withColumn("h", F.xxhash64(F.concat("r_host", "r_path")))
    )
    n_rules = listed.count()
    lengths = [r[0] for r in listed.select(F.length("r_path")).distinct().collect()]
    bloom = spark.sparkContext.broadcast(bloom_filter(listed.select("h"), n_rules))

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def passes(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        flat = np.concatenate([np.zeros(0, np.int64), *hashes]).astype(np.int64)
        ok = bloom.value.may_have(flat)
        return pd.Series([x.tolist() for x in np.split(ok, np.cumsum(sizes)[:-1])] if len(sizes) else [])

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.greatest(F.size(labels) - i + 1, F.lit(1))), "."))
    fitting = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths))))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.col("prefixes"), lambda p: F.struct(s.alias("c_host"), p.alias("c_path")))))
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("row", F.monotonically_increasing_id())
    probed = (
        base.withColumn("prefixes", fitting)
        .withColumn("keys", F.when(F.col("host") == "", F.array().cast("array<struct<c_host:string,c_path:string>>")).otherwise(keys))
        .withColumn("ok", passes(F.transform("keys", lambda k: F.xxhash64(F.concat(k["c_host"], k["c_path"])))))
        .withColumn("hits", F.filter("keys", lambda k, i: F.col("ok")[i]))
        .select("row", "page_id", "url", "host", "path", F.explode_outer("hits").alias("k"))
        .select("row", "page_id", "url", "host", "path", "k.*")
    )
    on = ["c_host", "c_path"]
    exact = listed.select(F.col("r_host").alias("c_host"), F.col("r_path").alias("c_path"), "action")
    if n_rules <= BROADCAST_ROWS:
        joined = probed.join(F.broadcast(exact), on, "left")
    else:  # a few suffixes (com) are in most urls: their rows are spread over 32 copies of the rules
        salted = exact.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        joined = probed.withColumn("salt", F.pmod("row", F.lit(32)).cast("int")).join(salted, [*on, "salt"], "left")
    best = F.max(F.when(F.col("action").isNotNull(), F.struct(F.length("c_host").alias("n"), F.length("c_path").alias("m"), "c_host", "c_path", "action"))).alias("best")
    first = [F.first(c).alias(c) for c in ("page_id", "url", "host", "path")]
    return joined.groupBy("row").agg(*first, best).select("page_id", "url", "host", "path", F.concat("best.c_host", "best.c_path").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(spark, pages, spark.createDataFrame(RULES, RULE_SCHEMA)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = rf"""
with r(r_host, r_path, action) as (values {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)}),
u as (select row_number() over () as row, page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') as host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
f as (select row, page_id, host, path, r_host || r_path as rule, action,
        row_number() over (partition by row order by length(r_host) desc nulls last, length(r_path) desc) as k
      from u left join r on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from f where k = 1
"""
