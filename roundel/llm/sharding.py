"""Sharding by extendible hashing, with built-in expressions only.

A row's key is hashed to BITS bits. A shard is a prefix of the hash; one whose bytes exceed the limit
splits on the next bit, and only such a shard. The directory has an entry for each value of the next
STEP bits and names the shard that the entry falls into; where STEP bits aren't enough, those entries
get a directory of their own for the next STEP bits, so its size follows the shards that are still too
large and not the deepest one. Sizes come from a histogram over prefixes, aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, read, stored

BITS, STEP = 32, 12
LIMIT = 1 << 20  # bytes of text in a shard


def key_hash(key: Column) -> Column:
    """The first 32 bits of the key's MD5; a null key is an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def _top(h: Column, bits: Column | int) -> Column:
    return F.floor(h / F.pow(F.lit(2.0), F.lit(BITS) - bits)).cast("long")


def shards(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, shard, depth, bytes, shard_bytes) for each row of docs; shard is its prefix in binary digits.

    A null text has no bytes. Rows with one key, repeated rows among them, share all bits and so a
    shard; only such a shard, or one with a single larger text, can exceed the limit. Long texts count
    whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    size = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long")
    rows = stored(docs.select(F.col(key_col).cast("long").alias("doc_id"), size.alias("bytes")).withColumn("h", key_hash(F.col("doc_id"))), "sizes")
    out, base, left = None, 0, rows
    while True:
        top = min(base + STEP, BITS)
        histogram = left.groupBy(_top(F.col("h"), top).alias("entry")).agg(F.sum("bytes").alias("bytes"))
        depths = F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")
        at = lambda entry, depth: F.floor(entry / F.pow(F.lit(2.0), F.lit(top) - depth)).cast("long")  # noqa: E731, B023
        sums = histogram.select("entry", "bytes", depths).groupBy("depth", at(F.col("entry"), F.col("depth")).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        sums = stored(sums, "bucket-sizes")
        above = sums.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = sums.where((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        leaves = fits.withColumn("parent", F.floor(F.col("prefix") / 2).cast("long")).join(above, ["depth", "parent"], "left_semi").select("depth", "prefix", "bytes")
        if base == 0:
            leaves = leaves.unionByName(fits.where("depth = 0").select("depth", "prefix", "bytes"))
        width = F.pow(F.lit(2.0), F.lit(top) - F.col("depth")).cast("long")
        directory = leaves.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.explode(F.sequence(F.col("prefix") * width, (F.col("prefix") + 1) * width - 1)).alias("entry"))
        if base == 0:
            directory = F.broadcast(directory)  # 2**STEP entries at most
        found = left.withColumn("entry", _top(F.col("h"), top)).join(directory, "entry", "left")
        done = found.where("depth IS NOT NULL").select("doc_id", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).alias("shard"), F.col("depth").cast("int").alias("depth"), "bytes", "shard_bytes")
        out = done if out is None else out.unionByName(done)
        if top == BITS or sums.where((F.col("depth") == top) & (F.col("bytes") > limit)).isEmpty():
            return out
        left = stored(found.where("depth IS NULL").select("doc_id", "bytes", "h"), "open-rows")
        base = top


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Write docs as Parquet with a folder for each shard (path/shard=...; the empty prefix is `all`), every shard by one task.

    All columns stay but for one called shard, in any case. A row's shard is that prefix of its key's
    hash which is a shard; depths differ little, so few prefixes of each row are looked up.
    """
    leaves = stored(shards(docs, key_col, text_col, limit).select("shard", "depth").distinct(), "shards")
    depths = sorted(r.depth for r in leaves.select("depth").distinct().collect())  # 33 at most
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"])
    digits = F.lpad(F.bin(key_hash(F.col(key_col).cast("long"))), BITS, "0")
    named = lambda prefix: F.when(prefix == "", F.lit("all")).otherwise(prefix)
    rows = kept.withColumn("shard", F.explode(F.array(*[F.substring(digits, 1, d) for d in depths] or [F.lit("")])))
    found = rows.join(leaves.select("shard"), "shard", "left_semi")
    found.withColumn("shard", named(F.col("shard"))).repartition("shard").write.partitionBy("shard").parquet(path)
    drop(leaves)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(read(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
s AS MATERIALIZED (SELECT depth, h >> (32 - depth) AS prefix, sum(bytes)::BIGINT AS bytes FROM (SELECT h, bytes, unnest(range(0, 33)) AS depth FROM d) GROUP BY ALL),
l AS (SELECT d.doc_id, d.h, d.bytes, min(s.depth) AS depth FROM d JOIN s ON s.prefix = d.h >> (32 - s.depth) WHERE s.bytes <= {LIMIT} OR s.depth = 32 GROUP BY ALL)
SELECT l.doc_id, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(l.h >> (32 - l.depth)), l.depth::INT, '0') END AS shard, l.depth::INT AS depth, l.bytes, s.bytes AS shard_bytes
FROM l JOIN s ON s.depth = l.depth AND s.prefix = l.h >> (32 - l.depth)
"""
