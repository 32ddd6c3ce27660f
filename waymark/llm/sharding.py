"""Sharding by extendible hashing.

Documents hash to 64 bits. A bucket is a hash prefix; it splits on the next bit only while
its bytes exceed the limit. The directory maps every prefix of the greatest depth to its
bucket, whose own (local) depth may be smaller. Sums are taken once at STEP bits past the depth
that an even spread would need, and rolled up to every shorter prefix; only prefixes
still too large at that depth are summed again, STEP bits deeper.

Defined cases: null text has 0 bytes; rows with an equal key are told apart by their text's
hash, and equal rows by a turn within the pair, so that no key is too hot to split; a single row larger
than the limit is a shard of its own, marked oversized; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.plans.scratch import materialize

LIMIT = 64 << 20
STEP = 4
DEEPEST = 60


def _prefix(h: Column, depth: int) -> Column:
    """The first ``depth`` bits of a hash, as a number."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = materialize(docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), F.col(text)).alias("pair"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
                                   F.spark_partition_id().alias("slot")), "rows")
    # equal rows get a turn each; pairs that occur once, nearly all, don't travel for it
    many = rows.groupBy("pair").count().where("count > 1").select("pair")
    copies = rows.join(many, "pair", "left_semi").groupBy("pair", "key", "slot").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pair").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))  # a row per input partition
    turns = copies.withColumn("_b", before).withColumn("turn", F.explode(F.sequence(F.col("_b"), F.col("_b") + F.col("n") - 1)))  # the copies in one input partition
    once = rows.join(many, "pair", "left_anti").withColumn("turn", F.lit(0).cast("long"))
    return once.select("key", "pair", "bytes", "turn").unionByName(turns.select("key", "pair", "bytes", "turn"))


def build_directory(hashed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(prefix, depth, bytes, rows)`` of the buckets of ``hashed`` (h, bytes), none of which can be joined with its sibling."""
    done, at, depth_at = None, hashed, 0
    total = hashed.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    if not total["n"]:
        return hashed.select(F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("rows")).limit(0)
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(1, total["b"] / limit)))) + STEP)
    while True:
        sums = materialize(at.groupBy(_prefix(F.col("h"), depth).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")), "sums")
        # every prefix of a leaf between the last depth and this one, with its own sum
        up = (sums.withColumn("depth", F.explode(F.sequence(F.lit(depth_at), F.lit(depth))))
              .withColumn("prefix", F.expr(f"shiftrightunsigned(leaf, {depth} - depth)"))
              .groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")))
        # a bucket: small enough (or a single row, or as deep as it gets) while the prefix above is not
        ends = (F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.col("depth") >= DEEPEST)
        above = up.where(~ends).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("upper"))
        buckets = up.where(ends).withColumn("upper", F.shiftright("prefix", 1))
        if depth_at == 0:
            root = buckets.where("depth = 0")
            buckets = buckets.where("depth > 0").join(above, ["depth", "upper"], "left_semi").unionByName(root, allowMissingColumns=True)
        else:
            buckets = buckets.join(above, ["depth", "upper"], "left_semi")
        buckets = materialize(buckets.select("prefix", F.col("depth").cast("int").alias("depth"), "bytes", "rows"), "buckets")
        done = buckets if done is None else done.unionByName(buckets)
        large = sums.where((F.col("bytes") > limit) & (F.col("rows") > 1)).select(F.col("leaf").alias("_leaf"))
        if depth >= DEEPEST or large.isEmpty():
            return done
        at = at.join(large, _prefix(at["h"], depth) == large["_leaf"], "left_semi")
        depth_at, depth = depth, min(DEEPEST, depth + STEP)


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: key, bytes, shard (its bits as text, '' for a single shard), depth, shard_bytes and oversized."""
    rows = materialize(_hashed(docs, key, text).select("key", "bytes", F.xxhash64("pair", "turn").alias("h")), "hashed")
    directory = materialize(build_directory(rows, limit), "directory")
    depths = [r[0] for r in directory.select("depth").distinct().collect()]  # at most DEEPEST + 1 numbers
    # every row finds its bucket by one look-up per depth in use; the directory has a row per shard
    tries = rows.withColumn("try", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("h"), d).alias("prefix")) for d in sorted(depths)]))) \
        if depths else rows.withColumn("try", F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")))
    found = tries.select("key", "bytes", "try.depth", "try.prefix").join(
        directory.select("depth", "prefix", F.col("bytes").alias("shard_bytes")), ["depth", "prefix"])
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return found.select(F.col("key").alias(key), "bytes", bits.alias("shard"), "depth", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))
