"""Weighted rendezvous sharding with gapless slots, in DataFrame functions only.

Every (key, shard) pair draws a uniform number u from a hash; the shard with the least
-ln(u)/weight wins. A further shard can only take keys for itself, so growth by one
shard moves about weight/total of the rows and none between old shards.

Slots number the rows of a shard 0, 1, 2 ... without a single-task sort: each shard is
cut into ``buckets`` hash ranges, the row counts of (shard, bucket) give every bucket its
first slot, and rows are numbered inside buckets only. By default there are as many buckets
as leave about 100,000 rows in each, between 256 and 16,384; the slots do not depend on it.
The table of counts has at most shards x buckets rows, which bounds the broadcast.

Edge cases: a null key is the key "null"; null text counts no bytes (crc32 0); rows with
one key go to one shard by law, but their slots are spread over buckets by key, text
checksum and size; only rows equal in all three share a bucket and are interchangeable.
An empty table gives an empty result. Input columns other than key and text are ignored,
so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DIGITS = 13  # hex digits of an MD5: 52 bits, exact in a double
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 256, 16384, 100_000


def _draw(*parts: Column) -> Column:
    """A whole number of 52 hash bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS), 16, 10).cast("long")


def _cost(key: Column, shard: int, weight: float) -> Column:
    u = (_draw(key, F.lit(str(shard))).cast("double") + 0.5) / float(16**DIGITS)
    return F.struct((-F.ln(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key among ``len(weights)`` weighted shards (all weights > 0)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    costs = [_cost(key, i, w) for i, w in enumerate(weights)]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    grown = [*weights, grown_weight]
    n = len(weights)
    if buckets is None:  # a power of two
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (docs.count() // (n * BUCKET_ROWS)).bit_length()))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32"), name.alias("_key"))
    costs = F.array(*[_cost(F.col("_key"), i, w) for i, w in enumerate(grown)])
    rows = rows.withColumn("_costs", costs)
    rows = rows.select(
        "doc_id", "size", "text_crc32",
        F.array_min(F.slice("_costs", 1, n))["shard"].alias("shard"),
        F.array_min("_costs")["shard"].alias("grown_shard"),
        _draw(F.col("_key"), F.col("text_crc32").cast("string"), F.col("size").cast("string"), F.lit("slot")).alias("_order"),
    ).withColumn("_bucket", F.floor(F.col("_order") / F.lit(16**DIGITS // buckets)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = W.partitionBy("shard", "_bucket").orderBy("_order", "doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_rank", F.row_number().over(within))
    return numbered.join(F.broadcast(first), ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_rank") - 1).alias("slot"), "grown_shard"
    )
