"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Two fingerprints differ in at most r bits exactly if the ball of radius floor(r/2) around
one meets the ball of radius ceil(r/2) around the other. Every distinct fingerprint emits
its variants; rows meet on a variant, where at most 65 fingerprints can lie for r = 2, so
no group grows with the data. Inside a group each member is linked to the least one
(a star instead of all pairs), the link is verified by its bit distance, and links are
deduplicated. Components come from randomised contraction over written tables.

Edge cases: null or blank text has no words and fingerprint zero, linked like any other;
fewer words than a shingle give one shingle of all words. Null doc_ids never name a
component unless it has no other. An empty table gives an empty result. Input columns
other than key and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from pacekeeper.llm.base import Scratch, arrow_map, utf8
from pacekeeper.operators.graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
_SHIFTS = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and split at 0x20 and 0x09-0x0D
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    grams = zip(*(words[i:] for i in range(width)))
    return np.array([digest(g, SEED) for g in map(b" ".join, grams)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as an unsigned number."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash of every row."""

    def run(batch: pa.RecordBatch):
        fps = np.array([fingerprint(shingle_hashes(t, width)) for t in utf8(batch.column(1))], np.uint64)
        yield {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64)), "text_hash": batch.column(2)}

    return arrow_map(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text), F.xxhash64(text)), run, "doc_id long, fp long, text_hash long", 512)


def _masks(radius: int) -> list[int]:
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints, enough to join all that lie within ``radius``."""
    near, far = radius // 2, radius - radius // 2

    def variants(r: int) -> DataFrame:
        masks = np.array(_masks(r), np.int64)

        def run(batch: pa.RecordBatch):
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            yield {"v": pa.array((fp[:, None] ^ masks[None, :]).ravel()), "fp": pa.array(np.repeat(fp, len(masks)))}

        return arrow_map(fps.select("fp"), run, "v long, fp long")

    if near == far:
        least = F.min("fp").over(W.partitionBy("v").orderBy("fp").rowsBetween(W.unboundedPreceding, 0))
        pairs = variants(near).select("fp", least.alias("least"))
    else:
        sides = variants(near).withColumn("side", F.lit(0)).unionByName(variants(far).withColumn("side", F.lit(1)))
        group = W.partitionBy("v")
        low = [F.min(F.when(F.col("side") == s, F.col("fp"))).over(group).alias(f"low{s}") for s in (0, 1)]
        pairs = sides.select("fp", "side", *low).select("fp", F.when(F.col("side") == 0, F.col("low1")).otherwise(F.col("low0")).alias("least"))
    pairs = pairs.filter("least is not null and fp <> least").select(F.least("fp", "least").alias("a"), F.greatest("fp", "least").alias("b"))
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) for every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, key, text, width), "rows")
    fps = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fps")
    roots = components(links(fps, radius))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = scratch.keep(named.join(least, "root").select("fp", "root", "component_id"), "of")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("root").alias("component_root"), "text_hash")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of every component stays, the one with the least doc_id; all columns stay."""
    return keep_first(docs, simhash_groups(docs, key, text, width, radius), key, text)


def keep_first(docs: DataFrame, groups: DataFrame, key: str, text: str) -> DataFrame:
    """Of ``docs`` the row with the least doc_id of every component of ``groups``."""
    found = Scratch(docs.sparkSession, "simhash-kept").keep(groups, "groups")
    first = found.filter("doc_id <=> component_id").groupBy("component_root").agg(F.min("doc_id").alias("__pk_id"), F.min("text_hash").alias("__pk_hash"), F.count("*").alias("__pk_n"))
    told = docs.withColumn("__pk_text_hash", F.xxhash64(text))
    left = told.join(first, F.col(key).cast("long").eqNullSafe(F.col("__pk_id")) & (F.col("__pk_text_hash") == F.col("__pk_hash")), "left_semi")
    if not first.filter("__pk_n > 1").isEmpty():  # rows repeated with one doc_id
        left = left.dropDuplicates([key, "__pk_text_hash"])
    return left.drop("__pk_text_hash")
