"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its own last 32 bytes says so. Each distinct chunk is
moved once, under a 128-bit identifier, and verified: should two different byte strings
meet under one identifier, all identifiers are lengthened by the chunk's SHA-256 and
verified again. A document is then the ordered list of its identifiers (16 bytes for about
2 KB of text); documents are grouped by these recipes. What moves is one copy of each distinct
chunk, which for texts without repeats is all of their bytes once, and never a text as a whole.

Edge cases: a null text is the empty text, whose recipe is empty. Of equal texts the row
with the largest doc_id stays; a null doc_id is smaller than any other; among repeated rows
with that doc_id exactly one stays. An empty table gives an empty result. Input columns
other than key and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pacekeeper.llm.base import Scratch, arrow_map, utf8

LEAST, MOST, MASK_BITS = 256, 16384, 11
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)
_LOWEST = -(2**63)


def cut_points(text: bytes, least: int = LEAST, most: int = MOST, mask_bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of ``text``; content alone decides, as no chunk is shorter than the hash's 32 bytes but the last."""
    n = len(text)
    if n <= least:
        return [n] if n else []
    h = _GEAR[np.frombuffer(text, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    marks = (np.flatnonzero(h >> np.uint32(32 - mask_bits) == 0) + 1).tolist()
    ends, start = [], 0
    for m in marks:
        if m < 32:
            continue
        while m - start > most:
            start += most
            ends.append(start)
        if m - start >= least and m < n:
            ends.append(m)
            start = m
    while n - start > most:
        start += most
        ends.append(start)
    return [*ends, n]


def _chunks(text: bytes) -> Iterator[bytes]:
    start = 0
    for end in cut_points(text):
        yield text[start:end]
        start = end


def _identifier(chunk: bytes, level: int, bits: int) -> bytes:
    short = xxhash.xxh3_128_digest(chunk)[: bits // 8]
    return short if level == 0 else short + hashlib.sha256(chunk).digest()


def _chunk_table(docs: DataFrame, text: str, level: int, bits: int) -> DataFrame:
    def emit(batch: pa.RecordBatch):
        seen = {(_identifier(c, level, bits), c) for t in set(utf8(batch.column(0))) for c in _chunks(t)}
        yield {"cid": pa.array([x[0] for x in seen], pa.binary()), "chunk": pa.array([x[1] for x in seen], pa.binary())}

    return arrow_map(docs.select(text), emit, "cid binary, chunk binary")


def verified_level(docs: DataFrame, text: str = "text", bits: int = 128) -> int:
    """0 if the short identifiers tell all chunks apart, 1 if only the long ones do."""
    for level in (0, 1):
        sides = _chunk_table(docs, text, level, bits).groupBy("cid").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
        if sides.filter("a <> b").isEmpty():
            return level
    raise RuntimeError("two different chunks share both identifiers")


def _recipes(docs: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """doc_id, text_sha256, n_chunks, recipe and a row number for every row of ``docs``."""
    level = verified_level(docs, text, bits)

    def recipes(batch: pa.RecordBatch):
        texts = utf8(batch.column(1))
        lists = [[_identifier(c, level, bits) for c in _chunks(t)] for t in texts]
        yield {
            "doc_id": batch.column(0),
            "text_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            "n_chunks": pa.array([len(x) for x in lists], pa.int32()),
            "recipe": pa.array([b"".join(x) for x in lists], pa.binary()),
        }

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text))
    rows = arrow_map(plain, recipes, "doc_id long, text_sha256 string, n_chunks int, recipe binary")
    return rows.withColumn("row", F.monotonically_increasing_id())


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 128) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.keep(_recipes(docs, key, text, bits), "rows")
    rank = F.coalesce("doc_id", F.lit(_LOWEST))
    groups = scratch.keep(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max_by("row", rank).alias("keep_row")), "groups")
    return rows.join(groups, "recipe").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "n_chunks")


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns stay.

    One row of each group is all that this needs, so the groups are the only table that is written.
    """
    rank = F.coalesce("doc_id", F.lit(_LOWEST))
    last, first = F.max(F.struct(rank, F.col("row").alias("row")))["row"], -F.max(F.struct(rank, (-F.col("row")).alias("row")))["row"]
    groups = _recipes(docs, key, text, 128).groupBy("recipe").agg(F.max("doc_id").alias("__pk_id"), F.min("text_sha256").alias("__pk_sha"), (last != first).alias("repeated"))
    groups = Scratch(docs.sparkSession, "exact-kept").keep(groups.select("__pk_id", "__pk_sha", "repeated"), "groups")
    stay = groups.select("__pk_id", "__pk_sha")
    told = docs.withColumn("__pk_sha", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    left = told.join(stay, F.col(key).cast("long").eqNullSafe(F.col("__pk_id")) & (told["__pk_sha"] == stay["__pk_sha"]), "left_semi")
    if not groups.filter("repeated").isEmpty():  # rows repeated with one doc_id
        left = left.dropDuplicates([key, "__pk_sha"])
    return left.drop("__pk_sha")
