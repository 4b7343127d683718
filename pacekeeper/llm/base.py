"""Shared plumbing: input tables, joins that split heavy keys, a membership filter of fixed size, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pacekeeper.sources.scratch import Scratch

#: A key is heavy if over one in HEAVY of all rows have it, so there are fewer than HEAVY of them.
HEAVY = 1000
_SIEVE_BITS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """Inner join in which no heavy key comes to one task.

    ``right`` has one row for a key; ``heavy`` has the heavy keys of ``left``, fewer than ``HEAVY``.
    Rows of ``right`` with those are broadcast, the others are shuffled.
    """
    names = F.broadcast(heavy.select(*keys))
    some = left.join(F.broadcast(right.join(names, keys, "left_semi")), keys)
    return some.unionByName(left.join(names, keys, "left_anti").join(right.join(names, keys, "left_anti"), keys))


def sieve(df: DataFrame, keys: DataFrame, column: str, own: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose 64-bit hash ``own`` may be in the ``column`` of ``keys`` (of the same name by default), and rows whose is not.

    The table of 2^24 bits (at most 2^18 rows of 64 bits) has one size whatever the data; it lets some
    rows through in vain and none out.
    """
    word = lambda c: F.shiftright(F.col(c).bitwiseAND(F.lit((1 << _SIEVE_BITS) - 1)), 6).alias("__pk_word")
    bit = lambda c: F.expr(f"shiftleft(1L, cast(`{c}` & 63 as int))")
    words = keys.select(word(column), bit(column).alias("_bit")).groupBy("__pk_word").agg(F.bit_or("_bit").alias("__pk_bits"))
    words = Scratch(df.sparkSession, "sieve").keep(words, "words")
    own = own or column
    told = df.withColumn("__pk_word", word(own)).join(F.broadcast(words), "__pk_word", "left")
    hit = F.coalesce(F.col("__pk_bits"), F.lit(0).cast("long")).bitwiseAND(bit(own)) != 0
    return told.filter(hit).select(*df.columns), told.filter(~hit).select(*df.columns)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: str, max_rows: int = 2048, ended: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over slices of at most ``max_rows`` rows; ``fn`` yields dicts of columns in the order of ``schema``.

    ``ended`` is called at the end of a task: its worker lives on, and what it holds counts against the tasks to come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, max_rows):
                for columns in fn(batch.slice(at, max_rows)):
                    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))
            pa.default_memory_pool().release_unused()
        if ended is not None:
            ended()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Values as UTF-8 bytes; null is the empty text."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]
