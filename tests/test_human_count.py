"""Short numbers against Python's own rounding."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from pacekeeper.functions import text as T

SF = "/root/testdata/sf0.01"


def shown(n):
    return f"{n / 1_000_000:.1f}M" if n >= 1_000_000 else f"{n / 1_000:.1f}K" if n >= 1_000 else str(n)


def test_half_way_numbers(spark):
    rows = spark.range(0, 12_000_000, 50).select("id", T.human_count(F.col("id")).alias("s")).toArrow().to_pydict()
    assert rows["s"] == [shown(n) for n in rows["id"]] and len(rows["s"]) == 240_000


def test_every_order_is_shown(spark):
    keys = [r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()]
    got = {r.o_orderkey: r.shown for r in queries()["human_counts"](spark, SF).collect()}
    assert got == {k: shown(k * 977 % 3000017) for k in keys}
