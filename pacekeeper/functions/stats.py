"""Trimmed run statistics and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def trimmed(runs: DataFrame, keys: Sequence[str], value: str, trim: int = 1, least_runs: int = 1) -> DataFrame:
    """keys, n_runs, mean, std: without the ``trim`` least and greatest runs, if more than 2 x trim are there.

    A group of fewer than ``least_runs`` runs is left out. One run left has std 0.
    """
    group = W.partitionBy(*keys)
    ranked = runs.select(
        *keys, F.col(value).cast("double").alias("_v"), F.row_number().over(group.orderBy(value)).alias("_r"), F.count("*").over(group).alias("_n")
    ).filter(F.col("_n") >= least_runs)
    inside = (F.col("_n") <= 2 * trim) | ((F.col("_r") > trim) & (F.col("_r") <= F.col("_n") - trim))
    return ranked.filter(inside).groupBy(*keys).agg(
        F.max("_n").alias("n_runs"), F.avg("_v").alias("mean"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("std")
    )


def rsd(std: Column, mean: Column) -> Column:
    """Relative standard deviation in per cent; 0 unless the mean is positive."""
    return F.when(mean > 0, std / mean * 100).otherwise(0.0)


def rollup_sum(tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per solution: the sum of test means, and mean std over mean mean in per cent."""
    return tests.groupBy(*keys).agg(
        F.sum("mean").cast("long").alias("total_instructions"), F.round(rsd(F.avg("std"), F.avg("mean")), 4).alias("rsd_percent"), F.count("*").alias("num_test_cases")
    )


STABLE_RSD = 5.0


def rollup_mean(tests: DataFrame, keys: Sequence[str], all_tests: DataFrame | None = None) -> DataFrame:
    """Per solution: total and mean time over valid tests, mean of the tests' RSDs, status, stability.

    ``tests`` holds valid tests only; ``all_tests`` (keys, total_testcases) adds solutions without any.
    """
    out = tests.groupBy(*keys).agg(
        F.sum("mean").alias("total_time_ns"), F.avg("mean").alias("avg_time_ns"), F.avg(rsd(F.col("std"), F.col("mean"))).alias("rsd_percent"), F.count("*").alias("valid_testcases")
    )
    if all_tests is not None:
        out = all_tests.join(out, list(keys), "left").fillna(0, ["total_time_ns", "avg_time_ns", "rsd_percent", "valid_testcases"])
    status = F.when(F.col("valid_testcases") > 0, "success").otherwise("all_testcases_failed")
    return out.withColumn("status", status).withColumn("is_stable", F.col("rsd_percent") <= STABLE_RSD)


def run_summary(solutions: DataFrame, total: str = "total_instructions", spread: str = "rsd_percent") -> DataFrame:
    return solutions.agg(F.count("*").alias("solutions"), F.avg(total).alias("mean_total"), F.min(total).alias("min_total"), F.max(total).alias("max_total"), F.avg(spread).alias("mean_rsd"))
