"""Analysis of prediction files: repair, accuracy, pair outcomes, error of predicted speed-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pacekeeper.functions import parse as P
from pacekeeper.functions.bins import difficulty as difficulty_of
from pacekeeper.functions.text import base_id
from pacekeeper.operators.pairs import number_in_groups


def repair(df: DataFrame, file: str = "file") -> DataFrame:
    """Rows of ``*_7b.jsonl`` files get their answers parsed anew, from the start of the response.

    Files of zero-shot runs hold letters, the others a direction and a number.
    """
    small, zero = F.lower(file).contains("_7b.jsonl"), F.lower(file).contains("zeroshot")
    body = F.coalesce("response", F.lit(""))
    early, letter = P.format_early(body), P.letter_early(body)
    fixed = df.withColumns({"_early": early, "_letter": letter})
    pick = lambda on, new, old: F.when(small & on, new).otherwise(F.col(old))
    out = fixed.withColumns({
        "predicted_direction": pick(~zero, F.col("_early.direction"), "predicted_direction"),
        "predicted_value": pick(~zero, F.col("_early.value"), "predicted_value"),
        "predicted": pick(zero, F.col("_letter"), "predicted"),
        "correct": F.when(small & ~zero, P.is_correct(F.col("_early.direction"), F.col("expected_direction"))).when(small, P.is_correct(F.col("_letter"), F.col("expected"))).otherwise(F.col("correct")),
    })
    return out.drop("_early", "_letter")


def accuracy(df: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    rows = df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(correct).alias("correct"))
    return rows.withColumn("accuracy", F.round(F.col("correct") * 100.0 / F.col("total"), 4))


def by_direction(df: DataFrame, by: list[str], order: str = "_ord") -> DataFrame:
    """One row for each base pair: the last forward and the last reversed row decide; difficulty is the first seen.

    Any other direction than forward counts as reversed. An aggregation instead of a self-join.
    """
    forward = F.coalesce("direction", F.lit("forward")) == "forward"
    sp = F.coalesce("speedup", F.lit(1.0))
    first = F.min_by(F.coalesce("difficulty", difficulty_of(sp)), order)
    last = lambda on: F.max_by(F.coalesce("correct", F.lit(False)), F.when(on, F.col(order)))
    return df.groupBy(*by, base_id("pair_id").alias("base_id")).agg(
        F.max(forward).alias("has_forward"), F.max(~forward).alias("has_reversed"), last(forward).alias("forward_correct"), last(~forward).alias("reversed_correct"), first.alias("difficulty")
    )


def _outcomes() -> list[Column]:
    both, none = F.col("forward_correct") & F.col("reversed_correct"), ~F.col("forward_correct") & ~F.col("reversed_correct")
    return [F.count("*").alias("pairs"), F.count_if(both).alias("both_correct"), F.count_if(none).alias("both_wrong"), F.count_if(~both & ~none).alias("bias")]


def pair_outcomes(df: DataFrame, by: list[str], order: str = "_ord") -> DataFrame:
    """Outcomes of base pairs that have both directions, with rates in per cent."""
    whole = by_direction(df, [c for c in by if c != "difficulty"], order).filter("has_forward and has_reversed")
    out = whole.groupBy(*by).agg(*_outcomes())
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("pairs")), F.lit(0.0)), 4)
    return out.withColumns({f"{c}_rate": rate(c) for c in ("both_correct", "both_wrong", "bias")})


def value_errors(df: DataFrame, by: list[str]) -> DataFrame:
    """n, MAE and RMSE of predicted values; 0 where there is none."""
    e = F.col("predicted_value").try_cast("double") - F.col("expected_value").try_cast("double")
    return df.withColumn("_e", e).groupBy(*by).agg(
        F.count("_e").alias("n"), F.round(F.coalesce(F.avg(F.abs("_e")), F.lit(0.0)), 6).alias("mae"), F.round(F.coalesce(F.sqrt(F.avg(F.col("_e") * F.col("_e"))), F.lit(0.0)), 6).alias("rmse")
    )


def report(df: DataFrame, file: str = "file", order: str = "_ord") -> DataFrame:
    """One row for each result file: accuracy, pair outcomes, value errors, and a map by difficulty."""
    samples = accuracy(df, [file]).join(pair_outcomes(df, [file], order), file, "left").join(value_errors(df, [file]), file)
    level = df.withColumn("difficulty", F.coalesce("difficulty", difficulty_of(F.coalesce("speedup", F.lit(1.0)))))
    hard = accuracy(level, [file, "difficulty"]).join(pair_outcomes(df, [file, "difficulty"], order), [file, "difficulty"], "left")
    entry = F.struct("total", "correct", "accuracy", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pairs", "both_correct", "both_wrong")])
    maps = hard.select(file, F.struct("difficulty", entry).alias("_e")).groupBy(file).agg(F.map_from_entries(F.array_sort(F.collect_list("_e"))).alias("by_difficulty"))
    return samples.join(maps, file, "left")


def direction_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("samples"), F.count_distinct("problem_id").alias("problems"), F.count_if(F.col("direction") == "forward").alias("forward"), F.count_if(F.col("direction") == "reversed").alias("reversed"))


def problem_counts(df: DataFrame, problem: str, by: list[str]) -> DataFrame:
    """Number of problems, and mean and (population) deviation of rows for each problem."""
    n = df.groupBy(*by, problem).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.count("*").alias("problems"), F.round(F.avg("n"), 6).alias("mean_rows"), F.round(F.stddev_pop("n"), 6).alias("std_rows"), F.max("n").alias("most_rows"))


def log_histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins of log2(value) between the least and the greatest."""
    x = F.log2(value)
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    part = F.when(F.col("_hi") <= F.col("_lo"), 0).otherwise(F.least(F.floor((x - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1)))
    return df.crossJoin(F.broadcast(ends)).groupBy(part.cast("int").alias("bucket")).agg(F.count("*").alias("n"))  # ends is one row


def empirical_cdf(df: DataFrame, by: str, value: str, tie: list[str]) -> DataFrame:
    """value and rank / count inside each group; equal values step one by one."""
    ranked = number_in_groups(df.select(by, value, *[c for c in tie if c not in (by, value)]), [by], [value, *tie], "_no", "_n")
    return ranked.select(by, value, (F.col("_no") / F.col("_n")).alias("cdf"))
