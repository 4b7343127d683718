"""Measurement tables: from raw runs and test matrices to statuses and solution metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pacekeeper.functions.stats import rollup_mean, rollup_sum, trimmed

KEYS = ["problem_id", "solution_id", "testcase_idx"]


def python_metrics(runs: DataFrame) -> DataFrame:
    """raw_runs (problem, solution, test, run, value, ok) to one row for each solution: trim 1, sum of means."""
    return rollup_sum(trimmed(runs.filter("ok"), KEYS, "value", 1), KEYS[:2]).withColumn("status", F.lit("success"))


def java_metrics(runs: DataFrame, trim: int = 2, least_runs: int = 3) -> DataFrame:
    """Warm-up runs do not count, but a test whose warm-up failed is invalid; trim 2, mean over valid tests."""
    cold = runs.filter("phase = 'warmup' and not ok").select(*KEYS).distinct()
    good = runs.filter("phase = 'measure' and ok").join(cold, KEYS, "left_anti")
    every = runs.groupBy(*KEYS[:2]).agg(F.count_distinct("testcase_idx").alias("total_testcases"))
    return rollup_mean(trimmed(good, KEYS, "value", trim, least_runs), KEYS[:2], every)


def problem_status(n_solutions: Column, n_tests: Column, least_tests: Column | int, n_common: Column, n_success: Column) -> Column:
    """Status of a problem: the first step that fails, or success."""
    return (
        F.when(n_solutions == 0, "no_solutions").when(n_tests == 0, "no_test_cases").when(n_tests < least_tests, "insufficient_test_cases")
        .when(F.coalesce(n_common, F.lit(0)) == 0, "no_common_valid_tc").when(F.coalesce(n_success, F.lit(0)) > 0, "success").otherwise("no_successful_solutions")
    )


def test_cases(df: DataFrame, most: int, key: str = "problem_id") -> DataFrame:
    """key, cases (array<struct<input, output>>): from input_output, then test_cases not there yet, then base_input.

    Fields hold JSON text or null; text that is no JSON gives no cases. Values stay JSON text.
    """
    schema = "struct<inputs:array<string>,input:array<string>,outputs:array<string>,output:array<string>>"
    case = "array<struct<input:string,output:string>>"
    io = F.from_json("input_output", schema)
    some = lambda a, b: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, a).otherwise(b)
    inputs, outputs = some(io["inputs"], io["input"]), some(io["outputs"], io["output"])
    first = F.transform(inputs, lambda v, i: F.struct(v.alias("input"), F.try_element_at(outputs, i + 1).alias("output")))
    none = F.array().cast(case)
    first = F.coalesce(first, none)
    second = F.coalesce(F.from_json("test_cases", case), none)
    third = F.coalesce(F.transform(F.from_json("base_input", "array<string>"), lambda v: F.struct(v.alias("input"), F.lit(None).cast("string").alias("output"))), none)
    fresh = F.filter(F.array_distinct(second), lambda c: ~F.exists(first, lambda d: c.eqNullSafe(d)))
    return df.select(key, F.slice(F.concat(first, fresh, third), 1, most).alias("cases"))
