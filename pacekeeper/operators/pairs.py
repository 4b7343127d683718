"""Formation of (slow, fast) pairs and their unification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pacekeeper.functions.bins import speedup as speedup_of
from pacekeeper.sources.scratch import keep


def rank_solutions(solutions: DataFrame, group: str, metric: str, order: Sequence[str]) -> DataFrame:
    """Successful solutions with their rank by (metric, order) inside their group."""
    by = W.partitionBy(group).orderBy(metric, *order)
    return solutions.filter(F.col(metric) > 0).withColumn("rn", F.row_number().over(by))


def form_pairs(solutions: DataFrame, group: str, metric: str, order: Sequence[str], carry: Sequence[str] = (), least_speedup: float = 1.0) -> DataFrame:
    """All (fast, slow) pairs inside a group; ties count as pairs, hence ranks are compared and not metrics.

    One shuffle: ranking and both sides of the join share the partitioning by ``group``.
    """
    ranked = rank_solutions(solutions, group, metric, order)
    side = lambda p: ranked.select(F.col(group).alias(group), F.col("rn").alias(f"{p}_rn"), F.col(metric).alias(f"{p}_time"), *[F.col(c).alias(f"{p}_{c}") for c in carry])
    joined = side("fast").join(side("slow"), group).filter(F.col("fast_rn") < F.col("slow_rn"))
    return joined.withColumn("speedup", F.col("slow_time") / F.col("fast_time")).filter(F.col("speedup") >= least_speedup)


def form_pairs_nested(problems: DataFrame, record: str, metric: str = "avg_cpu_instruction", least_speedup: float = 1.0) -> DataFrame:
    """The same inside each record's ``results`` array: records of one problem are not mixed."""
    rows = problems.select(record, F.posexplode("results").alias("_pos", "_r")).select(record, "_pos", "_r.*").filter(F.col("status") == "success")
    return form_pairs(rows, record, metric, ["_pos"], [c for c in rows.columns if c not in (record, metric, "status")], least_speedup)


def unified(pair_id: Column, problem_id: Column, language: Column, slow_code: Column, fast_code: Column, slow_time: Column, fast_time: Column, speedup: Column, source: Column, **optional: Column) -> list[Column]:
    """Columns of the unified schema. Empty optional values are null, which the JSON writer leaves out."""
    sp = F.coalesce(speedup, F.when(fast_time > 0, F.try_divide(slow_time, fast_time)))
    blank = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return [
        pair_id.alias("pair_id"), problem_id.alias("problem_id"), language.alias("language"), slow_code.alias("slow_code"), fast_code.alias("fast_code"),
        F.round(F.coalesce(slow_time, F.lit(0.0)), 6).alias("slow_time"), F.round(F.coalesce(fast_time, F.lit(0.0)), 6).alias("fast_time"),
        F.round(F.coalesce(sp, F.lit(0.0)), 4).alias("speedup"), F.coalesce(blank(source), F.lit("unknown")).alias("source"),
        *[blank(c).alias(k) for k, c in optional.items()],
    ]


def number_rows(df: DataFrame, order: Sequence[str], name: str = "_no") -> DataFrame:
    """1, 2, 3 ... in the given order without a single-task sort: ranges dealt to all tasks, their counts, ranks inside."""
    kept = keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each task
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = kept.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return ranked.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_rank")).drop("_part", "_first", "_rank")


def number_in_groups(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "_no", size: str | None = None) -> DataFrame:
    """1, 2, 3 ... inside each group, and the group's ``size``; a group's rows are ranked in many tasks. Keys may be null."""
    numbered = keep(number_rows(df, [*by, *order], name), "ranked")
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    starts = numbered.groupBy(*keys).agg(F.min(name).alias("_start"), F.count("*").alias(size or "_size"))
    on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    out = numbered.join(starts, on).withColumn(name, F.col(name) - F.col("_start") + 1)
    return out.drop("_start", *[f"_g{i}" for i in range(len(by))], *([] if size else ["_size"]))


def convert_src_tgt(df: DataFrame, language: str = "cpp", order: str = "_ord") -> DataFrame:
    """Raw src/tgt pairs to the unified schema. The id counter counts rejected rows too."""
    numbered = number_rows(df, [order])
    n = F.col("_no").cast("string")
    ok = (F.coalesce("src_code", F.lit("")) != "") & (F.coalesce("tgt_code", F.lit("")) != "") & (F.coalesce("src_agg_runtime", F.lit(0)) > 0) & (F.coalesce("tgt_agg_runtime", F.lit(0)) > 0)
    return numbered.filter(ok).select(*unified(
        F.concat(F.lit("pie_"), n), F.coalesce("problem_id", F.concat(F.lit("unknown_"), n)), F.lit(language), F.col("src_code"), F.col("tgt_code"),
        F.col("src_agg_runtime"), F.col("tgt_agg_runtime"), F.col("speedup"), F.lit("pie"), slow_submission_id=F.col("src_id"), fast_submission_id=F.col("tgt_id"),
    ))


def convert_sampled(df: DataFrame, order: str = "_ord") -> DataFrame:
    """Already paired rows to the unified schema; times may be 0."""
    numbered = number_rows(df, [order])
    ok = (F.coalesce("slow_code", F.lit("")) != "") & (F.coalesce("fast_code", F.lit("")) != "")
    tiers = {k: F.col(k) for k in ("slow_submission_id", "fast_submission_id", "slow_tier", "fast_tier") if k in df.columns}
    return numbered.filter(ok).select(*unified(
        F.coalesce("pair_id", F.concat(F.lit("sampled_"), F.col("_no").cast("string"))), F.coalesce("problem_id", F.lit("unknown")), F.coalesce("language", F.lit("unknown")),
        F.col("slow_code"), F.col("fast_code"), F.col("slow_time"), F.col("fast_time"), F.col("speedup"), F.lit("sampled"), **tiers,
    ))


def convert_solutions(df: DataFrame, language: str = "java", metric: str = "avg_time_ns", least_speedup: float = 1.0, order: str = "_ord") -> DataFrame:
    """One row for each measured solution to unified pairs, numbered in the order of problems and ranks."""
    good = df.filter(F.col("status") == "success")
    pairs = form_pairs(good, "problem_id", metric, [order], ["code", "solution_id"], least_speedup)
    pairs = number_rows(pairs, ["problem_id", "fast_rn", "slow_rn"])
    return pairs.select(*unified(
        F.concat(F.lit(f"{language}_"), F.col("_no").cast("string")), F.col("problem_id"), F.lit(language), F.col("slow_code"), F.col("fast_code"), F.col("slow_time"), F.col("fast_time"),
        F.col("speedup"), F.lit(f"{language}_benchmark"), slow_submission_id=F.col("slow_solution_id"), fast_submission_id=F.col("fast_solution_id"),
    ))


def convert_problems(df: DataFrame, metric: str = "avg_cpu_instruction", least_speedup: float = 1.0, order: str = "_ord") -> DataFrame:
    """One row for each problem with a ``results`` array to unified pairs."""
    pairs = form_pairs_nested(df, order, metric, least_speedup).join(df.select(order, "problem_id"), order)
    pairs = number_rows(pairs, [order, "fast_rn", "slow_rn"])
    name = lambda c: F.concat(F.lit("sol_"), F.col(c).cast("string"))
    return pairs.select(*unified(
        F.concat(F.lit("python_"), F.col("_no").cast("string")), F.col("problem_id"), F.lit("python"), F.col("slow_code"), F.col("fast_code"), F.col("slow_time").cast("double"), F.col("fast_time").cast("double"),
        F.col("speedup"), F.lit("python_benchmark"), slow_submission_id=name("slow_solution_idx"), fast_submission_id=name("fast_solution_idx"),
    ))


def detect_format(df: DataFrame) -> str:
    """Which converter fits, by the columns that are there."""
    has = set(df.columns)
    if {"src_code", "tgt_code"} <= has:
        return "src_tgt"
    if {"slow_code", "fast_code"} <= has:
        return "sampled"
    if {"code", "avg_time_ns"} <= has:
        return "solutions"
    if "results" in has and df.schema["results"].dataType.typeName() == "array":
        return "problems"
    return "unknown"


CONVERTERS = {"src_tgt": convert_src_tgt, "sampled": convert_sampled, "solutions": convert_solutions, "problems": convert_problems}


def convert(df: DataFrame) -> DataFrame:
    kind = detect_format(df)
    if kind == "unknown":
        raise ValueError("no converter for columns " + ", ".join(df.columns))
    return CONVERTERS[kind](df)


def merge(frames: Sequence[DataFrame], order: str = "_ord") -> DataFrame:
    """All rows in file order with ids ``{language}_{n}``; n runs over all languages."""
    marked = [f.withColumn("_file", F.lit(i)) for i, f in enumerate(frames)]
    out = marked[0]
    for f in marked[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    numbered = number_rows(out, ["_file", order])
    return numbered.withColumn("pair_id", F.concat("language", F.lit("_"), F.col("_no").cast("string"))).drop("_no", "_file")


def with_speedup(df: DataFrame, slow: str = "slow_time", fast: str = "fast_time", given: str | None = "speedup", least: float = 1.5) -> DataFrame:
    """Rows with a usable speed-up of at least ``least``."""
    sp = speedup_of(F.col(given) if given else None, F.col(slow), F.col(fast))
    return df.withColumn("_speedup", sp).filter(F.col("_speedup") >= least)
