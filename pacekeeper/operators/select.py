"""Largest common set of valid tests and solutions, in closed form.

The greedy removes solutions in a fixed order of impact (tests that they alone fail); a test
is safe once all solutions that fail it are gone. So each test needs the greatest rank among
its failing solutions, and every score follows from counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def common_valid(passes: DataFrame, least_tests: int, problem: str = "problem_id", sol: str = "sol_idx", tc: str = "tc_idx", ok: str = "pass") -> DataFrame:
    """problem, k (number of removed solutions), n_tests, n_solutions of the best set; problems without one are left out."""
    p = passes.select(F.col(problem).alias("p"), F.col(sol).alias("s"), F.col(tc).alias("t"), F.col(ok).alias("ok"))
    alive = p.groupBy("p", "s").agg(F.max("ok").alias("any")).filter("any").select("p", "s")
    p = p.join(alive, ["p", "s"], "left_semi")
    fails = p.filter(~F.col("ok"))
    lone = fails.groupBy("p", "t").agg(F.count("*").alias("n"), F.min("s").alias("s")).filter("n = 1").groupBy("p", "s").agg(F.count("*").alias("impact"))
    rank = F.row_number().over(W.partitionBy("p").orderBy(F.desc("impact"), F.asc("s"))) - 1
    ranked = alive.join(lone, ["p", "s"], "left").fillna(0, ["impact"]).withColumn("rho", rank)
    need = p.join(ranked.select("p", "s", "rho"), ["p", "s"]).groupBy("p", "t").agg(F.max(F.when(~F.col("ok"), F.col("rho"))).alias("need"))
    sizes = alive.groupBy("p").agg(F.count("*").alias("n"))
    # k = -1 stands for "nothing removed": a test is safe then if no solution fails it.
    steps = need.groupBy("p", F.coalesce("need", F.lit(-1)).alias("k")).agg(F.count("*").alias("at_k"))
    safe = F.sum("at_k").over(W.partitionBy("p").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    # Between two needs the score only falls, so the steps themselves are all the candidates; k = -1 and k = 0 differ by one solution.
    scored = steps.withColumn("safe", safe).join(sizes, "p").withColumn("left", F.col("n") - F.col("k") - 1).filter((F.col("safe") >= least_tests) & (F.col("left") > 0))
    whole = F.col("k") == -1
    best = F.row_number().over(W.partitionBy("p").orderBy(F.desc(whole), F.desc(F.col("safe") * F.col("left")), F.asc("k")))
    picked = scored.withColumn("_best", best).filter("_best = 1")
    return picked.select(F.col("p").alias(problem), (F.col("k") + 1).cast("int").alias("n_removed"), F.col("safe").cast("long").alias("n_tests"), F.col("left").cast("long").alias("n_solutions"))


def common_members(passes: DataFrame, chosen: DataFrame, problem: str = "problem_id", sol: str = "sol_idx", tc: str = "tc_idx", ok: str = "pass") -> DataFrame:
    """The (problem, solution, test) rows of the chosen sets: solutions that stay and tests that all of them pass."""
    p = passes.select(F.col(problem).alias("p"), F.col(sol).alias("s"), F.col(tc).alias("t"), F.col(ok).alias("ok"))
    alive = p.groupBy("p", "s").agg(F.max("ok").alias("any")).filter("any").select("p", "s")
    p = p.join(alive, ["p", "s"], "left_semi")
    lone = p.filter(~F.col("ok")).groupBy("p", "t").agg(F.count("*").alias("n"), F.min("s").alias("s")).filter("n = 1").groupBy("p", "s").agg(F.count("*").alias("impact"))
    rank = F.row_number().over(W.partitionBy("p").orderBy(F.desc("impact"), F.asc("s"))) - 1
    ranked = alive.join(lone, ["p", "s"], "left").fillna(0, ["impact"]).withColumn("rho", rank)
    stay = ranked.join(chosen.select(F.col(problem).alias("p"), "n_removed"), "p").filter(F.col("rho") >= F.col("n_removed")).select("p", "s")
    left = p.join(stay, ["p", "s"], "left_semi")
    good = left.groupBy("p", "t").agg(F.min("ok").alias("all")).filter("all").select("p", "t")
    return left.join(good, ["p", "t"], "left_semi").select(F.col("p").alias(problem), F.col("s").alias(sol), F.col("t").alias(tc))
