"""Queries on measurements: runs are events (solution = user, test = event type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pacekeeper.functions import stats as S
from pacekeeper.operators import execute as X, measure as M, select as J
from pacekeeper.plans.registry import query, table

_TRIMMED = """
ranked AS (
  SELECT user_id, event_type, value AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events
),
tests AS (
  SELECT user_id, event_type, max(n) AS n_runs, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std
  FROM ranked WHERE {keep} GROUP BY user_id, event_type
)"""
_ONE = _TRIMMED.format(keep="n <= 2 OR (r > 1 AND r <= n - 1)")
_TWO = _TRIMMED.format(keep="n >= 3 AND (n <= 4 OR (r > 2 AND r <= n - 2))")


def _tests(spark: SparkSession, sf_dir: str, trim: int = 1, least: int = 1) -> DataFrame:
    return S.trimmed(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", trim, least)


@query(f"WITH {_ONE} SELECT user_id, event_type, n_runs, round(mean, 6) AS mean, round(std, 6) AS std FROM tests")
def trimmed_stats(spark, sf_dir):
    return _tests(spark, sf_dir).select("user_id", "event_type", "n_runs", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {_ONE} SELECT user_id, trunc(sum(mean))::BIGINT AS total_instructions,
  round(CASE WHEN avg(mean) > 0 THEN avg(std) / avg(mean) * 100 ELSE 0 END, 4) AS rsd_percent, count(*) AS num_test_cases FROM tests GROUP BY user_id""")
def solution_rollup(spark, sf_dir):
    return S.rollup_sum(_tests(spark, sf_dir), ["user_id"])


_JAVA = f"""WITH {_TWO}, sols AS (
  SELECT e.user_id, coalesce(sum(mean), 0) AS total_time_ns, coalesce(avg(mean), 0) AS avg_time_ns, coalesce(avg(CASE WHEN mean > 0 THEN std / mean * 100 ELSE 0 END), 0) AS rsd_percent,
    count(mean) AS valid_testcases, max(total) AS total_testcases
  FROM (SELECT user_id, count(DISTINCT event_type) AS total FROM events GROUP BY user_id) e LEFT JOIN tests t USING (user_id) GROUP BY e.user_id
)"""


def _java(spark, sf_dir) -> DataFrame:
    every = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("total_testcases"))
    return S.rollup_mean(_tests(spark, sf_dir, 2, 3), ["user_id"], every)


@query(_JAVA + """ SELECT user_id, total_testcases, valid_testcases, round(total_time_ns, 4) AS total_time_ns, round(avg_time_ns, 4) AS avg_time_ns, round(rsd_percent, 4) AS rsd_percent,
  CASE WHEN valid_testcases > 0 THEN 'success' ELSE 'all_testcases_failed' END AS status, rsd_percent <= 5 AS is_stable FROM sols""")
def solution_times(spark, sf_dir):
    rounded = [F.round(c, 4).alias(c) for c in ("total_time_ns", "avg_time_ns", "rsd_percent")]
    return _java(spark, sf_dir).select("user_id", "total_testcases", "valid_testcases", *rounded, "status", "is_stable")


@query(_JAVA + " SELECT rsd_percent <= 5 AS is_stable, count(*) AS solutions FROM sols GROUP BY 1")
def stability(spark, sf_dir):
    return _java(spark, sf_dir).groupBy("is_stable").agg(F.count("*").alias("solutions"))


@query(f"""WITH {_ONE}, sols AS (SELECT user_id, trunc(sum(mean))::BIGINT AS t, round(CASE WHEN avg(mean) > 0 THEN avg(std) / avg(mean) * 100 ELSE 0 END, 4) AS r FROM tests GROUP BY user_id)
  SELECT count(*) AS solutions, round(avg(t), 4) AS mean_total, min(t) AS min_total, max(t) AS max_total, round(avg(r), 4) AS mean_rsd FROM sols""")
def run_summary(spark, sf_dir):
    out = S.run_summary(S.rollup_sum(_tests(spark, sf_dir), ["user_id"]))
    return out.select("solutions", F.round("mean_total", 4).alias("mean_total"), "min_total", "max_total", F.round("mean_rsd", 4).alias("mean_rsd"))


_PASSES = """
p AS (
  SELECT user_id % 20 AS problem_id, user_id AS sol_idx, t AS tc_idx, (user_id * 7 + t * 13 + n) % 10 <> 0 AS pass
  FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), range(0, 25) AS r(t)
)"""


def _passes(spark, sf_dir) -> DataFrame:
    """A dense pass matrix: 20 problems, one solution for each user, 25 tests."""
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    rows = n.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(24))))
    ok = (F.col("user_id") * 7 + F.col("t") * 13 + F.col("n")) % 10 != 0
    return rows.select((F.col("user_id") % 20).alias("problem_id"), F.col("user_id").alias("sol_idx"), F.col("t").cast("long").alias("tc_idx"), ok.alias("pass"))


_CHOSEN = f"""WITH RECURSIVE {_PASSES.strip()},
alive AS (SELECT problem_id, sol_idx FROM p GROUP BY ALL HAVING bool_or(pass)),
q AS (SELECT p.* FROM p SEMI JOIN alive USING (problem_id, sol_idx)),
lone AS (SELECT problem_id, s AS sol_idx, count(*) AS impact FROM (SELECT problem_id, tc_idx, min(sol_idx) AS s FROM q WHERE NOT pass GROUP BY ALL HAVING count(*) = 1) GROUP BY ALL),
ranked AS (SELECT a.problem_id, a.sol_idx, row_number() OVER (PARTITION BY a.problem_id ORDER BY coalesce(impact, 0) DESC, a.sol_idx) - 1 AS rho FROM alive a LEFT JOIN lone USING (problem_id, sol_idx)),
sizes AS (SELECT problem_id, count(*) AS n FROM alive GROUP BY 1),
tries AS (SELECT problem_id, n, unnest(range(0, n)) AS j FROM sizes),
scored AS (
  SELECT problem_id, j, n, count(*) FILTER (fails = 0) AS safe FROM (
    SELECT t.problem_id, t.j, t.n, q.tc_idx, count(*) FILTER (NOT pass AND rho >= j) AS fails
    FROM tries t JOIN q USING (problem_id) JOIN ranked r ON r.problem_id = q.problem_id AND r.sol_idx = q.sol_idx GROUP BY ALL) GROUP BY ALL
),
chosen AS (
  SELECT problem_id, j AS n_removed, safe AS n_tests, n - j AS n_solutions FROM scored WHERE safe >= 4
  QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY j = 0 DESC, safe * (n - j) DESC, j) = 1
)"""


@query(_CHOSEN + " SELECT problem_id, n_removed::INTEGER AS n_removed, n_tests, n_solutions FROM chosen")
def common_valid(spark, sf_dir):
    return J.common_valid(_passes(spark, sf_dir), 4)


@query(_CHOSEN + """, stay AS (SELECT problem_id, sol_idx FROM ranked JOIN chosen USING (problem_id) WHERE rho >= n_removed),
  kept AS (SELECT q.* FROM q SEMI JOIN stay USING (problem_id, sol_idx)), good AS (SELECT problem_id, tc_idx FROM kept GROUP BY ALL HAVING bool_and(pass))
  SELECT problem_id, sol_idx, tc_idx FROM kept SEMI JOIN good USING (problem_id, tc_idx)""")
def common_members(spark, sf_dir):
    passes = _passes(spark, sf_dir)
    return J.common_members(passes, J.common_valid(passes, 4))


@query(f"""WITH RECURSIVE {_PASSES.strip()} SELECT problem_id, tc_idx FROM p GROUP BY ALL HAVING bool_and(pass)""")
def safe_tests(spark, sf_dir):
    return _passes(spark, sf_dir).groupBy("problem_id", "tc_idx").agg(F.min("pass").alias("all")).filter("all").select("problem_id", "tc_idx")


@query("""SELECT user_id, CASE WHEN n_sol = 0 THEN 'no_solutions' WHEN n_tc = 0 THEN 'no_test_cases' WHEN n_tc < 5 THEN 'insufficient_test_cases' WHEN common = 0 THEN 'no_common_valid_tc'
  WHEN good > 0 THEN 'success' ELSE 'no_successful_solutions' END AS status
  FROM (SELECT user_id, count(*) FILTER (event_id % 3 > 0) AS n_sol, count(*) AS n_tc, count(DISTINCT event_type) % 3 AS common, count(*) FILTER (value > 50) AS good FROM events GROUP BY 1)""")
def problem_status(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_id") % 3 > 0).alias("s"), F.count("*").alias("t"), (F.count_distinct("event_type") % 3).alias("c"), F.count_if(F.col("value") > 50).alias("g"))
    return n.select("user_id", M.problem_status(F.col("s"), F.col("t"), 5, F.col("c"), F.col("g")).alias("status"))


@query("""WITH picked AS (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || ':' || event_id), event_id) <= 10) SELECT * FROM picked""")
def pick_tests(spark, sf_dir):
    from pacekeeper.operators.sampling import pick_per_group

    return pick_per_group(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 10)


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || ':' || event_id), event_id) AS r FROM events)
  WHERE r <= least(greatest(floor(n * 0.3), 1), 20)""")
def sample_tests(spark, sf_dir):
    from pacekeeper.operators.sampling import pick_share

    return pick_share(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 0.3, 20)


@query("""SELECT user_id AS problem_id, count(*)::INTEGER AS n_cases, sum(CASE WHEN x.output IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_outputs FROM (
  SELECT user_id, unnest([{'input': '1', 'output': user_id::VARCHAR}, {'input': '2', 'output': NULL}, {'input': event_type, 'output': 'o'}, {'input': 'b', 'output': NULL}]) AS x
  FROM (SELECT user_id, min(event_type) AS event_type FROM events GROUP BY 1)) GROUP BY 1""")
def merge_test_cases(spark, sf_dir):
    """Three sources of test cases: the second repeats one of the first, and no text is no case."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_type").alias("event_type"))
    uid = F.col("user_id").cast("string")
    io = F.to_json(F.struct(F.array(F.lit("1"), F.lit("2")).alias("inputs"), F.array(uid).alias("outputs")))
    case = lambda a, b: F.struct(a.alias("input"), b.alias("output"))
    more = F.to_json(F.array(case(F.lit("1"), uid), case(F.col("event_type"), F.lit("o"))))
    raw = e.select(F.col("user_id").alias("problem_id"), io.alias("input_output"), more.alias("test_cases"), F.lit('["b"]').alias("base_input"))
    out = M.test_cases(raw, 50)
    return out.select("problem_id", F.size("cases").alias("n_cases"), F.size(F.filter("cases", lambda c: c["output"].isNotNull())).cast("long").alias("n_outputs"))


@query("""WITH l AS (SELECT l_orderkey AS c, l_linenumber AS t, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS rc0, CASE WHEN l_quantity = 30 THEN -1 ELSE 0 END AS rc1, l_returnflag AS o0, CASE WHEN l_quantity % 10 = 0 THEN 'X' ELSE l_returnflag END AS o1 FROM lineitem),
  j AS (SELECT a.c, a.rc0 <> 0 OR b.rc1 <> 0 AS bad, a.o0 = b.o1 AS same FROM l a JOIN l b ON a.c = b.c AND a.t = b.t),
  n AS (SELECT c, count(*) FILTER (NOT bad AND same) AS passed, count(*) FILTER (NOT bad AND NOT same) AS failed, count(*) FILTER (bad) AS error_cases FROM j GROUP BY 1)
  SELECT o_orderkey AS code_id, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(error_cases, 0) AS error_cases, round(coalesce(passed::DOUBLE / (passed + failed + error_cases), 1.0), 9) AS pass_rate, coalesce(failed, 0) = 0 AS is_equivalent FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN n ON c = o_orderkey""")
def equivalence(spark, sf_dir):
    """Two versions of a program (order) on its tests (lines); orders without lines have no test."""
    lines = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_orderkey").alias("code_id"), F.col("l_linenumber").alias("test_id")]
    before = lines.select(*keys, F.when(F.col("l_linenumber") == 7, 1).otherwise(0).alias("rc"), F.concat("l_returnflag", F.lit("  ")).alias("output"))
    after = lines.select(*keys, F.when(F.col("l_quantity") == 30, -1).otherwise(0).alias("rc"), F.when(F.col("l_quantity") % 10 == 0, "X").otherwise(F.col("l_returnflag")).alias("output"))
    out = X.equivalence(before, after, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("code_id")))
    return out.select("code_id", "passed", "failed", "error_cases", F.round("pass_rate", 9).alias("pass_rate"), "is_equivalent")


@query("""SELECT l_orderkey AS code_id, l_linenumber AS test_id, l_quantity <> 30 AND (l_linenumber % 2 = 0 OR l_returnflag = 'N') AS passed FROM lineitem WHERE l_linenumber <= 7""")
def pass_table(spark, sf_dir):
    """Which program passed which test; even tests expect nothing but a good end."""
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("code_id"), F.col("l_linenumber").alias("test_id"), F.when(F.col("l_quantity") == 30, -1).otherwise(0).alias("rc"), F.concat("l_returnflag", F.lit("  ")).alias("output"))
    tests = spark.range(1, 8).select(F.col("id").alias("test_id"), F.when(F.col("id") % 2 == 1, "N").alias("expected"))
    return X.pass_table(results, tests)
