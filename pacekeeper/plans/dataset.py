"""Queries that build the data set. Solutions are line items (problem = order, metric = price)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pacekeeper.functions import bins as B
from pacekeeper.operators import analyze as A, dedup as D, pairs as P, replenish as R, sampling as S
from pacekeeper.plans.registry import query, table

ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ORDER = ", ".join(ORDER)
_PAIRS = f"""
r AS (SELECT l_orderkey, l_extendedprice AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, {_ORDER}) AS rn FROM lineitem WHERE l_extendedprice > 0),
pairs AS (SELECT f.l_orderkey, f.rn AS fast_rn, s.rn AS slow_rn, f.t AS fast_time, s.t AS slow_time, s.t / f.t AS speedup FROM r f JOIN r s ON f.l_orderkey = s.l_orderkey AND f.rn < s.rn)"""
_LABELS = " ".join(f"WHEN speedup >= {a}" + ("" if b == float("inf") else f" AND speedup < {b}") + f" THEN {i}" for i, (a, b) in enumerate(zip(B.SAMPLING_BINS, B.SAMPLING_BINS[1:])))
_BIN = f"CASE {_LABELS} END"


def _pairs(spark, sf_dir, least: float = 1.0) -> DataFrame:
    return P.form_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", ORDER, (), least)


@query(f"WITH {_PAIRS.strip()} SELECT l_orderkey, fast_rn, slow_rn, fast_time, slow_time, round(speedup, 4) AS speedup FROM pairs WHERE speedup >= 1.5")
def pair_construct(spark, sf_dir):
    return _pairs(spark, sf_dir, 1.5).select("l_orderkey", "fast_rn", "slow_rn", "fast_time", "slow_time", F.round("speedup", 4).alias("speedup"))


@query(f"""WITH {_PAIRS.strip()} SELECT CASE WHEN speedup >= 8 THEN 'easy' WHEN speedup >= 4 THEN 'medium' ELSE 'hard' END AS difficulty, count(*) AS n_pairs, round(avg(speedup), 4) AS mean_speedup FROM pairs GROUP BY 1""")
def pair_difficulty(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy(B.difficulty(F.col("speedup")).alias("difficulty")).agg(F.count("*").alias("n_pairs"), F.round(F.avg("speedup"), 4).alias("mean_speedup"))


@query("""WITH p AS (SELECT l_orderkey, list({'t': l_extendedprice, 'i': l_partkey}) AS l FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
  e AS (SELECT l_orderkey, unnest(l).t AS t FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY t) AS rn FROM e)
  SELECT f.l_orderkey AS problem, count(*) AS n_pairs, round(max(s.t / f.t), 4) AS best FROM r f JOIN r s ON f.l_orderkey = s.l_orderkey AND f.rn < s.rn GROUP BY 1""")
def pair_nested(spark, sf_dir):
    """The same from a results array in each record; results that did not succeed do not count."""
    one = F.struct((F.col("l_linestatus") == "F").alias("ok"), F.when(F.col("l_linestatus") == "F", "success").otherwise("failed").alias("status"), F.col("l_extendedprice").alias("avg_cpu_instruction"), F.lit("").alias("code"))
    problems = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("problem")).agg(F.collect_list(one).alias("results"))
    return P.form_pairs_nested(problems, "problem").groupBy("problem").agg(F.count("*").alias("n_pairs"), F.round(F.max("speedup"), 4).alias("best"))


@query(f"""WITH {_PAIRS.strip()}, b AS (SELECT {_BIN} AS i, count(*) AS n FROM pairs GROUP BY 1)
  SELECT d.i::INTEGER AS bin_idx, d.label, coalesce(n, 0) AS n_pairs FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(B.labels(B.SAMPLING_BINS)))}) d(i, label) LEFT JOIN b USING (i)""")
def bin_counts(spark, sf_dir):
    counts = _pairs(spark, sf_dir).groupBy(B.bin_index(F.col("speedup"), B.SAMPLING_BINS).alias("bin_idx")).agg(F.count("*").alias("n_pairs"))
    dim = spark.createDataFrame(list(enumerate(B.labels(B.SAMPLING_BINS))), "bin_idx int, label string")
    return dim.join(counts, "bin_idx", "left").fillna(0, ["n_pairs"])


@query(f"""WITH {_PAIRS.strip()} SELECT CASE WHEN speedup >= 8 THEN 'easy [≥8.0x]' WHEN speedup >= 4 THEN 'medium [4.0x-8.0x)' WHEN speedup >= 2 THEN 'hard [2.0x-4.0x)' ELSE 'below_threshold' END AS label,
  CASE WHEN speedup >= 8 THEN 2 WHEN speedup >= 4 THEN 1 WHEN speedup >= 2 THEN 0 ELSE -1 END AS idx, count(*) AS n FROM pairs GROUP BY ALL""")
def evaluation_bins(spark, sf_dir):
    b = B.evaluation_bin(F.col("speedup"))
    return _pairs(spark, sf_dir).select(b.alias("b")).groupBy("b.label", "b.idx").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS slow, l_quantity - 1 AS fast, CASE l_linenumber % 4 WHEN 0 THEN 'x' WHEN 1 THEN l_quantity::VARCHAR END AS given FROM lineitem),
  s AS (SELECT *, CASE WHEN given IS NOT NULL THEN try_cast(given AS DOUBLE) WHEN fast > 0 THEN slow / fast END AS speedup FROM g)
  SELECT l_linenumber, count(*) AS n, round(sum(speedup), 2) AS total FROM s WHERE speedup >= 1.5 GROUP BY 1""")
def usable_speedups(spark, sf_dir):
    given = F.when(F.col("l_linenumber") % 4 == 0, "x").when(F.col("l_linenumber") % 4 == 1, F.col("l_quantity").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_extendedprice").alias("slow_time"), (F.col("l_quantity") - 1).alias("fast_time"), given.alias("speedup"))
    return P.with_speedup(rows).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("_speedup"), 2).alias("total"))


@query("""SELECT 'pie_' || row_number() OVER (ORDER BY doc_id) AS pair_id, coalesce(nullif(source, 'src1'), 'unknown_' || row_number() OVER (ORDER BY doc_id)) AS problem_id, n_chars::DOUBLE AS slow_time,
  round(n_chars / 7.0, 6) AS fast_time, 7.0::DOUBLE AS speedup FROM documents QUALIFY n_chars % 5 > 0 AND text <> ''""")
def convert_src_tgt(spark, sf_dir):
    """Rows with time 0 are rejected but numbered."""
    docs = table(spark, sf_dir, "documents")
    n = F.when(F.col("n_chars") % 5 > 0, F.col("n_chars").cast("double")).otherwise(0.0)
    raw = docs.select(F.col("doc_id").alias("_ord"), F.nullif("source", F.lit("src1")).alias("problem_id"), F.col("text").alias("src_code"), F.col("text").alias("tgt_code"), n.alias("src_agg_runtime"), (n / 7).alias("tgt_agg_runtime"),
                      F.lit(None).cast("double").alias("speedup"), F.lit("").alias("src_id"), F.lit(None).cast("string").alias("tgt_id"))
    return P.convert(raw).select("pair_id", "problem_id", "slow_time", "fast_time", "speedup")


@query("""WITH u AS (SELECT 0 AS f, doc_id AS o, lang FROM documents UNION ALL SELECT 1, conv_id * 1000 + turn, role FROM conversations)
  SELECT lang || '_' || row_number() OVER (ORDER BY f, o) AS pair_id, lang AS language FROM u""")
def merge_renumber(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_ord"), F.col("lang").alias("language"))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("_ord"), F.col("role").alias("language"))
    return P.merge([docs, turns]).select("pair_id", "language")


# -- sampling ---------------------------------------------------------------

_TARGETS = """
sizes AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1),
targets AS (SELECT lang, n, least(n, {total} // (SELECT count(*) FROM sizes) + CASE WHEN row_number() OVER (ORDER BY lang) <= {total} % (SELECT count(*) FROM sizes) THEN 1 ELSE 0 END) AS target FROM sizes)"""
_U = "(('0x' || substr(md5('42:' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0"


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def _targets(docs: DataFrame, total: int) -> dict:
    return S.bin_targets(S.bin_sizes(docs, "lang"), total)


@query(f"WITH {_TARGETS.format(total=203).strip()} SELECT doc_id, lang FROM documents JOIN targets USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= any_value(target) OVER (PARTITION BY lang)")
def sample_natural(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return S.sample_natural(docs, "lang", "doc_id", _targets(docs, 203)).select("doc_id", "lang")


@query(f"""WITH {_TARGETS.format(total=203).strip()}, st AS (SELECT lang, avg(log2(n_chars)) AS m, stddev_pop(log2(n_chars)) AS s FROM documents GROUP BY 1),
  c AS (SELECT doc_id, lang, target, round(-ln({_U}) / exp(-0.5 * pow(CASE WHEN s < 1e-6 THEN 0 ELSE (log2(n_chars) - m) / s END, 2)), 6) AS cost FROM documents JOIN st USING (lang) JOIN targets USING (lang))
  SELECT doc_id, lang FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY cost, doc_id) <= target""")
def sample_weighted(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return S.sample_weighted(docs, "lang", "doc_id", "n_chars", _targets(docs, 203)).select("doc_id", "lang")


@query(f"""WITH {_TARGETS.format(total=203).strip()}, e AS (SELECT lang, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY 1),
  s AS (SELECT doc_id, lang, target, CASE WHEN hi - lo < 1e-6 THEN 0 ELSE least(floor((n_chars - lo) / ((hi + 1e-6 - lo) / 10)), 9) END::INTEGER AS sub FROM documents JOIN e USING (lang) JOIN targets USING (lang)),
  q AS (SELECT *, row_number() OVER (PARTITION BY lang, sub ORDER BY md5('42:' || doc_id), doc_id) <= target // 10 + CASE WHEN sub < target % 10 THEN 1 ELSE 0 END AS first FROM s),
  t AS (SELECT *, count(*) FILTER (first) OVER (PARTITION BY lang) AS got, row_number() OVER (PARTITION BY lang, first ORDER BY md5('42:' || doc_id), doc_id) AS r FROM q)
  SELECT doc_id, lang FROM t WHERE first OR r <= target - got""")
def sample_uniform(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return S.sample_uniform(docs, "lang", "doc_id", "n_chars", _targets(docs, 203)).select("doc_id", "lang")


def _stage(i: int, cap: int) -> str:
    before = " UNION ALL ".join(f"SELECT source, doc_id FROM s{j}" for j in range(1, i)) or "SELECT NULL AS source, NULL AS doc_id WHERE false"
    return f"""
s{i} AS (
  SELECT doc_id, lang, source FROM (
    SELECT d.*, target, n, r, coalesce(c.k, 0) AS k, row_number() OVER (ORDER BY CASE WHEN n > target AND coalesce(c.k, 0) + r > {cap} THEN 1 ELSE 0 END, r, coalesce(c.k, 0), md5('42:' || d.source || ':' || r), d.source) AS place
    FROM (SELECT doc_id, lang, source, target, n, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents JOIN ordered USING (lang) WHERE o = {i}) d
    LEFT JOIN (SELECT source, count(*) AS k FROM ({before}) GROUP BY 1) c ON c.source = d.source)
  WHERE n <= target OR (k + r <= {cap} AND place <= target)
)"""


@query(f"""WITH {_TARGETS.format(total=240).strip()}, ordered AS (SELECT *, row_number() OVER (ORDER BY n, lang) AS o FROM targets), {", ".join(_stage(i, 9) for i in range(1, 5))}
  SELECT doc_id, lang, source FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4""")
def sample_balanced(spark, sf_dir):
    """Problems are sources, at most 9 rows each; four languages give four stages."""
    docs = _docs(spark, sf_dir)
    return S.sample_balanced(docs, "lang", "source", "doc_id", _targets(docs, 240), cap=9).select("doc_id", "lang", "source")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def shuffled_head(spark, sf_dir):
    return S.shuffled(_docs(spark, sf_dir), "doc_id").select("doc_id").limit(100)


# -- dedup ------------------------------------------------------------------

_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '//[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '#[^\\n]*', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n\\s*\\n', chr(10), 'g'), E' \\t\\n\\r\\x0b\\f')"
_COMPONENTS = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, source, n_chars, {_NORM} AS norm FROM documents),
t AS (SELECT doc_id, lang, source, n_chars, md5(norm) AS h, list_distinct(regexp_extract_all(norm, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS s FROM d),
reps AS (SELECT min(doc_id) AS doc_id, lang, source, h, any_value(s) AS s FROM t GROUP BY lang, source, h),
near AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM reps a JOIN reps b ON a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id AND least(len(a.s), len(b.s)) >= greatest(len(a.s), len(b.s)) * 0.9 - 1e-9
  WHERE CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END >= 0.9
),
edges AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT t.doc_id, r.doc_id FROM t JOIN reps r USING (lang, source, h) UNION SELECT r.doc_id, t.doc_id FROM t JOIN reps r USING (lang, source, h)),
walk(x, y) AS (SELECT doc_id, doc_id FROM t UNION SELECT x, b FROM walk JOIN edges ON y = a),
comp AS (SELECT x AS doc_id, min(y) AS component FROM walk GROUP BY x)"""


def _marked(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return D.deduplicate(docs, ["lang", "source"], "doc_id", ["text"], "n_chars", threshold=0.9)


@query(_COMPONENTS + " SELECT doc_id, component FROM comp")
def near_dup_components(spark, sf_dir):
    return D.duplicate_components(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id", ["text"], 0.9)


@query(_COMPONENTS + """ SELECT doc_id, component, count(*) OVER (PARTITION BY component) AS component_size, row_number() OVER (PARTITION BY component ORDER BY n_chars DESC, doc_id) = 1 AS kept FROM comp JOIN t USING (doc_id)""")
def dedup_keep(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", "component", "component_size", "kept")


@query(_COMPONENTS + """, m AS (SELECT lang, source, component, count(*) OVER (PARTITION BY component) AS n, row_number() OVER (PARTITION BY component ORDER BY n_chars DESC, doc_id) = 1 AS kept FROM comp JOIN t USING (doc_id))
  SELECT lang, source, count(*) AS n_rows, count(*) FILTER (kept) AS n_kept, count(*) FILTER (kept AND n > 1) AS n_duplicate_sets, count(*) FILTER (NOT kept) AS n_removed FROM m GROUP BY 1, 2""")
def dedup_stats(spark, sf_dir):
    return D.dedup_stats(_marked(spark, sf_dir), ["lang", "source"])


@query(f"WITH d AS (SELECT doc_id, source, md5({_NORM}) AS h FROM documents), k AS (SELECT DISTINCT h FROM d WHERE source = 'src0') SELECT doc_id FROM d ANTI JOIN k USING (h)")
def drop_known(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return D.drop_known(docs, docs.filter("source = 'src0'"), "text", "text").select("doc_id")


@query()
def replenish(spark, sf_dir):
    """A deduplicated sample of 120 documents is filled up to 160."""
    docs = table(spark, sf_dir, "documents").withColumn("tgt", F.col("text"))
    kept = S.sample_natural(docs, "lang", "doc_id", _targets(docs, 120))
    return R.replenish(kept, docs.filter("source = 'src3'"), docs, 160, "lang", "source", "doc_id", "text", "tgt", True, 10).select("doc_id", "lang", "source")


# -- distributions ----------------------------------------------------------


@query("SELECT lang, n_chars, round(row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) / count(*) OVER (PARTITION BY lang), 9) AS cdf FROM documents")
def cdf(spark, sf_dir):
    return A.empirical_cdf(table(spark, sf_dir, "documents"), "lang", "n_chars", ["doc_id"]).withColumn("cdf", F.round("cdf", 9))


@query("""SELECT lang, count(*) AS problems, round(avg(n), 6) AS mean_rows, round(stddev_pop(n), 6) AS std_rows, max(n) AS most_rows FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1""")
def problem_counts(spark, sf_dir):
    return A.problem_counts(table(spark, sf_dir, "documents"), "source", ["lang"])


@query("""WITH x AS (SELECT log2(n_chars) AS v FROM documents WHERE n_chars > 0), e AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
  SELECT CASE WHEN hi <= lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 50)), 49) END::INTEGER AS bucket, count(*) AS n FROM x, e GROUP BY 1""")
def log_histogram(spark, sf_dir):
    return A.log_histogram(table(spark, sf_dir, "documents").filter("n_chars > 0"), "n_chars")


@query("""WITH t AS (SELECT doc_id, quality FROM labels) SELECT d.doc_id FROM documents d SEMI JOIN t ON d.doc_id = t.doc_id AND t.quality = 1""")
def semi_valid(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id")


# -- operators beside the main line ------------------------------------------


@query("""SELECT coalesce(CASE WHEN doc_id % 2 = 0 THEN 'p' || doc_id END, 'sampled_' || row_number() OVER (ORDER BY doc_id)) AS pair_id, coalesce(source, 'unknown') AS problem_id, coalesce(lang, 'unknown') AS language,
  round(coalesce(n_chars, 0), 6)::DOUBLE AS slow_time, 0.0::DOUBLE AS fast_time, 'sampled' AS source FROM documents QUALIFY coalesce(text, '') <> ''""")
def convert_sampled(spark, sf_dir):
    """Pairs that are there already; a time of 0 is no reason to go."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("p"), F.col("doc_id").cast("string")))
    raw = docs.select(F.col("doc_id").alias("_ord"), name.alias("pair_id"), F.col("source").alias("problem_id"), F.col("lang").alias("language"), F.col("text").alias("slow_code"), F.col("text").alias("fast_code"),
                      F.col("n_chars").cast("double").alias("slow_time"), F.lit(0.0).alias("fast_time"), F.lit(None).cast("double").alias("speedup"))
    return P.convert(raw).select("pair_id", "problem_id", "language", "slow_time", "fast_time", "source")


@query(f"""WITH {_PAIRS.strip()} SELECT 'java_' || row_number() OVER (ORDER BY l_orderkey, fast_rn, slow_rn) AS pair_id, l_orderkey::VARCHAR AS problem_id, round(slow_time, 6) AS slow_time, round(fast_time, 6) AS fast_time FROM pairs""")
def convert_solutions(spark, sf_dir):
    """Measured solutions, told by their columns, to numbered pairs."""
    order = F.struct(*ORDER)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("_key"), F.col("l_orderkey").cast("string").alias("problem_id"), F.lit("success").alias("status"), F.col("l_extendedprice").alias("avg_time_ns"),
                                                   F.lit("c").alias("code"), F.lit("s").alias("solution_id"), order.alias("_ord"))
    pairs = P.form_pairs(rows, "_key", "avg_time_ns", ["_ord"], ["problem_id"])
    numbered = P.number_rows(pairs, ["_key", "fast_rn", "slow_rn"])
    return numbered.select(F.concat(F.lit("java_"), F.col("_no").cast("string")).alias("pair_id"), F.col("fast_problem_id").alias("problem_id"), F.round("slow_time", 6).alias("slow_time"), F.round("fast_time", 6).alias("fast_time"))


@query("SELECT l.lang AS label, coalesce(a.n, 0) AS sampled, coalesce(b.n, 0) AS final FROM (SELECT lang FROM documents UNION SELECT role FROM conversations) l LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) a USING (lang) LEFT JOIN (SELECT role AS lang, count(*) AS n FROM conversations GROUP BY 1) b USING (lang)")
def bins_of_two(spark, sf_dir):
    """Labels of either frame."""
    docs, turns = table(spark, sf_dir, "documents").select(F.col("lang").alias("label")), table(spark, sf_dir, "conversations").select(F.col("role").alias("label"))
    return S.bins_of_two(docs, turns, "label")


@query(f"WITH {_TARGETS.format(total=203).strip()} SELECT (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS bin, lang AS label, target, n AS original, target AS sampled FROM targets")
def bin_report(spark, sf_dir):
    """Rows by bin before and after sampling beside the targets."""
    docs = _docs(spark, sf_dir)
    names = sorted(S.bin_sizes(docs, "lang"))
    index = F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int") - 1
    docs = docs.withColumn("bin", index)
    targets = S.bin_targets(S.bin_sizes(docs, "bin"), 203)
    return S.bin_report(docs, S.sample_natural(docs, "bin", "doc_id", targets), "bin", targets, names)


@query(f"SELECT doc_id, round(({_U.replace('42:', '42:jitter:')} * 2 - 1) * 0.35, 12) AS jitter FROM documents")
def jitter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.jitter(F.col("doc_id")), 12).alias("jitter"))


@query(_COMPONENTS + """, m AS (SELECT lang, source, row_number() OVER (PARTITION BY component ORDER BY n_chars DESC, doc_id) = 1 AS kept FROM comp JOIN t USING (doc_id))
  SELECT lang, source, count(*) AS original_count, count(*) FILTER (kept) AS kept_count FROM m GROUP BY 1, 2 HAVING count(*) FILTER (NOT kept) > 0""")
def duplicate_details(spark, sf_dir):
    """Every group that lost rows."""
    return D.duplicate_details(_marked(spark, sf_dir), ["lang", "source"], None)


@query(f"""WITH g AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_quantity / 10 END AS given, l_extendedprice AS slow, CASE l_linenumber WHEN 2 THEN 0 ELSE l_quantity * 100 END AS fast FROM lineitem),
  s AS (SELECT l_orderkey, l_linenumber, coalesce(given, CASE WHEN fast > 0 THEN slow / fast END, 1.0) AS speedup FROM g)
  SELECT l_orderkey, l_linenumber, CASE {_BIN} {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(B.labels(B.SAMPLING_BINS)))} END AS bin FROM s""")
def refill_bins(spark, sf_dir):
    """Candidates of the older form get their bin from their run times, 1 where there is none."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.col("l_quantity") / 10).alias("speedup"), F.col("l_extendedprice").alias("src_agg_runtime"), F.when(F.col("l_linenumber") == 2, 0.0).otherwise(F.col("l_quantity") * 100).alias("tgt_agg_runtime"))
    return R.with_bin(rows, B.SAMPLING_BINS).select("l_orderkey", "l_linenumber", "bin")


@query()
def refilled(spark, sf_dir):
    """The deduplicated sample together with what fills it up."""
    docs = table(spark, sf_dir, "documents").withColumn("tgt", F.col("text"))
    kept = S.sample_natural(docs, "lang", "doc_id", _targets(docs, 120))
    return R.refilled(kept, docs.filter("source = 'src3'"), docs, 160, "lang", "source", "doc_id", "text", "tgt", balanced=False).select("doc_id", "lang", "source", "refilled")
