"""Queries on model answers: conversations stand for responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pacekeeper.functions import parse as P
from pacekeeper.functions.bins import difficulty
from pacekeeper.operators import analyze as A, evaluate as E, prompts as M
from pacekeeper.plans.registry import query, table

#: Case number -> tail of a response, and what each parser must find in it.
_TAILS = ["\n**Answer: A**", "\nAnswer: b", "\n答案：B", "\nA.", "\nAnswer: C", "\nAnswer: Both", "\nAnswer: A\nbye 7", "\n差不多 Similar", "\nAnswer: Similar"]
_ANSWERS = ["A", "B", "B", "A", "PARSE_FAILED", "B", "PARSE_FAILED", "PARSE_FAILED", "SIMILAR"]
_FORMATS = ["\nFASTER 2.50", "\nslower -1.5", "\n2.0 FASTER", "\nSLOWER than FASTER 3", "\ntext SLOWER\nFASTER", "\nFASTER 3\nbye", "\nno label 7", "\nFASTER 1 SLOWER 22 x 4"]
_DIRECTIONS = ["FASTER", "SLOWER", "FASTER", "FASTER", "FASTER", "FASTER", None, "FASTER"]
_VALUES = [2.5, -1.5, 2.0, 3.0, None, None, None, 1.0]


def _case(values: list, key: str, kind: str) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + f" END::{kind}"


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _pick(values: list, n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


@query(f"SELECT conv_id, turn, {_case(_ANSWERS, f'(conv_id + turn) % {len(_ANSWERS)}', 'VARCHAR')} AS answer FROM conversations")
def answer_parse(spark, sf_dir):
    body = F.concat(F.coalesce("text", F.lit("")), _pick(_TAILS, F.col("conv_id") + F.col("turn")))
    return _turns(spark, sf_dir).select("conv_id", "turn", P.answer(body).alias("answer"))


@query(f"SELECT conv_id, turn, {_case(_DIRECTIONS, f'(conv_id + turn) % {len(_FORMATS)}', 'VARCHAR')} AS direction, {_case(_VALUES, f'(conv_id + turn) % {len(_FORMATS)}', 'DOUBLE')} AS value FROM conversations")
def format_parse(spark, sf_dir):
    body = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "(?i)faster|slower", ""), _pick(_FORMATS, F.col("conv_id") + F.col("turn")))
    return _turns(spark, sf_dir).select("conv_id", "turn", P.format_late(body).alias("p")).select("conv_id", "turn", "p.direction", "p.value")


@query(f"""SELECT conv_id, turn, {_case(_DIRECTIONS[:2] + [None] * 0 + ["FASTER"], "(conv_id + turn) % 3", "VARCHAR")} AS direction, {_case([2.5, -1.5, 7.0], "(conv_id + turn) % 3", "DOUBLE")} AS value FROM conversations""")
def format_parse_early(spark, sf_dir):
    heads = _pick(["FASTER 2.50 and 9\n", "slower: at -1.5\n", "so\nit is FASTER by 7\n"], F.col("conv_id") + F.col("turn"))
    body = F.concat(heads, F.regexp_replace(F.coalesce("text", F.lit("")), "(?i)faster|slower", ""))
    return _turns(spark, sf_dir).select("conv_id", "turn", P.format_early(body).alias("p")).select("conv_id", "turn", "p.direction", "p.value")


_LAST = "upper(trim(list_last(string_split(b, chr(10))), E' \\t\\n\\r'))"
_FIRST = "upper(trim(string_split(b, chr(10))[1], E' \\t\\n\\r'))"


def _letter_sql(line: str, whole: str, rev: bool) -> str:
    one = lambda s: (lambda a, b: f"CASE WHEN {a} > 0 AND ({b} = 0 OR {a} < {b}) THEN 'A' WHEN {b} > 0 THEN 'B' END")(*[f"strpos({f'reverse({s})' if rev else s}, '{c}')" for c in "AB"])
    return f"coalesce({one(line)}, {one(whole)})"


@query(f"""WITH t AS (SELECT conv_id, turn, trim(coalesce(text, ''), E' \\t\\n\\r') AS b FROM conversations) SELECT conv_id, turn, {_letter_sql(_LAST, "upper(b)", True)} AS late, {_letter_sql(_FIRST, "upper(b)", False)} AS early FROM t""")
def letter_parse(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", P.letter_late("text").alias("late"), P.letter_early("text").alias("early"))


_PRED = """pred AS (SELECT conv_id, turn, conv_id * 100 + turn AS o, turn % 2 = 0 AS fwd, (conv_id * 3 + turn * 5) % 7 > 2 AS correct, (conv_id % 90) / 10.0 + 1 AS speedup, conv_id % 4 AS f,
  CASE WHEN turn % 3 = 0 THEN NULL ELSE turn + conv_id % 5 END AS pv, conv_id % 7 + 1 AS ev FROM conversations),
lev AS (SELECT *, CASE WHEN speedup >= 8 THEN 'easy' WHEN speedup >= 4 THEN 'medium' ELSE 'hard' END AS difficulty FROM pred),
base AS (SELECT f, conv_id, arg_max(correct, o) FILTER (fwd) AS fc, arg_max(correct, o) FILTER (NOT fwd) AS rc, arg_min(difficulty, o) AS difficulty FROM lev GROUP BY 1, 2 HAVING bool_or(fwd) AND bool_or(NOT fwd))"""


def _predictions(spark, sf_dir) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    d = F.when(t % 2 == 0, "forward").otherwise("reversed")
    sp = (c % 90) / 10.0 + 1
    return _turns(spark, sf_dir).select(
        F.concat(F.lit("f"), (c % 4).cast("string")).alias("file"), (c * 100 + t).alias("_ord"), F.concat(c.cast("string"), F.lit("_"), d).alias("pair_id"), c.alias("problem_id"), d.alias("direction"),
        ((c * 3 + t * 5) % 7 > 2).alias("correct"), sp.alias("speedup"), difficulty(sp).alias("difficulty"), F.when(t % 3 != 0, (t + c % 5).cast("double")).alias("predicted_value"), (c % 7 + 1).cast("double").alias("expected_value"),
    )


@query(f"WITH {_PRED} SELECT 'f' || f AS file, difficulty, count(*) AS total, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) * 100.0::DOUBLE / count(*), 4) AS accuracy FROM lev GROUP BY 1, 2")
def accuracy_by_difficulty(spark, sf_dir):
    return A.accuracy(_predictions(spark, sf_dir), ["file", "difficulty"])


_OUT = """count(*) AS pairs, count(*) FILTER (fc AND rc) AS both_correct, count(*) FILTER (NOT fc AND NOT rc) AS both_wrong, count(*) FILTER (fc <> rc) AS bias,
  round(count(*) FILTER (fc AND rc) * 100.0::DOUBLE / count(*), 4) AS both_correct_rate, round(count(*) FILTER (NOT fc AND NOT rc) * 100.0::DOUBLE / count(*), 4) AS both_wrong_rate, round(count(*) FILTER (fc <> rc) * 100.0::DOUBLE / count(*), 4) AS bias_rate FROM base"""


@query(f"WITH {_PRED} SELECT 'f' || f AS file, {_OUT} GROUP BY 1")
def pair_outcomes(spark, sf_dir):
    return A.pair_outcomes(_predictions(spark, sf_dir), ["file"])


@query(f"WITH {_PRED} SELECT 'f' || f AS file, difficulty, {_OUT} GROUP BY 1, 2")
def pair_outcomes_by_difficulty(spark, sf_dir):
    return A.pair_outcomes(_predictions(spark, sf_dir), ["file", "difficulty"])


@query(f"WITH {_PRED} SELECT 'f' || f AS file, count(pv) AS n, round(avg(abs(pv - ev)), 6) AS mae, round(sqrt(avg((pv - ev) * (pv - ev))), 6) AS rmse FROM pred GROUP BY 1")
def value_errors(spark, sf_dir):
    return A.value_errors(_predictions(spark, sf_dir), ["file"])


@query(f"WITH {_PRED} SELECT count(*) AS samples, count(DISTINCT conv_id) AS problems, count(*) FILTER (fwd) AS forward, count(*) FILTER (NOT fwd) AS reversed FROM pred")
def direction_counts(spark, sf_dir):
    return A.direction_counts(_predictions(spark, sf_dir))


@query(f"""WITH {_PRED}, acc AS (SELECT f, difficulty, count(*) AS total, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) * 100.0::DOUBLE / count(*), 4) AS accuracy FROM lev GROUP BY 1, 2),
  po AS (SELECT f, difficulty, {_OUT} GROUP BY 1, 2), whole AS (SELECT f, {_OUT} GROUP BY 1),
  m AS (SELECT f, '{{' || string_agg('"' || difficulty || '":{{"total":' || total || ',"correct":' || correct || ',"accuracy":' || accuracy || ',"pairs":' || coalesce(pairs, 0) || ',"both_correct":' || coalesce(both_correct, 0) || ',"both_wrong":' || coalesce(both_wrong, 0) || '}}', ',' ORDER BY difficulty) || '}}' AS by_difficulty
    FROM acc LEFT JOIN po USING (f, difficulty) GROUP BY 1),
  e AS (SELECT f, count(*) AS total, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) * 100.0::DOUBLE / count(*), 4) AS accuracy, count(pv) AS n, round(avg(abs(pv - ev)), 6) AS mae, round(sqrt(avg((pv - ev) * (pv - ev))), 6) AS rmse FROM pred GROUP BY 1)
  SELECT 'f' || f AS file, e.* EXCLUDE (f), whole.* EXCLUDE (f), by_difficulty FROM e LEFT JOIN whole USING (f) JOIN m USING (f)""")
def analysis_report(spark, sf_dir):
    out = A.report(_predictions(spark, sf_dir))
    return out.withColumn("by_difficulty", F.to_json("by_difficulty"))


# -- position-swap evaluation ------------------------------------------------

_JUDGED = f"""
r AS (SELECT doc_id, {_case(_ANSWERS, f"doc_id % {len(_ANSWERS)}", "VARCHAR")} AS p1, {_case(_ANSWERS, f"(doc_id // 9) % {len(_ANSWERS)}", "VARCHAR")} AS p2, lang,
  CASE WHEN n_chars >= 8000 THEN 'easy [≥8.0x]' WHEN n_chars >= 4000 THEN 'medium [4.0x-8.0x)' WHEN n_chars >= 2000 THEN 'hard [2.0x-4.0x)' WHEN n_chars >= 1000 THEN 'below_threshold' ELSE '' END AS bin, n_chars FROM documents),
e AS (SELECT *, CASE WHEN p1 = 'PARSE_FAILED' THEN 'test1_answer_parse_failed' WHEN p1 NOT IN ('A', 'B') THEN 'test1_error' WHEN p2 = 'PARSE_FAILED' THEN 'test2_answer_parse_failed' WHEN p2 NOT IN ('A', 'B') THEN 'test2_error' END AS err FROM r),
j AS (SELECT *, CASE WHEN err IS NULL THEN (p1 = 'B') = (p2 = 'A') END AS steady, CASE WHEN err IS NOT NULL THEN NULL WHEN p1 = 'B' AND p2 = 'A' THEN 'both_correct' WHEN p1 <> 'B' AND p2 <> 'A' THEN 'both_wrong' ELSE 'position_bias' END AS category,
  n_chars + CASE WHEN p1 IN ('A', 'B') THEN n_chars ELSE 0 END AS tokens FROM e)"""


def _judged(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    items = docs.select(F.col("doc_id").alias("pair_id"), F.col("lang").alias("dataset_type"), (F.col("n_chars") / 1000).alias("speedup"))
    body = lambda n: F.concat(F.lit("reason"), _pick(_TAILS, n))
    orders = F.array(*[F.struct(F.lit(i).alias("test_no"), body(n).alias("response")) for i, n in ((1, F.col("doc_id")), (2, F.floor(F.col("doc_id") / 9)))])
    said = docs.select(F.col("doc_id").alias("pair_id"), F.explode(orders).alias("t"), F.col("n_chars").alias("prompt_tokens"), F.lit(10).cast("long").alias("completion_tokens")).select("pair_id", "t.*", "prompt_tokens", "completion_tokens")
    return E.with_evaluation_bin(E.judge_pairs(items, said))


@query(f"WITH {_JUDGED.strip()} SELECT doc_id AS pair_id, p1 AS test1_prediction, category, steady AS is_consistent, err AS error, tokens AS prompt_tokens FROM j")
def judge_pairs(spark, sf_dir):
    error = F.regexp_replace("error", r"(?s)_error: .*", "_error")
    return _judged(spark, sf_dir).select("pair_id", "test1_prediction", "category", "is_consistent", error.alias("error"), "prompt_tokens")


_STATS = """count(*) AS total, count(*) FILTER (err IS NULL) AS success, count(err) AS errors, count(*) FILTER (err LIKE '%parse_failed%') AS parse_errors, count(*) FILTER (category = 'both_correct') AS correct,
  count(*) FILTER (steady) AS consistent, count(*) FILTER (NOT steady) AS inconsistent, count(*) FILTER (category = 'both_wrong') AS both_wrong, count(*) FILTER (category = 'position_bias') AS position_bias, 0::BIGINT AS all_wrong, 0::BIGINT AS consistent_partial"""
_RATES = """round(coalesce(correct * 100.0::DOUBLE / nullif(CASE WHEN level = 'overall' THEN success ELSE total END, 0), 0), 2) AS accuracy, round(coalesce(consistent * 100.0::DOUBLE / nullif(success, 0), 0), 2) AS consistency_rate"""


@query(f"""WITH {_JUDGED.strip()}, s AS (SELECT 'overall' AS level, 'all' AS name, {_STATS} FROM j UNION ALL SELECT 'dataset', lang, {_STATS} FROM j GROUP BY lang UNION ALL SELECT 'bin', bin, {_STATS} FROM j WHERE bin <> '' GROUP BY bin)
  SELECT *, {_RATES} FROM s""")
def eval_report(spark, sf_dir):
    return E.evaluation_stats(_judged(spark, sf_dir))


@query("""WITH p AS (SELECT doc_id, ['A', 'B', 'C', 'A'][doc_id % 4 + 1] AS a, ['A', 'B', 'C', 'B', 'B'][doc_id % 5 + 1] AS b, ['C', 'C', 'A'][doc_id % 3 + 1] AS c FROM documents),
  n AS (SELECT doc_id, a, b, c, (a = 'A')::INTEGER + (b = 'B')::INTEGER + (c = 'C')::INTEGER AS k, (a = 'A') = (b = 'B') AND (b = 'B') = (c = 'C') AS steady FROM p)
  SELECT CASE WHEN k = 3 THEN 'all_correct' WHEN k = 0 THEN 'all_wrong' WHEN steady THEN 'consistent_partial' ELSE 'position_bias' END AS category, count(*) AS n, sum(k)::BIGINT AS letters FROM n GROUP BY 1""")
def judge_triples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"))
    says = [_pick(v, F.col("pair_id")) for v in (["A", "B", "C", "A"], ["A", "B", "C", "B", "B"], ["C", "C", "A"])]
    said = docs.select("pair_id", F.explode(F.array(*[F.struct(F.lit(i).alias("test_no"), F.concat(F.lit("**Answer: "), s, F.lit("**")).alias("response")) for i, s in enumerate(says, 1)])).alias("t")).select("pair_id", "t.*")
    return E.judge_triples(docs, said).groupBy("category").agg(F.count("*").alias("n"), F.sum("num_correct").alias("letters"))


_PRICES = ", ".join(f"({i}, '{n}', {a}::DOUBLE, {b}::DOUBLE)" for i, (n, a, b) in enumerate(E.PRICES))
_MODELS = ["GPT-4o-mini-2024", "x/deepseek-v3.2", "qwen3-coder-30b", "unknown-model", "claude-sonnet-4-5"]


@query(f"""WITH prices(o, name, i, u) AS (VALUES {_PRICES}), m AS (SELECT conv_id, turn, strlen(text) AS pt, turn + 1 AS ct, {_case(_MODELS, "conv_id % 5", "VARCHAR")} AS model FROM conversations),
  b AS (SELECT model, arg_min(i, o) AS i, arg_min(u, o) AS u FROM (SELECT DISTINCT model FROM m) JOIN prices ON contains(lower(model), name) GROUP BY 1)
  SELECT model, count(*) AS n, sum(pt)::BIGINT AS prompt_tokens, round(sum(pt / 1000000 * coalesce(i, 5) + ct / 1000000 * coalesce(u, 15)), 6) AS usd FROM m LEFT JOIN b USING (model) GROUP BY 1""")
def token_cost(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(F.octet_length("text").cast("long").alias("pt"), (F.col("turn") + 1).alias("ct"), _pick(_MODELS, F.col("conv_id")).alias("model"))
    return E.priced(rows).groupBy("model").agg(F.count("*").alias("n"), F.sum("pt").alias("prompt_tokens"), F.round(F.sum(E.cost(F.col("pt"), F.col("ct"))), 6).alias("usd"))


_KINDS = ["custom", "triple", "clean_vs_raw", "same_tier", "cross_tier", "effibench_pair", "unknown"]


@query(f"""SELECT doc_id, {_case(_KINDS, "doc_id % 7", "VARCHAR")} AS kind, {_case(["fast", "fast", "similar", "similar", "fast", "fast", "similar"], "doc_id % 7", "VARCHAR")} AS expected,
  {_case([None, None, "raw", "b", None, "src", None], "doc_id % 7", "VARCHAR")} AS slow_code, {_case([0, 0, 3, 5, 0, 7, 0], "doc_id % 7", "DOUBLE")} AS slow_time FROM documents""")
def dataset_types(spark, sf_dir):
    k = F.col("doc_id") % 7
    on = lambda i, v: F.when(k == i, v)
    has = {
        "scheme": on(0, "custom"), "medium_code": on(1, "m"), "medium_time": F.lit(None).cast("double"), "raw_code": on(2, "raw"), "clean_code": on(2, "clean"), "cpu_time": on(2, 3.0), "tier": on(3, "fast"),
        "code_a": on(3, "a"), "code_b": on(3, "b"), "time_a": on(3, 1.0), "time_b": on(3, 5.0), "pair_type": on(4, "x"), "src_code": on(5, "src"), "tgt_code": on(5, "tgt"), "src_agg_runtime": on(5, "7"), "tgt_agg_runtime": on(5, "x"),
    }
    kind = E.dataset_type(has)
    side = E.sides(kind, has)
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), E.expected_kind(on(6, "Similar"), kind).alias("expected"), side["slow_code"].alias("slow_code"), side["slow_time"].alias("slow_time"))


@query("""SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 50""")
def resume_pending(spark, sf_dir):
    done = table(spark, sf_dir, "labels").withColumn("error", F.lit(None).cast("string"))
    return E.pending(table(spark, sf_dir, "documents").select("doc_id"), done, "doc_id", "doc_id", 50)


@query("SELECT doc_id FROM documents ORDER BY doc_id OFFSET 20 LIMIT 30")
def skip_limit(spark, sf_dir):
    from pacekeeper.sources.jsonl import window_of_rows

    return window_of_rows(table(spark, sf_dir, "documents").select("doc_id"), 20, 30, "doc_id")


_FENCE = chr(96) * 3


@query(f"""WITH q AS (SELECT item_id, text AS slow, 'x = ' || item_id AS fast FROM benchmark), t AS (SELECT item_id, 1 AS test_no, slow AS a, fast AS b FROM q UNION ALL SELECT item_id, 2, fast, slow FROM q)
  SELECT item_id, test_no, md5('Which of these Python programs runs faster on large inputs?' || chr(10) || chr(10) || 'Program A:' || chr(10) || '{_FENCE}python' || chr(10) || a || chr(10) || '{_FENCE}' || chr(10) || chr(10)
    || 'Program B:' || chr(10) || '{_FENCE}python' || chr(10) || b || chr(10) || '{_FENCE}' || chr(10) || chr(10) || 'End with one last line of exactly this form: **Answer: A or B**') AS user_md5, 2 AS n_messages FROM t""")
def prompts(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("slow_code"), F.concat(F.lit("x = "), F.col("item_id").cast("string")).alias("fast_code"), F.lit("py").alias("language"))
    tests = M.swapped_tests(items, "item_id")
    return tests.select("item_id", "test_no", F.md5(F.element_at("messages", -1)["content"]).alias("user_md5"), F.size("messages").alias("n_messages"))


@query("""SELECT item_id, md5('<|im_start|>user' || chr(10) || 'Compare.' || CASE WHEN coalesce(text, '') = '' THEN '' ELSE chr(10) || chr(10) || text END || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || 'FASTER 2.00' || '<|im_end|>') AS chat FROM benchmark""")
def chat_format(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(M.chat_text(F.lit("Compare."), F.col("text"), F.lit("FASTER 2.00"))).alias("chat"))


_HEADS = ["FASTER 2.50 and 9", "slower: at -1.5", "B"]


@query(f"""WITH r AS (SELECT doc_id, doc_id % 4 IN (0, 1) AS small, doc_id % 4 IN (1, 3) AS zero, {_case(["FASTER", "SLOWER", None], "doc_id % 3", "VARCHAR")} AS d, {_case([2.5, -1.5, None], "doc_id % 3", "DOUBLE")} AS v, {_case(["A", "A", "B"], "doc_id % 3", "VARCHAR")} AS l FROM documents)
  SELECT doc_id, CASE WHEN small AND NOT zero THEN d ELSE 'SLOWER' END AS predicted_direction, CASE WHEN small AND NOT zero THEN v ELSE 1.0 END AS predicted_value, CASE WHEN small AND zero THEN l ELSE 'A' END AS predicted,
    CASE WHEN small AND zero THEN l = 'B' WHEN small THEN coalesce(d = 'FASTER', false) ELSE true END AS correct FROM r""")
def repair(spark, sf_dir):
    """Answers in files of the small model are parsed anew, as letters or directions by the file's name."""
    names = F.element_at(F.array(*map(F.lit, ("x_7b.jsonl", "zeroshot_7B.jsonl", "large.jsonl", "zeroshot_large.jsonl"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", names.alias("file"), _pick(_HEADS, F.col("doc_id")).alias("response"), F.lit("SLOWER").alias("predicted_direction"), F.lit(1.0).alias("predicted_value"), F.lit("A").alias("predicted"),
        F.lit("FASTER").alias("expected_direction"), F.lit("B").alias("expected"), F.lit(True).alias("correct"),
    )
    return A.repair(rows).select("doc_id", "predicted_direction", "predicted_value", "predicted", "correct")


def _program(letter: str, code: str) -> str:
    return f"'Program {letter}:' || chr(10) || '{_FENCE}python' || chr(10) || {code} || chr(10) || '{_FENCE}' || chr(10) || chr(10)"


@query(f"""WITH q AS (SELECT item_id, text AS s, 'x = ' || item_id AS f, 'y' AS m FROM benchmark), t AS (SELECT item_id, 1 AS test_no, f AS a, m AS b, s AS c FROM q UNION ALL SELECT item_id, 2, s, f, m FROM q UNION ALL SELECT item_id, 3, m, s, f FROM q)
  SELECT item_id, test_no, md5('Which of these Python programs runs faster on large inputs?' || chr(10) || chr(10) || {_program("A", "a")} || {_program("B", "b")} || {_program("C", "c")} || 'End with one last line of exactly this form: **Answer: A, B or C**') AS user_md5 FROM t""")
def triple_prompts(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("slow_code"), F.concat(F.lit("x = "), F.col("item_id").cast("string")).alias("fast_code"), F.lit("y").alias("medium_code"), F.lit("py").alias("language"))
    return M.rotated_tests(items, "item_id").select("item_id", "test_no", F.md5(F.element_at("messages", -1)["content"]).alias("user_md5"))


@query(f"""SELECT item_id, 'You judge the speed of Python programs.' AS system, md5('These Python programs do the same.' || chr(10) || chr(10) || {_program("A", "text")} || {_program("B", "'x'")} || 'Reply with one letter and nothing else, A or B: the program that is faster.') AS user_md5 FROM benchmark""")
def local_prompts(spark, sf_dir):
    m = M.local_messages(F.col("text"), F.lit("x"), F.lit("python"))
    return table(spark, sf_dir, "benchmark").select("item_id", m.alias("m")).select("item_id", F.col("m")[0]["content"].alias("system"), F.md5(F.col("m")[1]["content"]).alias("user_md5"))
