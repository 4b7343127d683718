"""Operators against plain simulations."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pacekeeper.operators import analyze as A, dedup as D, evaluate as E, execute as X, graph as G, measure as M, pairs as P, prompts as Q, replenish as R, sampling as S, sanitize as Z, select as J


# -- pairs ------------------------------------------------------------------


def test_ties_are_pairs_and_failures_are_not(spark):
    rows = [(0, "p", "s0", "a", 2.0, "success"), (1, "p", "s1", "b", 2.0, "success"), (2, "p", "s2", "c", 9.0, "compile_failed"), (3, "q", "s3", "d", 1.0, "success"), (4, "p", "s4", "e", 0.0, "success")]
    df = spark.createDataFrame(rows, "_ord long, problem_id string, solution_id string, code string, avg_time_ns double, status string")
    (r,) = P.convert(df).collect()
    assert (r.pair_id, r.slow_submission_id, r.fast_submission_id, r.speedup, r.source) == ("java_1", "s1", "s0", 1.0, "java_benchmark")


def test_records_of_one_problem_do_not_mix(spark):
    ddl = "_ord long, problem_id string, results array<struct<solution_idx:int,code:string,status:string,avg_cpu_instruction:bigint>>"
    df = spark.createDataFrame([(0, "p", [(0, "a", "success", 10), (1, "b", "success", 30)]), (1, "p", [(0, "c", "success", 20)]), (2, "p", [])], ddl)
    (r,) = P.convert(df).collect()
    assert (r.slow_submission_id, r.fast_submission_id, r.speedup, r.language) == ("sol_1", "sol_0", 3.0, "python")


def test_rejected_rows_are_numbered(spark):
    ddl = "_ord long, problem_id string, src_code string, tgt_code string, src_agg_runtime double, tgt_agg_runtime double, speedup double, src_id string, tgt_id string"
    df = spark.createDataFrame([(0, "p", "", "b", 1.0, 1.0, None, None, None), (1, None, "a", "b", 3.0, 2.0, None, "s", ""), (2, "p", "a", "b", 0.0, 1.0, None, None, None)], ddl)
    (r,) = P.convert(df).collect()
    assert (r.pair_id, r.problem_id, r.speedup, r.slow_submission_id, r.fast_submission_id) == ("pie_2", "unknown_2", 1.5, "s", None)


def test_sampled_rows_and_merge(spark):
    ddl = "_ord long, pair_id string, problem_id string, language string, slow_code string, fast_code string, slow_time double, fast_time double, speedup double"
    df = spark.createDataFrame([(0, None, "p", "cpp", "a", "b", 1.0, 0.0, None), (1, "x", "p", "java", "a", "b", 0.0, 0.0, 4.0), (2, "y", "p", "java", None, "b", 1.0, 1.0, 1.0)], ddl)
    got = P.convert(df).orderBy("pair_id").collect()
    assert [(r.pair_id, r.speedup) for r in got] == [("sampled_1", 0.0), ("x", 4.0)]
    assert [r.pair_id for r in P.merge([df, df]).orderBy("_no" if "_no" in df.columns else "pair_id").collect()] == ["cpp_1", "cpp_4", "java_2", "java_3", "java_5", "java_6"]
    with pytest.raises(ValueError):
        P.convert(spark.range(1))


# -- sampling ---------------------------------------------------------------


def items(spark, seed, n=240):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), f"p{rng.randrange(12)}", rng.uniform(1.5, 30)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, b int, p string, v double")


def test_targets():
    assert S.bin_targets({0: 100, 1: 2, 2: 100, 3: 0}, 20) == {0: 7, 1: 2, 2: 6}
    with pytest.raises(ValueError):
        S.bin_targets({0: 0}, 5)


@pytest.mark.parametrize("how", ["natural", "weighted", "uniform"])
def test_samples_meet_targets(spark, how):
    rows, df = items(spark, 1)
    targets = S.bin_targets(S.bin_sizes(df, "b"), 90)
    fn = {"natural": lambda: S.sample_natural(df, "b", "k", targets), "weighted": lambda: S.sample_weighted(df, "b", "k", "v", targets), "uniform": lambda: S.sample_uniform(df, "b", "k", "v", targets)}[how]
    got, again = ([r.k for r in fn().collect()] for _ in range(2))
    assert sorted(got) == sorted(again) and len(set(got)) == len(got)
    assert Counter(rows[k][1] for k in got) == Counter({b: t for b, t in targets.items() if t})


@pytest.mark.parametrize(("how", "cap"), [("natural", None), ("natural", 5), ("uniform", 5), ("normal", 4)])
def test_balanced_sampling_follows_a_pass_by_pass_simulation(spark, how, cap):
    import hashlib

    rows, df = items(spark, 2)
    targets = {0: 40, 1: 20, 2: 500}
    got = S.sample_balanced(df, "b", "p", "k", targets, "v", how, cap, 4).collect()
    counts = Counter(r.p for r in got)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert len({r.k for r in got}) == len(got)
    sizes = Counter(r[1] for r in rows)
    assert Counter(r.b for r in got)[2] == sizes[2]  # taken whole, whatever the cap
    if how == "natural":
        have, want = Counter(), set()
        for b in sorted(targets, key=lambda b: (sizes[b], b)):
            mine = defaultdict(list)
            for k, bb, p, _ in sorted((r for r in rows if r[1] == b), key=lambda r: (md5(f"42:{r[0]}"), r[0])):
                mine[p].append(k)
            taken, start, turn = [], Counter(have), 0
            if sizes[b] <= targets[b]:
                taken = [k for ks in mine.values() for k in ks]
                have.update({p: len(ks) for p, ks in mine.items()})
            while sizes[b] > targets[b] and len(taken) < targets[b]:
                turn += 1
                live = [p for p in mine if len(mine[p]) >= turn and (cap is None or start[p] + turn <= cap)]
                for p in sorted(live, key=lambda p: (start[p], md5(f"42:{p}:{turn}"), p))[: targets[b] - len(taken)]:
                    taken.append(mine[p][turn - 1])
                    have[p] += 1
                if not live:
                    break
            want |= set(taken)
        assert {r.k for r in got} == want
    elif cap:
        whole = Counter(r[2] for r in rows if r[1] == 2)
        assert all(counts[p] <= max(cap, whole[p]) for p in counts)


def test_picks(spark):
    _, df = items(spark, 3)
    assert all(r["count"] == 5 for r in S.pick_per_group(df, "b", "k", 5).groupBy("b").count().collect())
    got = {r.b: r["count"] for r in S.pick_share(df, "b", "k", 0.1, 8).groupBy("b").count().collect()}
    sizes = S.bin_sizes(df, "b")
    assert got == {b: min(max(1, int(n * 0.1)), 8, n) for b, n in sizes.items()}


# -- dedup ------------------------------------------------------------------


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    edges = [(a, b) for a, b in edges if a != b]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    got = {r.node: r.root for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({(find(x), got[x]) for x in up}) == len({find(x) for x in up}) == len(set(got.values()))


@pytest.mark.parametrize(("method", "mode"), [("combined", "both"), ("jaccard", "either"), ("hash", "tgt"), ("edit", "src")])
def test_duplicates_equal_brute_force(spark, method, mode):
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefgh")
    rows = []
    for i in range(40):
        if i < 8 or rng.random() < 0.2:
            src, tgt = " ".join(word() for _ in range(9)), " ".join(word() for _ in range(9))
        else:
            _, _, src, tgt = rows[rng.randrange(len(rows))]
            if rng.random() < 0.6:
                src = src + " # note" if rng.random() < 0.5 else src[:-1] + word()
        rows.append((i, rng.choice("xy"), src, tgt))
    rows += [(40, "x", "", ""), (41, "x", None, "# c")]
    df = spark.createDataFrame(rows, "i long, g string, src string, tgt string")
    pairs = df.alias("l").join(df.alias("r"), (F.col("l.g") == F.col("r.g")) & (F.col("l.i") < F.col("r.i")))
    from pacekeeper.functions import text as T

    sim = T.pair_similarity(T.similarity(F.col("l.src"), F.col("r.src"), method), T.similarity(F.col("l.tgt"), F.col("r.tgt"), method), mode)
    near = [(r.a, r.b) for r in pairs.select(F.col("l.i").alias("a"), F.col("r.i").alias("b"), sim.alias("s")).filter("s >= 0.8").collect()]
    least = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.i: r.component for r in D.duplicate_components(df, ["g"], "i", ["src", "tgt"], 0.8, method, mode).collect()}
    assert got == least


def test_keep_strategies(spark):
    df = spark.createDataFrame([(0, "g", "a b", 1.0), (1, "g", "a b", 5.0), (2, "g", "a b", 5.0), (3, "g", "z", 2.0)], "i long, g string, t string, v double")
    kept = lambda s: sorted(r.i for r in D.deduplicate(df, ["g"], "i", ["t"], "v", s).filter("kept").collect())
    assert kept("max-speedup") == [1, 3] and kept("min-speedup") == [0, 3] and kept("first") == [0, 3] and len(kept("random")) == 2


def test_replenish_fills_the_least(spark):
    rows = [(i, i % 3, f"p{i % 4}", f"code {i // 2}" if i > 20 else f"c{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "k long, b int, p string, src string").withColumn("tgt", F.col("src"))
    kept, removed = df.filter("k < 5"), df.filter("k = 7")
    got = R.replenish(kept, removed, df, 17, "b", "p", "k", "src", "tgt", True, 6).collect()
    assert len(got) == 12 and not {r.k for r in got} & {0, 1, 2, 3, 4, 7} and len({r.src for r in got}) == 12
    total = Counter(r.b for r in got) + Counter(r[1] for r in rows[:5])
    assert max(total.values()) - min(total.values()) <= 1
    assert R.replenish(kept, removed, df, 3, "b", "p", "k", "src", "tgt").count() == 0
    assert 0 < R.replenish(kept, removed, df, 1000, "b", "p", "k", "src", "tgt", False).count() < 55


# -- selection --------------------------------------------------------------


def greedy(passes, least):
    alive = [s for s in sorted(passes) if any(passes[s].values())]
    tests = {t for s in alive for t in passes[s]}
    safe = lambda sols: {t for t in tests if all(passes[s][t] for s in sols)}
    whole = safe(alive)
    if alive and len(whole) >= least:
        return 0, len(whole), len(alive)
    order = sorted(alive, key=lambda s: -(len(safe([x for x in alive if x != s])) - len(whole)) if len(alive) > 1 else 0)
    best = None
    for k in range(len(order)):
        now = safe(order[k:])
        if len(now) >= least and (best is None or len(now) * (len(order) - k) > best[1] * best[2]):
            best = (k, len(now), len(order) - k)
    return best


def test_common_valid_equals_greedy(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for p in range(150):
        n, m, rate = rng.randrange(1, 7), rng.randrange(1, 9), rng.random()
        passes = {s: {t: rng.random() < rate for t in range(m)} for s in range(n)}
        rows += [(p, s, t, ok) for s in passes for t, ok in passes[s].items()]
        if (best := greedy(passes, 2)) is not None:
            want[p] = best
    df = spark.createDataFrame(rows, "problem_id long, sol_idx int, tc_idx int, pass boolean")
    chosen = J.common_valid(df, 2)
    assert {r.problem_id: (r.n_removed, r.n_tests, r.n_solutions) for r in chosen.collect()} == want
    n = Counter(r.problem_id for r in J.common_members(df, chosen).collect())
    assert n == {p: a * b for p, (_, a, b) in want.items()}


# -- measurement ------------------------------------------------------------


def test_java_metrics(spark):
    rows = [("p", "s", 0, i, "measure", float(v), True) for i, v in enumerate((1, 9, 2, 3, 4, 100))] + [("p", "s", 1, 0, "measure", 5.0, True), ("p", "s", 2, 0, "warmup", 1.0, False)]
    rows += [("p", "s", 2, i, "measure", 7.0, True) for i in range(5)] + [("p", "bad", 0, 0, "measure", 1.0, False)]
    df = spark.createDataFrame(rows, "problem_id string, solution_id string, testcase_idx int, run_no int, phase string, value double, ok boolean")
    got = {r.solution_id: r for r in M.java_metrics(df).collect()}
    assert (got["s"].total_time_ns, got["s"].valid_testcases, got["s"].total_testcases, got["s"].status) == (3.5, 1, 3, "success")
    assert (got["bad"].status, got["bad"].avg_time_ns) == ("all_testcases_failed", 0.0)
    assert M.python_metrics(df.filter("phase = 'measure'")).filter("solution_id = 's'").first().num_test_cases == 3


def test_test_cases(spark):
    rows = [("a", '{"inputs": ["1", "2"], "outputs": ["x"]}', '[{"input": "1", "output": "x"}, {"input": "3"}]', '["4"]'), ("b", None, "None", None), ("c", "no json", "[]", '["1", "2", "3"]')]
    df = spark.createDataFrame(rows, "problem_id string, input_output string, test_cases string, base_input string")
    got = {r.problem_id: [(c.input, c.output) for c in r.cases] for r in M.test_cases(df, 3).collect()}
    assert got == {"a": [("1", "x"), ("2", None), ("3", None)], "b": [], "c": [("1", None), ("2", None), ("3", None)]}


# -- evaluation -------------------------------------------------------------


def test_judging_stops_after_a_failed_first_test(spark):
    said = [("a", 1, "Answer: B", 1, 1), ("a", 2, "Answer: A", 1, 1), ("b", 1, "hm", 5, 1), ("b", 2, "Answer: A", 7, 1), ("c", 1, "Answer: A", 1, 1), ("c", 2, "", 1, 1), ("d", 1, "Answer: A", 1, 1), ("d", 2, "Answer: A", 1, 1)]
    df = spark.createDataFrame(said, "pair_id string, test_no int, response string, prompt_tokens long, completion_tokens long")
    got = {r.pair_id: r for r in E.judge_pairs(spark.createDataFrame([(x,) for x in "abcde"], "pair_id string"), df).collect()}
    assert (got["a"].category, got["a"].is_consistent) == ("both_correct", True)
    assert (got["b"].error, got["b"].prompt_tokens, got["b"].test2_prediction) == ("test1_answer_parse_failed", 5, None)
    assert got["c"].error == "test2_error: " and got["d"].category == "position_bias" and not got["d"].is_consistent and got["e"].error == "test1_error: "


def test_prices(spark):
    df = spark.createDataFrame([("GPT-4o-mini",), ("nothing",)], "model string")
    got = {r.model: (r.input_usd, r.output_usd) for r in E.priced(df).collect()}
    assert got == {"GPT-4o-mini": (2.5, 10.0), "nothing": (5.0, 15.0)}
    assert E.priced(df, longest=True).filter("model like 'GPT%'").first().input_usd == 0.15


def test_repair_and_report(spark):
    ddl = "file string, _ord long, pair_id string, direction string, difficulty string, response string, speedup double, expected_direction string, predicted_direction string, expected string, predicted string, expected_value double, predicted_value double, correct boolean"
    rows = [
        ("x_7b.jsonl", 0, "1_forward", "forward", None, "SLOWER 2 FASTER", 9.0, "SLOWER", "FASTER", None, None, 2.0, 9.0, False), ("x_7b.jsonl", 1, "1_reversed", "other", None, None, 9.0, "FASTER", None, None, None, 2.0, None, True),
        ("zeroshot_7b.jsonl", 2, "1", "forward", "hard", "B or A", 1.0, None, None, "B", "A", None, None, False), ("y.jsonl", 3, "1_forward", "forward", "hard", "A", 1.0, None, None, "B", "A", None, None, True),
        ("y.jsonl", 4, "1_reversed", "reversed", "easy", "A", 1.0, None, None, "B", "A", None, None, True), ("y.jsonl", 5, "1_forward", "forward", "hard", "A", 1.0, None, None, "B", "A", None, None, False),
    ]
    fixed = A.repair(spark.createDataFrame(rows, ddl))
    assert [r.correct for r in fixed.orderBy("_ord").collect()] == [True, False, True, True, True, False]
    got = {r.file: r for r in A.report(fixed).collect()}
    assert (got["y.jsonl"].pairs, got["y.jsonl"].bias, got["y.jsonl"].total) == (1, 1, 3)  # the last forward row decides
    assert got["y.jsonl"].by_difficulty["hard"].pairs == 1 and got["y.jsonl"].by_difficulty["easy"].pairs == 0 and got["x_7b.jsonl"].by_difficulty["easy"].total == 2
    assert got["x_7b.jsonl"].mae == 0.0 and got["zeroshot_7b.jsonl"].pairs is None


@pytest.mark.parametrize("kind", Q.KINDS)
def test_prompts(spark, kind):
    df = spark.createDataFrame([("1", "SLOW", "FAST", "MED", "java"), ("2", "SLOW", "FAST", "MED", None)], "pair_id string, slow_code string, fast_code string, medium_code string, language string")
    got = Q.swapped_tests(df, kind=kind).orderBy("pair_id", "test_no").collect()
    last = [r.messages[-1].content for r in got]
    assert last[0].index("SLOW") < last[0].index("FAST") and last[1].index("FAST") < last[1].index("SLOW") and "Java" in last[0] and "C++" in last[2]
    assert len(got[0].messages) == (6 if kind.startswith("few") else 2) and ("step by step" in last[0]) == kind.endswith("cot")
    three = Q.rotated_tests(df, kind=kind).filter("pair_id = '1'").orderBy("test_no").collect()
    assert [sorted("FMS", key=lambda c: r.messages[-1].content.index({"F": "FAST", "M": "MED", "S": "SLOW"}[c])).index("F") for r in three] == [0, 1, 2]
    said = Q.respond(Q.swapped_tests(df, kind=kind), lambda tests: ["**Answer: B**" for _ in tests])
    assert {r.response for r in said.collect()} == {"**Answer: B**"}


# -- sanitizing -------------------------------------------------------------


@pytest.mark.parametrize(("lang", "code", "clean"), [
    ("java", 'a("//x"); // y\n/* z */b', 'a("//x"); \n b'), ("java", 'String t = """\n// in "text" block\n"""; // out', 'String t = """\n// in "text" block\n"""; '), ("cpp", 'auto r = R"x(//)x"; // y', 'auto r = R"x(//)x"; '),
    ("cpp", "char c = '/'; /* a\nb */ int d; '//' // e", "char c = '/'; \n int d; '//' "), ("cpp", "x /* open", "x  "), ("cpp", r'"a\"//b" // c', r'"a\"//b" '), ("java", "", ""),
])
def test_c_comments(spark, lang, code, clean):
    assert spark.createDataFrame([(code,)], "t string").select(Z.strip_c_comments("t", lang)).first()[0] == clean


def test_c_comments_of_long_texts(spark):
    long = '"' + "x" * 200_000 + '" /* ' + "y " * 100_000 + "*/ z"
    assert spark.createDataFrame([(long,)], "t string").select(F.length(Z.strip_c_comments("t", "cpp"))).first()[0] == 200_002 + 4


@pytest.mark.parametrize(("code", "clean", "method"), [
    ('"""doc"""\nx = "#no"  # yes\n', '\nx = "#no"  \n', "python"), ('def f():\n    """only"""\n', "def f():\n    pass\n", "python"), ('d = {"k": """text"""}  # c', 'd = {"k": """text"""}  ', "python"),
    ("x = (1  # c\n", "x = (1  \n", "python_fallback"), ('é = """a""" # ü', 'é = """a""" ', "python"), ("", "", "python"),
])
def test_python_comments(code, clean, method):
    assert Z.clean_python(code) == (clean, method)


def test_sanitized_statuses(spark):
    rows = [("x = 1 # c", "PY"), ("x = (", "python"), ("int a; // Author: me\n@author y", "cc"), ("// a\n#b", "rust"), (None, "java"), ("__author__ = 'x'\ny = 1", "python")]
    got = Z.sanitized(spark.createDataFrame(rows, "code string, language string")).collect()
    assert [(r.cleaned_code, r.sanitize_method, r.syntax_valid) for r in got] == [
        ("x = 1 ", "python", "valid"), ("x = (", "python_fallback", "invalid"), ("int a; \n", "cpp_state_machine", "valid"), ("\n", "basic_unsafe", "skipped"), (None, "java_state_machine", "error"), ("\ny = 1", "python", "valid"),
    ]
    assert Z.tools()["python3"] in (True, False)


def test_equivalence(spark):
    df = spark.createDataFrame([(1, "print(int(input()) * 2)", 0, "3"), (1, "print(int(input()) * 2)", 1, "x"), (2, "while 1: pass", 0, ""), (3, "print(1)", 0, "")], "code_id int, code string, test_id int, input string")
    with pytest.raises(PermissionError):
        X.run_tests(df)
    before = X.run_tests(df, allow=True, seconds=1.0)
    after = X.run_tests(df.withColumn("code", F.when(F.col("code_id") == 3, "print(2)").otherwise(F.col("code"))), allow=True, seconds=1.0)
    got = {r.code_id: (r.passed, r.failed, r.error_cases, r.is_equivalent, r.pass_rate) for r in X.equivalence(before, after, spark.createDataFrame([(i,) for i in range(1, 5)], "code_id int")).collect()}
    assert got == {1: (1, 0, 1, True, 0.5), 2: (0, 0, 1, True, 0.0), 3: (0, 1, 0, False, 0.0), 4: (0, 0, 0, True, 1.0)}
