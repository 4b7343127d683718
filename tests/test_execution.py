"""Programs of three languages run, measured, checked and compared; skipped where a compiler is absent."""

import json

import pytest

from pacekeeper.operators import execute as X

PYTHON = "import sys\nprint(sum(map(int, sys.stdin.read().split())))  # sum\n"
CPP = "#include <iostream>\nint main() { long s = 0, x; while (std::cin >> x) s += x; std::cout << s << std::endl; } // sum\n"
JAVA = "import java.util.*;\npublic class Total { public static void main(String[] a) { Scanner in = new Scanner(System.in); long s = 0; while (in.hasNextLong()) s += in.nextLong(); System.out.println(s); } }\n"
gxx = pytest.mark.skipif(not X.can_build("cpp"), reason="no working g++")
java = pytest.mark.skipif(not X.can_build("java"), reason="no working javac")


def test_python_outcomes():
    assert X.run_program(PYTHON, "py", "1 2") == (0, "3\n")
    assert X.run_program("import sys; sys.exit(3)", "python3", "")[0] == 3
    assert X.run_program("while True: pass", "python", "", seconds=1)[0] in (X.TIMEOUT, -24)
    assert X.run_program("import time; time.sleep(9)", "python", "", seconds=1) == (X.TIMEOUT, "")
    assert X.run_program("x = bytearray(1 << 30)", "python", "", memory_mb=300)[0] == 1
    assert X.run_program("x", "rust", "") == (X.NO_TOOL, "")


@gxx
def test_cpp_outcomes():
    assert X.run_program(CPP, "c++", "1 2") == (0, "3\n")
    assert X.run_program("int main() { return x; }", "cpp", "") == (X.NO_BUILD, "")


@java
def test_java_outcomes():
    assert X.run_program(JAVA, "Java", "1 2") == (0, "3\n")
    assert X.run_program("class A { int x }", "java", "")[0] == X.NO_BUILD
    assert X.run_program("int x;", "java", "") == (X.NO_CLASS, "")


def test_nothing_runs_unasked(spark):
    df = spark.createDataFrame([(1, "x", 1, "")], "code_id long, code string, test_id long, input string")
    for call in (X.run_tests, X.measure_runs, X.compiled_syntax, X.formatted):
        with pytest.raises(PermissionError):
            call(df)
    with pytest.raises(PermissionError):
        X.sanitize_and_verify(df, df)
    with pytest.raises(PermissionError):
        X.generated_tests(df, 3)


def test_measured_runs(spark):
    cold = "import os, sys\np = 'ran'\nok = os.path.exists(p)\nopen(p, 'w').write('x')\nsys.exit(0 if ok else 4)"
    rows = [(1, PYTHON, 1, "1"), (1, PYTHON, 2, "2"), (2, "import sys; sys.exit(1)", 1, ""), (3, cold, 1, "")]
    df = spark.createDataFrame(rows, "code_id long, code string, test_id long, input string")
    got = X.measure_runs(df, True, warmup=2, runs=3).collect()
    n = lambda c, t, p: [(r.run, r.ok) for r in got if (r.code_id, r.test_id, r.phase) == (c, t, p)]
    assert n(1, 1, "warmup") == n(1, 2, "warmup") == [(0, True), (1, True)] and n(1, 2, "measure") == [(0, True), (1, True), (2, True)]
    assert n(2, 1, "warmup") == [(0, False)] and n(2, 1, "measure") == []
    assert n(3, 1, "warmup") == [(0, False)]
    assert all((r.value is not None and r.value > 0) == r.ok for r in got)


def test_syntax_by_compilers(spark):
    rows = [(1, CPP, "cpp"), (2, "int main( {", "c++"), (3, JAVA, "java"), (4, "class A { int }", "java"), (5, "x =", "py"), (6, "x = 1", "py"), (7, "x", "rust"), (8, None, "cpp")]
    df = spark.createDataFrame(rows, "i long, code string, language string")
    got = {r.i: r.compile_status for r in X.compiled_syntax(df, allow=True).collect()}
    want = {1: "valid", 2: "invalid", 3: "valid", 4: "invalid", 5: "invalid", 6: "valid", 7: "skipped", 8: "unchecked"}
    absent = {i for kind, ids in (("cpp", (1, 2)), ("java", (3, 4))) if not X.can_build(kind) for i in ids}
    assert got == want | dict.fromkeys(absent, "unchecked")
    assert {r.i: r.formatted_code for r in X.formatted(df, allow=True).collect()}[8] is None


def test_sanitized_programs_do_the_same(spark):
    rows = [(1, PYTHON, "python"), (2, "print('a # b')  # c", "python"), (3, None, "python"), (4, "print(", "python")]
    programs = spark.createDataFrame(rows, "code_id long, code string, language string")
    tests = spark.createDataFrame([(c, t, f"{t} 1") for c in (1, 2, 3, 4) for t in (1, 2)], "code_id long, test_id long, input string")
    got = {r.code_id: r for r in X.sanitize_and_verify(programs, tests, True).collect()}
    assert len(got) == 4 and (got[1].passed, got[1].is_equivalent, got[2].pass_rate) == (2, True, 1.0)
    assert "#" not in got[1].cleaned_code and got[3].syntax_valid == "error" and (got[4].syntax_valid, got[4].error_cases) == ("invalid", 2)


def test_generated_inputs(spark):
    rows = [
        (1, "def generate_test_case():\n    return random.randint(1, 9), [1]", 0),
        (2, "def gen_input():\n    return random.randint(1, 10 / 2)", 3),
        (3, "def gen_input():\n    raise ValueError", 0), (4, "x =", 0), (5, "None", 0), (6, None, 0), (7, "def gen_input():\n    return 1", 5),
        (8, "n = 0\ndef gen_input():\n    global n\n    n += 1\n    print('noise')\n    if n % 2: raise ValueError\n    return n", 0), (9, "while True: pass", 0),
    ]
    df = spark.createDataFrame(rows, "problem_id long, generator_code string, n_cases int")
    got = {r.problem_id: [json.loads(c) for c in r.cases] for r in X.generated_tests(df, 5, True, seconds=3).collect()}
    assert len(got[1]) == 5 and all(1 <= a <= 9 and b == [1] for a, b in got[1])
    assert len(got[2]) == 2 and all(1 <= x <= 5 for (x,) in got[2])
    assert got[3] == got[4] == got[5] == got[6] == got[7] == got[9] == [] and got[8] == [[2], [4], [6], [8], [10]]
    assert got[1] == [json.loads(c) for r in X.generated_tests(df.filter("problem_id = 1"), 5, True).collect() for c in r.cases]
