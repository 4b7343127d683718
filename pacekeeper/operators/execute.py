"""Opt-in execution of Python, C++ and Java programs: tests, repeated measurement, syntax, generated inputs.

Nothing here runs unless ``allow=True``: programs are untrusted. Each run is a process of its
own with limits on time, memory and files, in an empty folder. A program is built once for the
rows of a batch that share it. Tasks run side by side as the cluster has cores; a run that is to be
measured alone needs ``spark.task.cpus`` set accordingly.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import resource
import shutil
import subprocess
import sys
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pacekeeper.functions.text import fix_generator
from pacekeeper.operators.sanitize import ALIASES, sanitized

#: Return codes of a run that gave none itself.
TIMEOUT, FAILED, NO_TOOL, NO_BUILD, NO_CLASS = -1, -2, -3, -4, -5
#: Names that a generator of test inputs may have, its seed, and failures after which it is left.
GENERATORS, GENERATOR_SEED, MOST_FAILURES = ("generate_test_case", "generate_input", "gen_test_case", "gen_input"), 1024, 10
JAVA_FLAGS = ("-Xmx2g", "-Xms256m", "-XX:+UseSerialGC", "-XX:TieredStopAtLevel=4")


def kind_of(language: str | None) -> str | None:
    """python, cpp or java; null for other languages."""
    name = (language or "").lower().strip()
    return "cpp" if name == "c" else ALIASES.get(name)


def java_class(code: str) -> str | None:
    """The public class, or else the first one."""
    found = re.search(r"public\s+class\s+(\w+)", code) or re.search(r"class\s+(\w+)", code)
    return found[1] if found else None


def limited(command: list[str], place: str, stdin: str = "", seconds: float = 10.0, memory_mb: int | None = 4096) -> tuple[int, str, float]:
    """(return code, standard output, CPU seconds) of a process group of its own, which ends with it."""

    def limit() -> None:
        os.setsid()
        limits = [(resource.RLIMIT_CPU, int(seconds) + 1), (resource.RLIMIT_FSIZE, 64 << 20), (resource.RLIMIT_CORE, 0)]
        if memory_mb is not None:
            limits.append((resource.RLIMIT_AS, memory_mb << 20))
        for what, most in limits:
            resource.setrlimit(what, (most, most))

    env = {"PATH": os.environ.get("PATH", "/usr/bin:/bin"), "HOME": place, "TMPDIR": place}
    with tempfile.TemporaryFile("w+") as given, tempfile.TemporaryFile("w+", errors="replace") as out:
        given.write(stdin)
        given.seek(0)
        try:
            run = subprocess.Popen(command, stdin=given, stdout=out, stderr=subprocess.DEVNULL, cwd=place, preexec_fn=limit, env=env)
        except OSError:
            return FAILED, "", 0.0
        before = resource.getrusage(resource.RUSAGE_CHILDREN)
        try:
            rc = run.wait(seconds)
        except subprocess.TimeoutExpired:
            rc = TIMEOUT
        finally:
            with contextlib.suppress(OSError):
                os.killpg(run.pid, 9)
            run.wait()
        after = resource.getrusage(resource.RUSAGE_CHILDREN)
        out.seek(0)
        cpu = after.ru_utime + after.ru_stime - before.ru_utime - before.ru_stime
        return rc, "" if rc == TIMEOUT else out.read(), cpu


@lru_cache(maxsize=None)
def can_build(kind: str) -> bool:
    """Whether this machine has a compiler that builds the least program."""
    name, text, tools = {"cpp": ("main.cpp", "int main() {}\n", ["g++"]), "java": ("Main.java", "class Main {}\n", ["javac", "java"])}[kind]
    if not all(map(shutil.which, tools)):
        return False
    with tempfile.TemporaryDirectory() as place:
        with open(f"{place}/{name}", "w") as f:
            f.write(text)
        return limited([tools[0], name], place, seconds=60, memory_mb=None)[0] == 0


def build(code: str, language: str | None, place: str) -> list[str] | int:
    """The command that runs the program, built in ``place`` where it needs to be; a return code if it can't run."""
    kind = kind_of(language)
    if kind == "python":
        with open(f"{place}/main.py", "w") as f:
            f.write(code)
        return [sys.executable, "-I", f"{place}/main.py"]
    if kind == "cpp":
        if not can_build("cpp"):
            return NO_TOOL
        with open(f"{place}/main.cpp", "w") as f:
            f.write(code)
        rc = limited(["g++", "-std=c++17", "-O2", "-o", "main", "main.cpp"], place, seconds=30)[0]
        return [f"{place}/main"] if rc == 0 else rc if rc == TIMEOUT else NO_BUILD
    if kind == "java":
        if not can_build("java"):
            return NO_TOOL
        name = java_class(code)
        if name is None:
            return NO_CLASS
        with open(f"{place}/{name}.java", "w") as f:
            f.write(code)
        rc = limited(["javac", f"{name}.java"], place, seconds=60, memory_mb=None)[0]
        return ["java", *JAVA_FLAGS, "-cp", place, name] if rc == 0 else rc if rc == TIMEOUT else NO_BUILD
    return NO_TOOL


def run_program(code: str, language: str, stdin: str, seconds: float = 10.0, memory_mb: int = 4096) -> tuple[int, str]:
    """(return code, standard output)."""
    with Bench(memory_mb) as bench:
        return bench.run(code, language, stdin, seconds)[:2]


def run_python(code: str, stdin: str, seconds: float = 5.0, memory_mb: int = 512) -> tuple[int, str]:
    return run_program(code, "python", stdin, seconds, memory_mb)


class Bench:
    """Built programs, each in a folder of its own, for as long as the block lasts."""

    def __init__(self, memory_mb: int = 4096, most: int = 64) -> None:
        self.memory_mb, self.most, self.built = memory_mb, most, {}

    def __enter__(self) -> Bench:
        return self

    def __exit__(self, *_: object) -> None:
        for place, _command in self.built.values():
            shutil.rmtree(place, ignore_errors=True)

    def run(self, code: str | None, language: str | None, stdin: str | None, seconds: float) -> tuple[int, str, float]:
        key = (kind_of(language), code or "")
        if key not in self.built:
            if len(self.built) >= self.most:
                shutil.rmtree(self.built.pop(next(iter(self.built)))[0], ignore_errors=True)
            place = tempfile.mkdtemp()  # of this process on this machine only
            try:
                self.built[key] = (place, build(code or "", language, place))
            except (OSError, ValueError):
                self.built[key] = (place, FAILED)
        place, command = self.built[key]
        if isinstance(command, int):
            return command, "", 0.0
        return limited(command, place, stdin or "", seconds, None if key[0] == "java" else self.memory_mb)


def _kinds(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _asked(allow: bool) -> None:
    if not allow:
        raise PermissionError("programs are only run with allow=True")


def run_tests(programs: DataFrame, allow: bool = False, seconds: float = 5.0) -> DataFrame:
    """code_id, test_id, rc, output for rows (code_id, code, test_id, input[, language]); Python without a language."""
    _asked(allow)
    told = programs if "language" in programs.columns else programs.withColumn("language", F.lit("python"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            with Bench() as bench:
                got = [bench.run(c, lang, i, seconds) for c, lang, i in zip(b["code"], b["language"], b["input"])]
            yield pd.DataFrame({"code_id": b["code_id"], "test_id": b["test_id"], "rc": [g[0] for g in got], "output": [g[1] for g in got]})

    return told.select("code_id", "code", "language", "test_id", "input").mapInPandas(run, f"{_kinds(told, 'code_id', 'test_id')}, rc int, output string")


def pass_table(results: DataFrame, tests: DataFrame) -> DataFrame:
    """code_id, test_id, passed: the program ended well and printed what was expected (a test without an expected output passes if it ended well)."""
    same = F.col("expected").isNull() | (F.rtrim("output") == F.rtrim("expected"))
    return results.join(tests.select("test_id", "expected"), "test_id").select("code_id", "test_id", ((F.col("rc") == 0) & F.coalesce(same, F.lit(False))).alias("passed"))


def measure_runs(programs: DataFrame, allow: bool = False, warmup: int = 0, runs: int = 12, seconds: float = 10.0) -> DataFrame:
    """code_id, test_id, phase, run, value (CPU nanoseconds), ok: every program and test ``warmup`` times cold and ``runs`` times measured.

    After a failed warm-up run the test is not measured. Raw rows only: trimming and roll-ups are those of the measurement tables.
    """
    _asked(allow)
    told = programs if "language" in programs.columns else programs.withColumn("language", F.lit("python"))

    def one(bench: Bench, code: str, language: str, stdin: str) -> Iterator[tuple[str, int, int | None, bool]]:
        for phase, n in (("warmup", warmup), ("measure", runs)):
            for i in range(n):
                rc, _, cpu = bench.run(code, language, stdin, seconds)
                yield phase, i, int(cpu * 1e9) if rc == 0 else None, rc == 0
                if rc != 0 and phase == "warmup":
                    return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            with Bench() as bench:
                for c, lang, code_id, test_id, i in zip(b["code"], b["language"], b["code_id"], b["test_id"], b["input"]):
                    rows = list(one(bench, c, lang, i))
                    out = pd.DataFrame(rows, columns=["phase", "run", "value", "ok"])
                    out.insert(0, "test_id", test_id)
                    out.insert(0, "code_id", code_id)
                    yield out.astype({"value": "Int64"})

    return told.select("code_id", "code", "language", "test_id", "input").mapInPandas(run, f"{_kinds(told, 'code_id', 'test_id')}, phase string, run int, value long, ok boolean")


def compiled_syntax(df: DataFrame, code: str = "code", language: str = "language", allow: bool = False) -> DataFrame:
    """``df`` with compile_status: valid, invalid, unchecked (no working compiler there, or no text) or skipped (another language)."""
    _asked(allow)

    def status(text: str | None, lang: str | None) -> str:
        kind = kind_of(lang)
        if kind is None:
            return "skipped"
        if text is None or kind != "python" and not can_build(kind):
            return "unchecked"
        with tempfile.TemporaryDirectory() as place:
            name = {"cpp": "main.cpp", "python": "main.py", "java": f"{(java_class(text) if 'public' in text else None) or 'Main'}.java"}[kind]
            with open(f"{place}/{name}", "w", errors="replace") as f:
                f.write(text)
            command = {"cpp": ["g++", "-fsyntax-only", "-std=c++17", "-w", name], "java": ["javac", "-Xlint:none", name], "python": [sys.executable, "-I", "-m", "py_compile", name]}[kind]
            rc = limited(command, place, seconds=60, memory_mb=None)[0]
        return "unchecked" if rc == FAILED else "valid" if rc == 0 else "invalid"

    @F.pandas_udf("string")
    def check(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([status(t, x) for t, x in zip(texts, langs)])

    return df.withColumn("compile_status", check(F.col(code), F.col(language)))


def formatted(df: DataFrame, code: str = "code", language: str = "language", allow: bool = False) -> DataFrame:
    """``df`` with formatted_code: by black, clang-format or google-java-format; the text as it is where the tool is absent or refuses it."""
    _asked(allow)
    tools = {"python": ["black", "-q", "-"], "cpp": ["clang-format", "--style=Google"], "java": ["google-java-format", "-"]}

    def one(text: str | None, lang: str | None) -> str | None:
        command = tools.get(kind_of(lang) or "")
        if text is None or command is None or not shutil.which(command[0]):
            return text
        with tempfile.TemporaryDirectory() as place:
            rc, out, _ = limited(command, place, text, 30.0, None)
        return out if rc == 0 and out else text

    @F.pandas_udf("string")
    def layout(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([one(t, x) for t, x in zip(texts, langs)], dtype="object")

    return df.withColumn("formatted_code", layout(F.col(code), F.col(language)))


def equivalence(before: DataFrame, after: DataFrame, samples: DataFrame) -> DataFrame:
    """Per program: tests passed, failed and in error, pass rate, and whether no test failed.

    ``before`` and ``after`` are results of run_tests; ``samples`` (code_id) also names programs without tests,
    whose rate is 1. A test in error in either version is counted as error and not as failed.
    """
    x = before.select("code_id", "test_id", F.col("rc").alias("rc0"), F.rtrim("output").alias("out0"))
    y = after.select("code_id", "test_id", F.col("rc").alias("rc1"), F.rtrim("output").alias("out1"))
    bad = (F.col("rc0") != 0) | (F.col("rc1") != 0)
    same = F.col("out0") == F.col("out1")
    n = x.join(y, ["code_id", "test_id"]).groupBy("code_id").agg(F.count_if(~bad & same).alias("passed"), F.count_if(~bad & ~same).alias("failed"), F.count_if(bad).alias("error_cases"))
    out = samples.select("code_id").distinct().join(n, "code_id", "left").fillna(0, ["passed", "failed", "error_cases"])
    total = F.col("passed") + F.col("failed") + F.col("error_cases")
    return out.withColumn("pass_rate", F.coalesce(F.try_divide(F.col("passed"), total), F.lit(1.0))).withColumn("is_equivalent", F.col("failed") == 0)


def sanitize_and_verify(programs: DataFrame, tests: DataFrame, allow: bool = False, seconds: float = 5.0) -> DataFrame:
    """Sanitized programs (code_id, code, language) with the outcome of running both versions on the tests (code_id, test_id, input).

    A row that fails stays a row: a null or broken program has its syntax status, and its tests count as errors.
    """
    _asked(allow)
    clean = sanitized(programs)
    side = lambda c: tests.join(clean.select("code_id", F.col(c).alias("code"), "language"), "code_id")
    return clean.join(equivalence(run_tests(side("code"), True, seconds), run_tests(side("cleaned_code"), True, seconds), clean), "code_id")


_GENERATE = r"""
import json, random, sys
names, seed, most, code, have, want = json.loads(sys.stdin.read())
import bisect, collections, functools, heapq, itertools, math, re, string
space = dict(vars()); out = []; failures = tries = 0
random.seed(seed)
exec(code, space)
make = next(space[n] for n in names if callable(space.get(n)))
while have + len(out) < want and tries < 3 * want and failures <= most:
    tries += 1
    try:
        got = make()
        out.append(json.dumps(list(got) if isinstance(got, tuple) else [got]))
    except Exception:
        failures += 1
sys.stdout.write("\x1e" + json.dumps(out))
"""


def generated_tests(problems: DataFrame, want: int, allow: bool = False, seconds: float = 20.0, key: str = "problem_id") -> DataFrame:
    """key, cases (JSON texts of argument lists): inputs made by each problem's generator_code until n_cases and they are ``want``.

    A generator is tried at most 3 x ``want`` times and left after more than 10 failures; one that is absent, broken or too slow gives none.
    """
    _asked(allow)

    def one(code: str | None, have: int) -> list[str]:
        if not code or code == "None" or have >= want:
            return []
        rc, out = run_python(_GENERATE, json.dumps([GENERATORS, GENERATOR_SEED, MOST_FAILURES, code, have, want]), seconds)
        return json.loads(out.rpartition("\x1e")[2]) if rc == 0 and "\x1e" in out else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "cases": [one(c, int(n)) for c, n in zip(b["_code"], b["_have"])]})

    have: Column = F.coalesce(F.col("n_cases"), F.lit(0)) if "n_cases" in problems.columns else F.lit(0)
    return problems.select(key, fix_generator("generator_code").alias("_code"), have.alias("_have")).mapInPandas(run, f"{_kinds(problems, key)}, cases array<string>")
