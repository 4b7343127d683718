"""Chat messages for comparison models, and the offline stand-in for model calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pacekeeper.functions.text import language_name

_FENCE = {"Python": "python", "C++": "cpp", "Java": "java"}
_SYSTEM = "You are an expert in program performance. You compare programs that solve the same problem and decide which one runs faster."
_STEPS = "Think step by step about algorithms, data structures, input and output, and constant factors before you decide."
_END = "End with one last line of exactly this form: **Answer: {letters}**"
#: Own worked examples by language: two programs each, the faster one, and why.
_EXAMPLES = {
    "Python": [
        ("total = 0\nfor i in range(n):\n    total += i", "total = n * (n - 1) // 2", "B", "The closed form takes constant time, the loop takes n steps."),
        ("seen = set(xs)\nprint(sum(x in seen for x in ys))", "print(sum(x in xs for x in ys))", "A", "A set lookup takes constant time, a list lookup takes a scan."),
    ],
    "C++": [
        ("for (int i = 0; i < n; ++i) s = s + t[i];", "s.reserve(n); for (int i = 0; i < n; ++i) s += t[i];", "B", "Appending in place copies each character once, s + t copies all of them each time."),
        ("std::sort(v.begin(), v.end());", "for (auto& x : v) for (auto& y : v) if (x < y) std::swap(x, y);", "A", "Sorting takes n log n steps, the double loop n squared."),
    ],
    "Java": [
        ('String s = ""; for (String x : xs) s += x;', "StringBuilder b = new StringBuilder(); for (String x : xs) b.append(x);", "B", "The builder appends in place, += copies the whole string each time."),
        ("int[] c = new int[n];", "List<Integer> c = new ArrayList<>(Collections.nCopies(n, 0));", "A", "A primitive array needs no boxing."),
    ],
}
KINDS = ("zero-shot", "zero-shot-cot", "few-shot", "few-shot-cot")


def _message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))


def _programs(codes: list[Column], lang: Column) -> Column:
    fence = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in _FENCE.items() for v in kv]), lang), F.lower(lang))
    parts: list[Column] = []
    for letter, code in zip("ABC", codes):
        parts += [F.lit(f"Program {letter}:\n```"), fence, F.lit("\n"), code, F.lit("\n```\n\n")]
    return F.concat(*parts)


def comparison_messages(codes: list[Column], language: Column, kind: str = "zero-shot") -> Column:
    """array<struct<role, content>> that asks which of two or three programs runs fastest."""
    if kind not in KINDS:
        raise ValueError(f"unknown prompt: {kind}")
    lang = language_name(language)
    letters = "A or B" if len(codes) == 2 else "A, B or C"
    cot = kind.endswith("cot")
    ask = F.concat(F.lit("Which of these "), lang, F.lit(" programs runs faster on large inputs?\n\n"), _programs(codes, lang), F.lit((_STEPS + "\n" if cot else "") + _END.format(letters=letters)))
    first = [_message("system", _SYSTEM)]
    if not kind.startswith("few"):
        return F.array(*first, _message("user", ask))
    shots = None
    for name, pairs in _EXAMPLES.items():
        told = []
        for a, b, best, why in pairs:
            told.append(_message("user", F.concat(F.lit("Which runs faster?\n\n"), _programs([F.lit(a), F.lit(b)], F.lit(name)))))
            told.append(_message("assistant", (why + "\n" if cot else "") + f"**Answer: {best}**"))
        shots = F.array(*told) if shots is None else shots
        if name == "C++":
            default = F.array(*told)
        shots = F.when(lang == name, F.array(*told)).otherwise(shots) if name != "Python" else F.when(lang == "Python", F.array(*told))
    return F.concat(F.array(*first), F.coalesce(shots, default), F.array(_message("user", ask)))


def swapped_tests(items: DataFrame, key: str = "pair_id", slow: str = "slow_code", fast: str = "fast_code", language: str = "language", kind: str = "zero-shot") -> DataFrame:
    """key, test_no, messages: the slow program is A in test 1 and B in test 2."""
    orders = F.array(F.struct(F.lit(1).alias("test_no"), F.col(slow).alias("a"), F.col(fast).alias("b")), F.struct(F.lit(2).alias("test_no"), F.col(fast).alias("a"), F.col(slow).alias("b")))
    rows = items.select(key, F.coalesce(language, F.lit("cpp")).alias("_lang"), F.explode(orders).alias("_t"))
    return rows.select(key, "_t.test_no", comparison_messages([F.col("_t.a"), F.col("_t.b")], F.lower("_lang"), kind).alias("messages"))


def rotated_tests(items: DataFrame, key: str = "pair_id", language: str = "language", kind: str = "zero-shot") -> DataFrame:
    """key, test_no, messages: the fast program is A, then B, then C."""
    f, m, s = (F.col(c) for c in ("fast_code", "medium_code", "slow_code"))
    turns = F.array(*[F.struct(F.lit(i).alias("test_no"), a.alias("a"), b.alias("b"), c.alias("c")) for i, (a, b, c) in enumerate(((f, m, s), (s, f, m), (m, s, f)), 1)])
    rows = items.select(key, F.coalesce(language, F.lit("cpp")).alias("_lang"), F.explode(turns).alias("_t"))
    return rows.select(key, "_t.test_no", comparison_messages([F.col("_t.a"), F.col("_t.b"), F.col("_t.c")], F.lower("_lang"), kind).alias("messages"))


def chat_text(instruction: Column, given: Column, output: Column | None = None) -> Column:
    """ChatML text of a training sample; without output it ends where the model goes on."""
    user = F.when(F.coalesce(given, F.lit("")) == "", instruction).otherwise(F.concat(instruction, F.lit("\n\n"), given))
    head = F.concat(F.lit("<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return head if output is None else F.concat(head, output, F.lit("<|im_end|>"))


def respond(tests: DataFrame, predict: Callable[[list[list[dict]]], list[str]], key: str = "pair_id") -> DataFrame:
    """key, test_no, response of a pluggable model, called for a batch of message lists at a time.

    With recorded answers no model is needed: join ``tests`` with them instead.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "test_no": b["test_no"], "response": predict([[dict(m) for m in ms] for ms in b["messages"]])})

    kind = tests.schema[key].dataType.simpleString()
    return tests.mapInPandas(run, f"{key} {kind}, test_no int, response string")


#: Outcomes of a call, and what stands for an answer that the service withheld or cut.
FILTERED, CUT = "Content filtered by API", "\n\n[RESPONSE TRUNCATED]"


def call_once(call: Callable[[list[dict]], object], messages: list[dict], attempts: int = 3, pause: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """response, status (ok, truncated, filtered, empty, error), attempts and token counts of one call.

    ``call`` gives the text, or a dictionary with content, finish_reason, prompt_tokens and completion_tokens. Empty
    answers and exceptions are tried again after ``pause``, 2 x ``pause`` ... seconds; a filtered answer is final.
    """
    told = {"response": "Max retries exceeded", "status": "error", "attempts": 0, "prompt_tokens": 0, "completion_tokens": 0}
    for i in range(1, attempts + 1):
        if i > 1:
            sleep(pause * (i - 1))
        told["attempts"] = i
        try:
            got = call(messages)
            got = {"content": got} if got is None or isinstance(got, str) else dict(got)
            content, reason = (got.get("content") or "").strip(), got.get("finish_reason")
        except Exception as error:  # noqa: BLE001  whatever a client raises is an outcome of the row
            told |= {"response": str(error)[:500], "status": "error"}
            continue
        if content:
            cut = reason == "length"
            tokens = {k: int(got.get(k) or 0) for k in ("prompt_tokens", "completion_tokens")}
            return told | tokens | {"response": content + CUT if cut else content, "status": "truncated" if cut else "ok"}
        if reason == "content_filter":
            return told | {"response": FILTERED, "status": "filtered"}
        told |= {"response": f"Empty content (finish_reason: {reason})", "status": "empty"}
    return told


def ask(tests: DataFrame, connect: Callable[[], Callable[[list[dict]], object]], key: str = "pair_id", attempts: int = 3, pause: float = 3.0, threads: int = 8) -> DataFrame:
    """key, test_no, response, status, attempts, prompt_tokens, completion_tokens of a service that answers one message list at a time.

    ``connect`` makes the callable once for each task; at most ``threads`` (64) calls of a task are under way at a time. A failed
    call is an outcome of its row and never of the task.
    """
    threads = max(1, min(64, threads))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = connect()
        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                for at in range(0, len(b), 8 * threads):
                    part = b.iloc[at : at + 8 * threads]
                    found = pool.map(lambda ms: call_once(call, [dict(m) for m in ms], attempts, pause), part["messages"])
                    out = pd.DataFrame(list(found))
                    out.insert(0, "test_no", part["test_no"].to_numpy())
                    out.insert(0, key, part[key].to_numpy())
                    yield out

    kind = tests.schema[key].dataType.simpleString()
    return tests.select(key, "test_no", "messages").mapInPandas(run, f"`{key}` {kind}, test_no int, response string, status string, attempts int, prompt_tokens long, completion_tokens long")


def local_messages(code_a: Column, code_b: Column, language: Column) -> Column:
    """Messages for a local model that is to answer with one letter."""
    lang = language_name(language)
    system = F.concat(F.lit("You judge the speed of "), lang, F.lit(" programs."))
    ask_for = F.concat(F.lit("These "), lang, F.lit(" programs do the same.\n\n"), _programs([code_a, code_b], lang), F.lit("Reply with one letter and nothing else, A or B: the program that is faster."))
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), ask_for.alias("content")))


def trained_format_messages(instruction: Column, given: Column) -> Column:
    """Messages for a local model in the form of its training samples."""
    return F.array(F.struct(F.lit("system").alias("role"), instruction.alias("content")), F.struct(F.lit("user").alias("role"), given.alias("content")))
