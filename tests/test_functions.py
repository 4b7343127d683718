"""Literal tables for text functions, parsers, bins and statistics."""

import random
import statistics
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pacekeeper.functions import bins as B, parse as P, stats as S, text as T


def value(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or [F.lit(1).alias("_")]).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("text", "direction", "number"), [
    ("FASTER 2.50", "FASTER", 2.5), ("slower -1.5", "SLOWER", -1.5), ("2.0 FASTER", "FASTER", 2.0), ("SLOWER than FASTER 3", "FASTER", 3.0), ("text\nFASTER", "FASTER", None),
    ("FASTER 3\nbye", "FASTER", None), ("", None, None), ("no label 7", None, None), ("SLOWER\nx FASTER 2. y", "FASTER", 2.0), (None, None, None), ("FASTER 1 SLOWER 22 x 4", "FASTER", 1.0),
])
def test_format_late(spark, text, direction, number):
    got = value(spark, P.format_late("t"), t=text) if text is not None else value(spark, P.format_late(F.lit(None).cast("string")))
    assert (got.direction, got.value) == (direction, number)


def test_format_late_equals_a_plain_reading(spark):
    import re

    def plain(text):
        body = text.strip()
        line = body.split("\n")[-1].strip().upper()
        dirs = [(m.start(), m[0]) for m in re.finditer("FASTER|SLOWER", line)]
        nums = [(m.start(), float(m[0])) for m in re.finditer(r"[-+]?\d+\.?\d*", line)]
        every = re.findall("FASTER|SLOWER", body.upper())
        if not dirs or not nums:
            return (dirs[-1][1] if dirs else every[-1] if every else None), None
        near = [(n - d, i, name, v) for i, (n, v) in enumerate(nums) for d, name in dirs if d < n]
        return min(near)[2:] if near else (dirs[-1][1], nums[-1][1])

    rng = random.Random(0)
    texts = ["".join(rng.choices(["FASTER", "slower", " ", "1", "2.5", "-", "\n", "x", "."], k=rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", P.format_late("t").alias("p"))
    for r in df.collect():
        assert (r.p.direction, r.p.value) == tuple(plain(texts[r.i])), repr(texts[r.i])


@pytest.mark.parametrize(("text", "direction", "number"), [("faster 2.5 then 3", "FASTER", 2.5), ("SLOWER by x 4", "SLOWER", 4.0), ("hm\nit is FASTER by 7", "FASTER", 7.0), ("x\nSLOWER 123456789012345678901234", "SLOWER", 1234567890123456789.0), ("", None, None)])
def test_format_early(spark, text, direction, number):
    got = value(spark, P.format_early("t"), t=text)
    assert (got.direction, got.value) == (direction, number)


@pytest.mark.parametrize(("text", "late", "early"), [("A", "A", "A"), ("b\nok A then B", "B", "B"), ("xx\nyy", None, None), ("maybe\nno", "B", "A"), ("", None, None)])
def test_letters(spark, text, late, early):
    assert value(spark, P.letter_late("t"), t=text) == late and value(spark, P.letter_early("t"), t=text) == early


@pytest.mark.parametrize(("text", "pair", "triple"), [
    ("**Answer: A**", "A", "A"), ("Answer: b", "B", "B"), ("答案：B", "B", "B"), ("A.", "A", "A"), ("Answer: C", "PARSE_FAILED", "C"), ("Answer: Both", "B", "B"), ("Answer: A\nbye", "PARSE_FAILED", "PARSE_FAILED"),
    ("", "UNKNOWN", "UNKNOWN"), ("答案 差不多", "SIMILAR", "SIMILAR"), ("C", "PARSE_FAILED", "C"),
])
def test_answers(spark, text, pair, triple):
    assert value(spark, P.answer("t"), t=text) == pair and value(spark, P.answer("t", True), t=text) == triple


def test_normalisation_and_tokens(spark):
    code = "#include <x>\nint a = 7 // 2;\r\n/* b\nc */\n\n\n  return  a;  "
    assert value(spark, T.normalize_code("t"), t=code) == "int a = 7 \n return a;"
    assert value(spark, T.normalize_code(F.lit(None).cast("string"))) == ""
    assert value(spark, T.tokens("t"), t="é_1 b-c") == ["é_1", "b", "c"]
    assert value(spark, T.jaccard("a", "b"), a="", b="# x") == 1.0 and value(spark, T.jaccard("a", "b"), a="x", b="") == 0.0
    assert value(spark, T.similarity("a", "b", "edit"), a="abcd", b="bcde") == SequenceMatcher(None, "abcd", "bcde").ratio()
    with pytest.raises(ValueError):
        T.similarity("a", "b", "none")


def test_names(spark):
    assert value(spark, T.file_safe("t"), t="claude/3/opus") == "claude_3_opus" and value(spark, T.file_safe("t"), t="_m:latest.") == "m_latest"
    assert value(spark, T.rename_main_class("t"), t="class A { class AB {} } class A") == "class Solution { class AB {} } class Solution"
    assert value(spark, T.language_name("t"), t="rust") == "RUST" and value(spark, T.base_id("t"), t="a_forward_reversed") == "a_forward"
    assert value(spark, T.human_count(F.lit(1_500_000))) == "1.5M" and value(spark, T.human_count(F.lit(999))) == "999"


def test_bins(spark):
    rows = [(1.4999,), (1.5,), (2.0,), (4.0,), (8.0,), (16.0,), (1e9,), (float("inf"),), (None,)]
    df = spark.createDataFrame(rows, "x double").select(B.bin_index(F.col("x"), B.SAMPLING_BINS).alias("i"))
    assert [r.i for r in df.collect()] == [None, 0, 1, 2, 3, 4, 4, 4, None]
    assert B.parse_bins("4,1.5,inf") == (1.5, 4.0, float("inf")) and B.labels((1.5, 2.0, float("inf"))) == ["[1.5x, 2.0x)", "[2.0x, inf)"]
    sp = lambda g, s, f: value(spark, B.speedup(F.lit(g), F.lit(s), F.lit(f)))
    assert sp("3.2", 1.0, 1.0) == 3.2 and sp("x", 4.0, 2.0) is None and sp(None, 4.0, 2.0) == 2.0 and sp(None, 4.0, 0.0) is None


@pytest.mark.parametrize("trim", [1, 2])
def test_trimmed_statistics(spark, trim):
    rng = random.Random(trim)
    groups = {n: [rng.choice([1.0, 2.0, 5.5, 9.25]) for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 12)}
    df = spark.createDataFrame([(n, v) for n, vs in groups.items() for v in vs], "g int, v double")
    for r in S.trimmed(df, ["g"], "v", trim).collect():
        left = sorted(groups[r.g])
        left = left[trim:-trim] if len(left) > 2 * trim else left
        assert r.mean == pytest.approx(statistics.mean(left)) and r.std == pytest.approx(statistics.stdev(left) if len(left) > 1 else 0) and r.n_runs == r.g
