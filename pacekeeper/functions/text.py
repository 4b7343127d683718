"""Text expressions: normalisation, tokens, hashes, similarity, names.

All are built-in Catalyst expressions except ``edit_similarity``, for which there is none.
``(?m)``-style flags carry ``d`` so that only a line feed ends a line.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, MapType, StringType, StructType

Text = Column | str


def _col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Text) -> Column:
    """Without white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(_col(x), r"^\s+|\s+$", "")


def normalize_code(x: Text) -> Column:
    """Dedup key text: without //, /* */ and # comments, blanks squeezed, blank lines removed. Null is empty."""
    c = F.coalesce(_col(x), F.lit(""))
    for pattern, by in ((r"(?md)//.*?$", ""), (r"(?s)/\*.*?\*/", ""), (r"(?md)#.*?$", ""), (r"[ \t]+", " "), (r"\n\s*\n", "\n")):
        c = F.regexp_replace(c, pattern, by)
    return strip(c)


def tokens(x: Text) -> Column:
    """Word tokens (Unicode) of the normalised text, in order."""
    return F.regexp_extract_all(normalize_code(x), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def code_hash(x: Text) -> Column:
    return F.md5(normalize_code(x))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """Of two arrays without repeats: both empty 1, one empty 0."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1)))


def jaccard(a: Text, b: Text) -> Column:
    return jaccard_of_sets(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> float:
        if not x or not y:
            return float(not x and not y)
        return SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def edit_similarity(a: Text, b: Text) -> Column:
    """Ratcliff-Obershelp ratio of the normalised texts: both empty 1, one empty 0."""
    return _ratio(normalize_code(a), normalize_code(b))


def similarity(a: Text, b: Text, method: str) -> Column:
    if method == "hash":
        return F.when(code_hash(a) == code_hash(b), 1.0).otherwise(0.0)
    if method == "jaccard":
        return jaccard(a, b)
    if method == "edit":
        return edit_similarity(a, b)
    if method == "combined":
        return F.when(code_hash(a) == code_hash(b), 1.0).otherwise(jaccard(a, b))
    raise ValueError(f"unknown method: {method}")


def pair_similarity(src: Column, tgt: Column, mode: str) -> Column:
    """One number from the similarities of both sides of a pair."""
    by_mode = {"src": src, "tgt": tgt, "both": F.least(src, tgt), "either": F.greatest(src, tgt)}
    return by_mode.get(mode, src)


#: Metadata assignments and comment lines that name an author.
PYTHON_AUTHOR = ("__author__", "__date__", "__version__", "__email__", "__copyright__", "__license__", "__maintainer__")
C_STYLE_AUTHOR = (r"@[Aa]uthor[:\s]", r"@[Dd]ate[:\s]", r"@[Vv]ersion[:\s]", r"[Cc]opyright", r"[Cc]reated\s+by", r"[Ww]ritten\s+by", r"[Pp]roblem[:\s]", r"[Ss]olution\s+by")


def scrub_author(x: Text, language: str) -> Column:
    """Author lines out of Python, or out of C++ and Java, where the rest of the line goes."""
    c = _col(x)
    if language == "python":
        for name in PYTHON_AUTHOR:
            c = F.regexp_replace(c, rf"(?md)^{name}\s*=.*$", "")
        return c
    for pattern in C_STYLE_AUTHOR:
        c = F.regexp_replace(c, rf"(?md){pattern}.*$", "")
    return F.regexp_replace(c, r"\n\s*\n\s*\n", "\n\n")


def basic_clean(x: Text) -> Column:
    """Comment removal for languages without a cleaner of their own (not safe inside strings)."""
    c = _col(x)
    for pattern in (r"(?md)//.*$", r"(?s)/\*.*?\*/", r"(?md)#.*$"):
        c = F.regexp_replace(c, pattern, "")
    return c


def code_type(solution: Text, entry_point: Text, first_input: Text) -> Column:
    """``io`` or ``function``: what the first solution says, then its first input, then the entry point."""
    s = F.coalesce(_col(solution), F.lit(""))
    first = F.coalesce(_col(first_input), F.lit(""))
    return (
        F.when(s.contains("input()") | s.contains("sys.stdin"), "io")
        .when(s.contains("def solution(") | s.contains("class Solution"), "function")
        .when(first.contains("\n"), "io")
        .when(F.coalesce(_col(entry_point), F.lit("")) != "", "function")
        .otherwise("io")
    )


def entry_point(prompt: Text) -> Column:
    return F.regexp_extract(F.coalesce(_col(prompt), F.lit("")), r"def\s+(\w+)\s*\(", 1)


def fix_generator(x: Text) -> Column:
    """Whole-number division on lines that draw random whole numbers."""
    fixed = F.transform(F.split(_col(x), "\n", -1), lambda s: F.when(s.contains("random.randint") & s.contains(" / "), F.replace(s, F.lit(" / "), F.lit(" // "))).otherwise(s))
    return F.array_join(fixed, "\n")


def rename_main_class(x: Text, name: str = "Solution") -> Column:
    """Java: the public class, or else the first class, is renamed wherever ``class <old>`` stands."""
    c = _col(x)
    public = F.regexp_extract(c, r"public\s+class\s+(\w+)", 1)
    old = F.when(public != "", public).otherwise(F.regexp_extract(c, r"\bclass\s+(\w+)", 1))
    pattern = F.concat(F.lit(r"\bclass\s+"), old, F.lit(r"\b"))
    return F.when((old == "") | (old == name), c).otherwise(F.regexp_replace(c, pattern, F.lit(f"class {name}")))


def _one_place(x: Column) -> Column:
    """A double of 0 or more to one place by its exact binary value, halves to even, as C and Python round (Java does not)."""
    whole = F.floor(x)
    part = x - whole  # exact
    up = F.lit(0)
    for i in range(10):
        half = (2 * i + 1) / 20
        off = Fraction(half) - Fraction(2 * i + 1, 20)
        over = off > 0 or off == 0 and i % 2 == 1
        up = up + (part >= half if over else part > half).cast("int")
    return F.concat((whole + F.when(up == 10, 1).otherwise(0)).cast("string"), F.lit("."), (up % 10).cast("string"))


def human_count(n: Text) -> Column:
    c = _col(n)
    return F.when(c >= 1_000_000, F.concat(_one_place(c / 1_000_000), F.lit("M"))).when(c >= 1_000, F.concat(_one_place(c / 1_000), F.lit("K"))).otherwise(c.cast("string"))


#: Names under which a language is known.
LANGUAGE_NAMES = {"python": "Python", "py": "Python", "python3": "Python", "cpp": "C++", "c++": "C++", "cc": "C++", "java": "Java"}


def language_name(x: Text) -> Column:
    c = _col(x)
    out = F.upper(c)
    for alias, name in LANGUAGE_NAMES.items():
        out = F.when(c == alias, name).otherwise(out)
    return out


def file_safe(x: Text) -> Column:
    """A model name as part of a file name; empty for null."""
    c = F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"[^a-zA-Z0-9_\-.]", "_")
    return F.regexp_replace(F.regexp_replace(c, r"_+", "_"), r"^[_.]+|[_.]+$", "")


def result_name(stem: Text, prompt: Text, model: Text) -> Column:
    """Result file of an input stem, prompt kind and model."""
    safe = file_safe(model)
    return F.concat(_col(stem), F.lit("_results_"), _col(prompt), F.when(safe == "", "").otherwise(F.concat(F.lit("_"), safe)), F.lit(".json"))


def base_id(x: Text) -> Column:
    return F.regexp_replace(_col(x), r"_(forward|reversed)$", "")


def synthetic_id(pair_id: Text, problem_id: Text, speedup: Text, line: Text) -> Column:
    """The pair's id, else problem and speedup, else problem and line, else line."""
    pid, prob, sp = (F.nullif(_col(c).cast("string"), F.lit("")) for c in (pair_id, problem_id, speedup))
    tail = F.concat(F.lit("line_"), _col(line).cast("string"))
    return F.coalesce(pid, F.concat(prob, F.lit("_"), sp), F.concat(prob, F.lit("_line"), _col(line).cast("string")), tail)


def json_value(x: Column, kind: DataType) -> Column:
    """JSON text of a value that is JSON text itself or an object; null where text is no JSON."""
    if isinstance(kind, StringType):
        return F.when(F.try_parse_json(x).isNotNull(), x)
    return F.to_json(x) if isinstance(kind, (StructType, ArrayType, MapType)) else x.cast("string")
