"""Comment and author removal from source text, syntax checks, batch statistics.

C++ and Java need no UDF: the text is split into literals, comments and other characters by one
pattern and joined again. Python's comments need its tokenizer, so it is an Arrow-batched UDF.
"""

from __future__ import annotations

import ast
import io
import re
import shutil
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pacekeeper.functions.text import basic_clean, scrub_author

#: Names of languages with a cleaner of their own.
ALIASES = {"python": "python", "py": "python", "python3": "python", "cpp": "cpp", "c++": "cpp", "cc": "cpp", "cxx": "cpp", "java": "java"}

_STRING = r'"(?:\\[\s\S]|[^"\\\n]|\\\z)*+(?:"|\n|\z)'
_CHAR = r"'(?:\\[\s\S]|[^'\\\n]|\\\z)*+(?:'|\n|\z)"
_COMMENTS = r"//[^\n]*+|/\*(?:(?!\*/)[\s\S])*+(?:\*/|\z)"
_REST = r"[^\"'/Ru]++|[\s\S]"
_TEXT_BLOCK = r'"""(?:\\[\s\S]|(?!""")[^\\])*+(?:"""|\z)'
_RAW = r'(?:u8|u|U|L)?R"([^(\s\\)]{0,16})\((?:(?!\)\2")[\s\S])*+(?:\)\2"|\z)'
PATTERNS = {"java": f"({_TEXT_BLOCK}|{_STRING}|{_CHAR}|{_COMMENTS}|{_REST})", "cpp": f"({_RAW}|{_STRING}|{_CHAR}|{_COMMENTS}|{_REST})"}


def strip_c_comments(x: Column | str, language: str) -> Column:
    """A line comment goes, a block comment becomes a space (a line feed if it holds one); literals stay."""
    parts = F.regexp_extract_all(F.col(x) if isinstance(x, str) else x, F.lit(PATTERNS[language]), F.lit(1))
    block = lambda t: F.when(t.contains("\n"), "\n").otherwise(" ")
    clean = lambda t: F.when(t.startswith("//"), "").when(t.startswith("/*"), block(t)).otherwise(t)
    return F.array_join(F.transform(parts, clean), "")


_PY_PARTS = re.compile(r'''("""(?:\\.|(?!""").)*(?:"""|\Z)|\'\'\'(?:\\.|(?!\'\'\').)*(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))|#[^\n]*''', re.S)


def _docstrings(code: str) -> list[ast.Expr]:
    """Triple-quoted strings that are the first statement of a module, class or function."""
    out = []
    for node in ast.walk(ast.parse(code)):
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.body:
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                text = ast.get_source_segment(code, first) or ""
                if text.lstrip("rRuU").startswith(('"""', "'''")):
                    out.append((first, node.body))
    return out


def clean_python(code: str) -> tuple[str, str]:
    """Text without comments and docstrings, and the method: python, or python_fallback where it does not parse."""
    try:
        spots = [(t.start, t.end, "") for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type == tokenize.COMMENT]
        lines = code.splitlines(keepends=True)
        for node, body in _docstrings(code):
            at = lambda row, col: (row, len(lines[row - 1].encode()[:col].decode()))
            alone = len(body) == 1
            spots.append((at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset), "pass" if alone else ""))
    except (tokenize.TokenError, SyntaxError, ValueError, IndentationError, RecursionError):
        return _PY_PARTS.sub(lambda m: m[1] or "", code), "python_fallback"
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    for (r0, c0), (r1, c1), by in sorted(spots, reverse=True):
        code = code[: starts[r0 - 1] + c0] + by + code[starts[r1 - 1] + c1 :]
    return code, "python"


@F.pandas_udf(StructType([StructField("code", StringType()), StructField("method", StringType())]))
def _python(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clean_python(c) if c is not None else (None, None) for c in x], columns=["code", "method"])


@F.pandas_udf(StringType())
def python_syntax(x: pd.Series) -> pd.Series:
    def one(code: str | None) -> str:
        try:
            ast.parse(code or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return "invalid"
        return "valid"

    return x.map(one)


def sanitized(df: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """``df`` with cleaned_code, sanitize_method, syntax_valid. Null code stays null, with status error.

    C++ and Java count as valid, with syntax_checked false: no compiler is called here, but by ``execute.compiled_syntax`` if it
    is allowed to. Unknown languages get a basic, unsafe cleaning and status skipped.
    """
    lang = F.lower(F.coalesce(language, F.lit("")))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv]), lang), F.lit("other"))
    c = F.col(code)
    rows = df.withColumn("_kind", kind).withColumn("_py", _python(F.when(F.col("_kind") == "python", c)))
    python = scrub_author(F.col("_py.code"), "python")
    cleaned = F.when(F.col("_kind") == "python", python)
    for k in ("cpp", "java"):
        cleaned = cleaned.when(F.col("_kind") == k, scrub_author(strip_c_comments(c, k), k))
    rows = rows.withColumn("cleaned_code", cleaned.otherwise(basic_clean(c)))
    method = F.when(F.col("_kind") == "python", F.col("_py.method")).when(F.col("_kind") == "other", "basic_unsafe").otherwise(F.concat("_kind", F.lit("_state_machine")))
    checked = python_syntax(F.when(F.col("_kind") == "python", F.col("cleaned_code")))
    status = F.when(c.isNull(), "error").when(F.col("_kind") == "other", "skipped").when(F.col("_kind") == "python", checked).otherwise("valid")
    checked = (F.col("_kind") == "python") & c.isNotNull()
    return rows.withColumns({"sanitize_method": method, "syntax_valid": status, "syntax_checked": checked}).drop("_kind", "_py")


def batch_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("sanitize_method", "syntax_valid").agg(F.count("*").alias("n"))


def tools() -> dict[str, bool]:
    """Which external programs are there on the driver."""
    return {t: shutil.which(t) is not None for t in ("python3", "g++", "clang-format", "javac", "java", "google-java-format")}
