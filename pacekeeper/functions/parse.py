"""Parsers of model answers, as expressions.

``late`` parsers look at the last line first, ``early`` ones at the first line.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pacekeeper.functions.text import strip

_TOKEN = r"(FASTER|SLOWER|[-+]?\d+\.?\d*)"
_LABEL = r"(FASTER|SLOWER)"
_NUMBER = r"[-+]?\d+\.?\d*"


def _body(x: Column | str) -> Column:
    return strip(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))


def _last_line(body: Column) -> Column:
    return strip(F.element_at(F.split(body, "\n", -1), -1))


def _first_line(body: Column) -> Column:
    return strip(F.element_at(F.split(body, "\n", -1), 1))


def _number(s: Column) -> Column:
    """Python's ``2.`` is a number too."""
    return F.regexp_replace(s, r"\.$", "").try_cast("double")


def _last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _places(t: Column) -> Column:
    """Start of each found token: what lies before it, gaps and tokens."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, g: n + F.length(g))
    return F.transform(t["found"], lambda v, i: F.struct((total(F.slice(t["gaps"], 1, i + 1)) + total(F.slice(t["found"], 1, i))).alias("p"), v.alias("v")))


def _nearest(t: Column) -> Column:
    """The label with the number nearest after it; of equal ones the first number."""
    pairs = F.transform(t["numbers"], lambda n, i: F.transform(F.filter(t["labels"], lambda d: d["p"] < n["p"]), lambda d: F.struct((n["p"] - d["p"]).alias("far"), i.alias("i"), d["v"].alias("d"), n["v"].alias("v"))))
    return F.array_min(F.flatten(pairs))


def format_late(x: Column | str) -> Column:
    """struct(direction, value): FASTER or SLOWER with the number nearest after it, on the last line."""
    is_label = lambda t: t["v"].isin("FASTER", "SLOWER")

    def result(t: Column) -> Column:
        none, last = F.size(t["labels"]) == 0, _last(t["labels"])["v"]
        anywhere = _last(F.regexp_extract_all(t["upper"], F.lit(_LABEL), F.lit(1)))
        number = F.coalesce(t["near"]["v"], _last(t["numbers"])["v"])
        return F.struct(F.when(none, anywhere).otherwise(F.coalesce(t["near"]["d"], last)).alias("direction"), F.when(~none, _number(number)).alias("value"))

    def nearest(t: Column) -> Column:
        return _let(F.struct(t["upper"], t["labels"], t["numbers"], _nearest(t).alias("near")), result)

    def split(t: Column) -> Column:
        sides = lambda m: F.struct(t["upper"].alias("upper"), F.filter(m, is_label).alias("labels"), F.filter(m, lambda v: ~is_label(v)).alias("numbers"))
        return _let(_let(_places(t), sides), nearest)

    def tokens(t: Column) -> Column:
        return _let(F.struct(t["upper"].alias("upper"), F.regexp_extract_all(t["line"], F.lit(_TOKEN), F.lit(1)).alias("found"), F.split(t["line"], _TOKEN, -1).alias("gaps")), split)

    return _let(_body(x), lambda b: _let(F.struct(F.upper(b).alias("upper"), F.upper(_last_line(b)).alias("line")), tokens))


def format_early(x: Column | str) -> Column:
    """struct(direction, value) from the start of the first line, else from the first label anywhere."""
    first = lambda s: F.try_element_at(F.regexp_extract_all(s, F.lit(rf"({_NUMBER})"), F.lit(1)), F.lit(1))

    def result(t: Column) -> Column:
        start = F.upper(F.regexp_extract(t["line"], rf"(?i)^{_LABEL}", 1))
        direct = F.regexp_extract(t["line"], rf"(?i)^{_LABEL}\s+({_NUMBER})", 2)
        behind = first(F.regexp_replace(t["line"], rf"(?i)^{_LABEL}", ""))
        other = F.regexp_extract(t["upper"], _LABEL, 1)
        at = F.least(*[F.when(F.locate(w, t["upper"]) > 0, F.locate(w, t["upper"])) for w in ("FASTER", "SLOWER")])
        after = first(F.substring(t["body"], at + F.lit(6), F.lit(20)))
        value = F.when(start != "", F.coalesce(F.nullif(direct, F.lit("")), behind)).when(other != "", after)
        return F.struct(F.when(start != "", start).when(other != "", other).alias("direction"), _number(value).alias("value"))

    return _let(_body(x), lambda b: _let(F.struct(b.alias("body"), F.upper(b).alias("upper"), _first_line(b).alias("line")), result))


def _pick(text: Column, late: bool) -> Column:
    """A or B, whichever comes last (or first); null if neither is there."""
    seen = F.reverse(text) if late else text
    a, b = F.locate("A", seen), F.locate("B", seen)
    return F.when((a > 0) & ((b == 0) | (a < b)), "A").when(b > 0, "B")


def letter_late(x: Column | str) -> Column:
    body = _body(x)
    return F.coalesce(_pick(F.upper(_last_line(body)), True), _pick(F.upper(body), True))


def letter_early(x: Column | str) -> Column:
    body = _body(x)
    return F.coalesce(_pick(F.upper(_first_line(body)), False), _pick(F.upper(body), False))


def answer(x: Column | str, triple: bool = False) -> Column:
    """A, B, (C,) SIMILAR; PARSE_FAILED or, for an empty response, UNKNOWN. Only the last line counts."""
    body = _body(x)
    line = _last_line(body)
    found = F.upper(F.regexp_extract(line, r"(?i)\*?\*?(?:Answer|答案)[：:\s]*([ABC]|Similar|差不多)\*?\*?", 1))
    found = F.when(found == "差不多", "SIMILAR").otherwise(found)
    bare = F.translate(F.upper(line), "*.: ", "")
    got = F.when(found != "", found).when(bare.isin("A", "B", "C"), bare).otherwise("PARSE_FAILED")
    if not triple:
        got = F.when(got == "C", "PARSE_FAILED").otherwise(got)
    return F.when(body == "", "UNKNOWN").otherwise(got)


def is_correct(predicted: Column, expected: Column) -> Column:
    """Equal and both there; an empty string is not there."""
    return F.coalesce((predicted == expected) & (predicted != ""), F.lit(False))


def expected_letter(direction: Column | str) -> Column:
    d = F.col(direction) if isinstance(direction, str) else direction
    return F.when(d == "forward", "B").otherwise("A")
