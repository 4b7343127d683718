"""Speed-up, bins and difficulty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Default bin edges of sampling and of evaluation.
SAMPLING_BINS = (1.5, 2.0, 4.0, 8.0, 16.0, float("inf"))
DIFFICULTY_BINS = (2.0, 4.0, 8.0, float("inf"))
DIFFICULTIES = ("hard", "medium", "easy")


def parse_bins(spec: str) -> tuple[float, ...]:
    """Sorted edges of a comma-separated list; ``inf`` is allowed."""
    return tuple(sorted(float(x) for x in spec.split(",")))


def bin_label(low: float, high: float) -> str:
    return f"[{low}x, inf)" if high == float("inf") else f"[{low}x, {high}x)"


def labels(bins: Sequence[float]) -> list[str]:
    return [bin_label(a, b) for a, b in zip(bins, bins[1:])]


def _between(x: Column, low: float, high: float) -> Column:
    return (x >= low) if high == float("inf") else (x >= low) & (x < high)


def bin_index(x: Column, bins: Sequence[float]) -> Column:
    """Index of the bin [b_i, b_i+1); null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(bins) - 1)):
        out = F.when(_between(x, bins[i], bins[i + 1]), i).otherwise(out)
    return out


def bin_name(index: Column, bins: Sequence[float]) -> Column:
    return F.try_element_at(F.array(*map(F.lit, labels(bins))), index + 1)


def speedup(given: Column | None, slow: Column, fast: Column) -> Column:
    """The given value if there is one (a value that is no number rejects the row), else slow over fast; null rejects."""
    ratio = F.when(fast.try_cast("double") > 0, F.try_divide(slow.try_cast("double"), fast.try_cast("double")))
    if given is None:
        return ratio
    return F.when(given.isNotNull(), given.try_cast("double")).otherwise(ratio)


def difficulty(x: Column) -> Column:
    return F.when(x >= 8, "easy").when(x >= 4, "medium").otherwise("hard")


def evaluation_bin(x: Column) -> Column:
    """struct(label, idx) with bins from 2 up; below_threshold from 1 up to 2; empty below 1."""
    label, idx = F.when(x >= 1, "below_threshold").otherwise(""), F.lit(-1)
    for i, (low, high) in enumerate(zip(DIFFICULTY_BINS, DIFFICULTY_BINS[1:])):
        name = f"{DIFFICULTIES[i]} [≥{low}x]" if high == float("inf") else f"{DIFFICULTIES[i]} [{low}x-{high}x)"
        label = F.when(_between(x, low, high), name).otherwise(label)
        idx = F.when(_between(x, low, high), i).otherwise(idx)
    return F.struct(label.alias("label"), idx.alias("idx"))
