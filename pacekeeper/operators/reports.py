"""Reports as text: tables for a console, and the summary of how a data set came about.

Only small frames are formatted: aggregates by bin, group or file, read to a stated number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

WIDTH = 72


def table_text(df: DataFrame, columns: Sequence[str] | None = None, most: int = 1000) -> str:
    """Aligned columns with a head; numbers to the right, rates with two decimals."""
    names = list(columns or df.columns)
    shown = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    rows = df.select(*names).limit(most).collect()
    cells = [names, *[[shown(v) for v in r] for r in rows]]
    wide = [max(len(r[i]) for r in cells) for i in range(len(names))]
    right = [bool(rows) and all(v is None or isinstance(v, (int, float)) and not isinstance(v, bool) for v in (r[i] for r in rows)) for i in range(len(names))]
    lines = ["  ".join(c.rjust(w) if n else c.ljust(w) for c, w, n in zip(r, wide, right)).rstrip() for r in cells]
    return "\n".join([lines[0], "-" * max(map(len, lines)), *lines[1:]])


def summary_text(title: str, numbers: Mapping[str, object], tables: Mapping[str, DataFrame], most: int = 1000) -> str:
    """A title, one line for each number, and a table under each heading."""
    parts = ["=" * WIDTH, title, "=" * WIDTH, *[f"{k}: {v}" for k, v in numbers.items()]]
    for head, df in tables.items():
        parts += ["", f"[{head}]", table_text(df, most=most)]
    return "\n".join([*parts, ""])


def dataset_report(n_sampled: int, n_deduplicated: int, n_refilled: int, bins: DataFrame, details: DataFrame | None = None) -> str:
    """What sampling, deduplication and refilling left, rows by bin, and the groups that lost most rows."""
    removed, final = n_sampled - n_deduplicated, n_deduplicated + n_refilled
    numbers = {"sampled": n_sampled, "after deduplication": n_deduplicated, "removed": removed, "refilled": n_refilled, "final": f"{final} = {n_sampled} - {removed} + {n_refilled}"}
    return summary_text("Data set report", numbers, {"rows by bin": bins, **({"groups with most duplicates": details} if details is not None else {})})
