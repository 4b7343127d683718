"""Refilling a deduplicated sample from candidates, least filled bin and problem first.

The choice is sequential, so it is made in one task over keys only, and what reaches it is
bounded by parameters: candidates known by content are removed by an anti-join, equal contents
are reduced to one, and of each bin only the first 2 x need rows in the order of
(count of the problem + place inside it) can ever be chosen. Places are numbered in many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pacekeeper.functions.bins import bin_index, bin_name
from pacekeeper.functions.text import code_hash
from pacekeeper.operators.dedup import drop_known
from pacekeeper.operators.pairs import number_in_groups
from pacekeeper.operators.sampling import SEED, draw


def choose(rows: list[tuple], bins: dict, counts: dict, need: int, cap: int | None, balanced: bool) -> list:
    """Keys chosen from rows (bin, problem, key) in order; bins and counts are the sample's so far."""
    queues: dict = {}
    for b, p, k in reversed(rows):
        queues.setdefault(b, {}).setdefault(p if balanced else None, []).append(k)
    counts, bins, out = dict(counts), dict(bins), []
    heaps = {b: [(counts.get(p, 0), str(p), p) for p in q] for b, q in queues.items()}
    for h in heaps.values():
        heapq.heapify(h)

    def take(b):
        """The key of the least counted problem of bin b that is below the cap."""
        h = heaps.get(b, [])
        while h:
            n, name, p = h[0]
            now = counts.get(p, 0)
            if not queues[b][p] or (cap is not None and balanced and now >= cap):
                heapq.heappop(h)
            elif now != n:
                heapq.heapreplace(h, (now, name, p))
            else:
                counts[p] = now + 1
                return queues[b][p].pop()
        return None

    while len(out) < need and bins:
        for b in sorted(bins, key=lambda b: (bins[b], str(b))):
            key = take(b)
            if key is not None:
                break
        else:
            b = next((x for x in sorted(queues, key=str) if x not in bins and any(queues[x].values())), None)
            key = take(b) if b is not None else None
            if key is None:
                break
            bins.setdefault(b, 0)
        bins[b] += 1
        out.append(key)
    return out


def replenish(kept: DataFrame, removed: DataFrame, candidates: DataFrame, target: int, bin_col: str, problem: str, key: str, src: str, tgt: str, balanced: bool = True, cap: int | None = None, seed: int = SEED) -> DataFrame:
    """Rows of ``candidates`` that fill ``kept`` up to ``target`` rows, as far as there are any."""
    need = target - kept.count()
    if need <= 0:
        return candidates.limit(0)
    fresh = drop_known(candidates, kept.select(src, tgt).unionByName(removed.select(src, tgt)), src, tgt)
    fresh = fresh.withColumns({"_h": draw(F.col(key), seed), "_src": code_hash(src), "_tgt": code_hash(tgt)})
    one = fresh.groupBy("_src", "_tgt").agg(F.min(F.struct("_h", F.col(key).alias("_k")))["_k"].alias(key))  # of equal contents one, aggregated and not brought together
    fresh = fresh.join(one, ["_src", "_tgt", key], "left_semi").drop("_src", "_tgt")
    counts = kept.groupBy(problem).agg(F.count("*").alias("_c"))
    placed = fresh.select(bin_col, problem, key, "_h").join(counts, problem, "left").withColumn("_c", F.coalesce("_c", F.lit(0)) if balanced else F.lit(0))
    inside = number_in_groups(placed, [bin_col, problem], ["_h", key], "_r") if balanced else placed.withColumn("_r", F.lit(0))
    few = number_in_groups(inside.withColumn("_p", F.col("_c") + F.col("_r")), [bin_col], ["_p", "_h", key], "_o").filter(F.col("_o") <= 2 * need)
    sizes = {r[0]: r[1] for r in kept.groupBy(bin_col).count().collect()}  # a row for each bin
    kinds = {f.name: f.dataType.simpleString() for f in fresh.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame(columns=[bin_col, problem, key, "_c", "_o"])])
        rows = rows.sort_values([bin_col, "_o"])
        start = dict(zip(rows[problem], rows["_c"])) if balanced else {}
        got = choose(list(zip(rows[bin_col], rows[problem], rows[key])), sizes, start, need, cap, balanced)
        yield pd.DataFrame({key: pd.Series(got, dtype="object"), "_place": range(len(got))})

    chosen = few.select(bin_col, problem, key, "_c", "_o").repartition(1).mapInPandas(run, f"{key} {kinds[key]}, _place long")
    return fresh.drop("_h").join(chosen, key).orderBy("_place").drop("_place")


def with_bin(df: DataFrame, bins: Sequence[float], name: str = "bin") -> DataFrame:
    """``df`` with ``_speedup`` and its bin, for candidates of either form.

    The speed-up is that of the row, or slow over fast time (slow_time and fast_time, or else src_agg_runtime and
    tgt_agg_runtime; an absent slow time is 0), and 1 where the fast time is no number above 0. Outside the bins the bin is null.
    """
    first = lambda names, last: F.coalesce(*[F.col(c).cast("string") for c in names if c in df.columns], F.lit(last))
    slow, fast = (first(names, "0").try_cast("double") for names in (("slow_time", "src_agg_runtime"), ("fast_time", "tgt_agg_runtime")))
    given = F.coalesce(*[F.col(c).try_cast("double") for c in ("speedup", "_speedup") if c in df.columns], F.lit(None).cast("double"))
    out = df.withColumn("_speedup", F.coalesce(given, F.when(fast > 0, slow / fast), F.lit(1.0)))
    return out.withColumn(name, bin_name(bin_index(F.col("_speedup"), bins), bins))


def refilled(kept: DataFrame, removed: DataFrame, candidates: DataFrame, target: int, bin_col: str, problem: str, key: str, src: str, tgt: str, **how) -> DataFrame:
    """The final sample: ``kept`` and what fills it up, with ``refilled`` telling them apart."""
    fill = replenish(kept, removed, candidates, target, bin_col, problem, key, src, tgt, **how)
    return kept.withColumn("refilled", F.lit(False)).unionByName(fill.withColumn("refilled", F.lit(True)), allowMissingColumns=True)
