"""Seeded stratified sampling.

Randomness is the order of md5(seed:key), which any engine can repeat. Bins are few, so bin
sizes and targets are driver values; rows are never collected. The ``n`` least hashes of a bin
are found by a histogram of ranges: ranges that fit into the target are taken as they are, and
only rows of the range in which it ends are ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pacekeeper.operators.pairs import number_rows
from pacekeeper.sources.scratch import keep

SEED = 42


def draw(key: Column, seed: int = SEED, *more: str) -> Column:
    return F.md5(F.concat(F.lit(":".join([str(seed), *more]) + ":"), key.cast("string")))


def uniform(key: Column, seed: int = SEED, *more: str) -> Column:
    """In (0, 1): 48 bits of the hash."""
    return (F.conv(F.substring(draw(key, seed, *more), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def bin_sizes(df: DataFrame, bin_col: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(bin_col).count().collect() if r[0] is not None}


def bin_targets(sizes: Mapping, total: int) -> dict:
    """Equal shares, the remainder to the lowest bins, none above its size."""
    there = sorted(b for b, n in sizes.items() if n)
    if not there:
        raise ValueError("no bin has rows")
    each, rest = divmod(total, len(there))
    return {b: min(each + (i < rest), sizes[b]) for i, b in enumerate(there)}


def _hash_range(c: Column | str) -> Column:
    """One of 4096 ranges of a hex hash."""
    return F.conv(F.substring(c if isinstance(c, Column) else F.col(c), 1, 3), 16, 10).cast("int")


def _cost_range(cost: Column | str) -> Column:
    """Range of a number of 0 or more; ranges grow with it, 1.1% each."""
    return F.floor(F.log2((F.col(cost) if isinstance(cost, str) else cost) + 1e-6) * 64).cast("int")


def lowest(df: DataFrame, bins: Sequence[str], order: Sequence[Column | str], targets: DataFrame, part: Column | None = None) -> DataFrame:
    """The first ``_target`` rows of each bin in the order; ``part`` is a range of the first order column, by default a hex hash."""
    marked = df.withColumn("_range", _hash_range(order[0]) if part is None else part)
    sizes = marked.groupBy(*bins, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*bins).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ranges = sizes.withColumn("_before", before).join(targets, list(bins)).filter(F.col("_before") < F.col("_target"))
    near = marked.join(F.broadcast(open_ranges), [*bins, "_range"]).withColumn("_left", F.col("_target") - F.col("_before"))  # rows by bin and range
    whole = near.filter(F.col("_n") <= F.col("_left")).withColumn("_rank", F.lit(0))
    rank = F.row_number().over(W.partitionBy(*bins).orderBy(*order))  # one range of each bin
    edge = near.filter(F.col("_n") > F.col("_left")).withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_left"))
    return whole.unionByName(edge).select(*df.columns)


def _frame(df: DataFrame, bin_col: str, targets: Mapping) -> DataFrame:
    kind = df.schema[bin_col].dataType.simpleString()
    return df.sparkSession.createDataFrame(list(targets.items()), f"{bin_col} {kind}, _target long")


def sample_natural(df: DataFrame, bin_col: str, key: str, targets: Mapping, seed: int = SEED) -> DataFrame:
    marked = df.withColumn("_h", draw(F.col(key), seed))
    return lowest(marked, [bin_col], ["_h", key], _frame(df, bin_col, targets)).drop("_h")


def sample_weighted(df: DataFrame, bin_col: str, key: str, value: str, targets: Mapping, seed: int = SEED) -> DataFrame:
    """Without replacement by weights exp(-z^2 / 2) of log2(value): order by -ln(u) / weight, rounded so that engines agree."""
    stats = df.groupBy(bin_col).agg(F.avg(F.log2(value)).alias("_mean"), F.stddev_pop(F.log2(value)).alias("_std"))
    z = F.when(F.col("_std") < 1e-6, 0.0).otherwise((F.log2(value) - F.col("_mean")) / F.col("_std"))
    cost = F.round(-F.ln(uniform(F.col(key), seed)) / F.exp(-0.5 * z * z), 6)
    marked = df.join(F.broadcast(stats), bin_col).withColumn("_cost", cost)
    return lowest(marked, [bin_col], ["_cost", key], _frame(df, bin_col, targets), _cost_range("_cost")).drop("_mean", "_std", "_cost")


def sub_bins(df: DataFrame, bin_col: str, value: str, n: int) -> DataFrame:
    """``_sub``: equal-width part of the bin's range of values; one part if the range is below 1e-6."""
    edges = df.groupBy(bin_col).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    part = F.when(F.col("_hi") - F.col("_lo") < 1e-6, 0).otherwise(F.floor((F.col(value) - F.col("_lo")) / ((F.col("_hi") + 1e-6 - F.col("_lo")) / n)))
    return df.join(F.broadcast(edges), bin_col).withColumn("_sub", F.least(part, F.lit(n - 1)).cast("int")).drop("_lo", "_hi")


def sample_uniform(df: DataFrame, bin_col: str, key: str, value: str, targets: Mapping, n_sub: int = 10, seed: int = SEED) -> DataFrame:
    """Equal quotas of the bin's sub-bins, then a top-up from rows whose key is not drawn yet."""
    marked = keep(sub_bins(df, bin_col, value, n_sub).withColumn("_h", draw(F.col(key), seed)), "sub-bins")
    quotas = [(b, s, t // n_sub + (s < t % n_sub)) for b, t in targets.items() for s in range(n_sub)]
    kind = df.schema[bin_col].dataType.simpleString()
    first = keep(lowest(marked, [bin_col, "_sub"], ["_h", key], df.sparkSession.createDataFrame(quotas, f"{bin_col} {kind}, _sub int, _target long")), "quota")
    got = bin_sizes(first, bin_col)
    need = {b: t - got.get(b, 0) for b, t in targets.items() if t > got.get(b, 0)}
    if not need:
        return first.drop("_h", "_sub")
    rest = marked.join(first.select(bin_col, key), [bin_col, key], "left_anti")
    return first.unionByName(lowest(rest, [bin_col], ["_h", key], _frame(df, bin_col, need))).drop("_h", "_sub")


def _balanced_stage(rows: DataFrame, problem: str, key: str, counts: DataFrame, target: int, cap: int | None, seed: int) -> DataFrame:
    """One stage: round r gives every problem its r-th row, in the order of counts before the stage."""
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(problem).orderBy("_h", key)))
    ranked = ranked.join(counts, problem, "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    if cap is not None:
        ranked = ranked.filter(F.col("_c") + F.col("_r") <= cap)
    tie = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(problem).cast("string"), F.col("_r").cast("string")))
    numbered = number_rows(ranked.withColumn("_tie", tie), ["_r", "_c", "_tie", problem])
    return numbered.filter(F.col("_no") <= target).drop("_r", "_c", "_tie", "_no")


def sample_balanced(df: DataFrame, bin_col: str, problem: str, key: str, targets: Mapping, value: str | None = None, distribution: str = "natural", cap: int | None = None, n_sub: int = 10, seed: int = SEED) -> DataFrame:
    """Bins smallest first, each drawing evenly from problems, with counts carried from stage to stage.

    A bin with no more rows than its target is taken whole, whatever the cap.
    """
    h = draw(F.col(key), seed)
    if distribution == "normal":
        stats = df.groupBy(bin_col).agg(F.avg(F.log2(value)).alias("_m"), F.stddev_pop(F.log2(value)).alias("_s"))
        z = F.when(F.col("_s") < 1e-6, 0.0).otherwise((F.log2(value) - F.col("_m")) / F.col("_s"))
        cost = F.round(-F.ln(uniform(F.col(key), seed)) / F.exp(-0.5 * z * z), 6)
        marked = df.join(F.broadcast(stats), bin_col).withColumn("_h", F.format_string("%024.6f", cost)).drop("_m", "_s")
    else:
        marked = df.withColumn("_h", h)
    marked = keep(sub_bins(marked, bin_col, value, n_sub) if distribution == "uniform" else marked.withColumn("_sub", F.lit(0)), "balanced")
    sizes = bin_sizes(marked, bin_col)
    done: list[DataFrame] = []

    def counts() -> DataFrame:
        if not done:
            return marked.groupBy(problem).agg(F.lit(0).alias("_c")).limit(0)
        return reduce(DataFrame.unionByName, done).groupBy(problem).agg(F.count("*").alias("_c"))

    for b in sorted(targets, key=lambda b: (sizes[b], b)):
        rows, target = marked.filter(F.col(bin_col) == F.lit(b)), targets[b]
        if sizes[b] <= target:
            done.append(keep(rows, "stage"))
            continue
        if distribution != "uniform":
            done.append(keep(_balanced_stage(rows, problem, key, counts(), target, cap, seed), "stage"))
            continue
        got, parts = 0, []
        for s in range(n_sub):
            quota = target // n_sub + (s < target % n_sub)
            part = keep(_balanced_stage(rows.filter(F.col("_sub") == s), problem, key, counts(), quota, cap, seed), "stage")
            done.append(part)
            parts.append(part)
            got += part.count()
        if got < target:
            rest = rows.join(reduce(DataFrame.unionByName, parts).select(key), key, "left_anti")
            done.append(keep(_balanced_stage(rest, problem, key, counts(), target - got, cap, seed), "stage"))
    return reduce(DataFrame.unionByName, done).drop("_h", "_sub")


def shuffled(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    return df.orderBy(draw(F.col(key), seed), key)


def pick_per_group(df: DataFrame, group: str, key: str, most: int, restore: Sequence[str] = ()) -> DataFrame:
    """At most ``most`` rows of each group, chosen by md5(group:key), in the order ``restore``."""
    h = F.md5(F.concat_ws(":", F.col(group).cast("string"), F.col(key).cast("string")))
    out = df.withColumn("_rank", F.row_number().over(W.partitionBy(group).orderBy(h, key))).filter(F.col("_rank") <= most).drop("_rank")
    return out.orderBy(group, *restore) if restore else out


def pick_share(df: DataFrame, group: str, key: str, share: float, most: int) -> DataFrame:
    """min(max(1, int(size x share)), most, size) rows of each group, chosen by md5(group:key)."""
    w = W.partitionBy(group)
    h = F.md5(F.concat_ws(":", F.col(group).cast("string"), F.col(key).cast("string")))
    n = F.least(F.greatest(F.floor(F.count("*").over(w) * share), F.lit(1)), F.lit(most))
    return df.withColumn("_n", n).withColumn("_rank", F.row_number().over(w.orderBy(h, key))).filter(F.col("_rank") <= F.col("_n")).drop("_n", "_rank")


def bin_report(df: DataFrame, sampled: DataFrame, bin_col: str, targets: Mapping, labels: Sequence[str]) -> DataFrame:
    """Every bin with its original, sampled and target number; bins without rows have zeros."""
    dim = df.sparkSession.createDataFrame([(i, name, int(targets.get(i, 0))) for i, name in enumerate(labels)], f"{bin_col} int, label string, target long")
    count = lambda d, n: d.groupBy(bin_col).agg(F.count("*").alias(n))
    return F.broadcast(dim).join(count(df, "original"), bin_col, "left").join(count(sampled, "sampled"), bin_col, "left").fillna(0, ["original", "sampled"])


def bins_of_two(first: DataFrame, second: DataFrame, label: str, names: Sequence[str] = ("sampled", "final")) -> DataFrame:
    """Numbers of rows in both frames for each label that either has, in the order of labels; rows without one are ``unknown``."""
    count = lambda d, n: d.groupBy(F.coalesce(F.col(label), F.lit("unknown")).alias(label)).agg(F.count("*").alias(n))
    return count(first, names[0]).join(count(second, names[1]), label, "full").fillna(0, list(names)).orderBy(label)


def jitter(key: Column, seed: int = SEED, width: float = 0.35) -> Column:
    """A number between -``width`` and ``width`` for a scatter plot, the same for the same key."""
    return (uniform(key, seed, "jitter") * 2 - 1) * width
