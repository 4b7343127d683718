"""Connected components by randomised contraction over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pacekeeper.sources.scratch import keep


def components(edges: DataFrame, seed: int = 1) -> DataFrame:
    """node, root for every node of the edges (a, b), both longs.

    Each round a node joins the neighbour of least random priority (itself included), parents are
    jumped once, edges are renamed and deduplicated. A round leaves a constant fraction of the
    nodes in expectation, so rounds grow as the logarithm; no group is collected anywhere.
    """
    edges, labels, k = keep(edges, "edges"), None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(c, F.lit(seed + k))  # noqa: B023, E731
        nearest = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"), F.min(rank("b")).alias("r"))
        parent = keep(nearest.select(F.col("a").alias("node"), F.when(F.col("r") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("up")), "parent")
        jumped = parent.alias("p").join(parent.alias("q"), F.col("p.up") == F.col("q.node")).select(F.col("p.node").alias("node"), F.col("q.up").alias("up"))
        jumped = keep(jumped, "jumped")
        ends = [jumped.select(F.col("node").alias(c), F.col("up").alias(f"u{c}")) for c in ("a", "b")]
        renamed = edges.join(ends[0], "a").join(ends[1], "b").filter("ua <> ub")
        if labels is None:
            labels = jumped.select("node", F.col("up").alias("root"))
        else:
            later = jumped.select(F.col("node").alias("root"), F.col("up").alias("next"))
            labels = keep(labels.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        edges = keep(renamed.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        k += 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
