"""Line deduplication by a suffix array over line-ID sequences, built by distributed prefix doubling.

Every line has an identifier, its SHA-256. Equal texts are one sequence of identifiers. Suffixes
are ranked by their first line, then by pairs of ranks (of a suffix and of the one h lines on) for
h = 1, 2, 4 ... A round is a shuffle by text, which brings the pairs together, and a range sort of
pairs; a rank is the place of the first suffix of that pair in the whole order. A suffix that
equals no other, or that ends with its text, leaves the rounds, which end when none is left.

Neighbours in that order which agree in rank after h lines have a common prefix of h lines or
more; the greatest such h is kept with the suffix. The intervals of neighbours with a common
prefix of h lines are the runs of h lines that stand in several places. A run is repeated if it has
``least`` lines, or ``least_words`` words even in fewer lines. Every copy of it but the first is
deleted; a maximal repeated run is the union of its overlapping intervals.

The order is (doc_id, line), so the first suffix of an interval is its first copy. Places are part
of the sort key, so a line that a third of all rows have is sorted in many tasks; only the rank and
first place of the interval that reaches over the edge of a task go through the driver (one row for
a task). Texts with very many copies are told from the others by a broadcast of fewer than 1,000 names.

Edge cases: null and empty texts are one empty line; a null doc_id comes last; rows with one
doc_id stand at the same place line by line, so repeated rows do not delete each other, while the
same run further on in another text of that doc_id is a later copy; an empty table gives an empty
result. Input columns other than key and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pacekeeper.llm.base import HEAVY, Scratch, arrow_map, sieve

LEAST_LINES, LEAST_WORDS = 3, 50
_LAST = 2**63 - 1
_WORDS = r"[^\x20\x09-\x0D]+"
_SUFFIX = "doc long, t0 long, t1 long, line int, words int"


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, text, doc (its place) and t0, t1 (128 bits of the text's SHA-256)."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    place = F.col(key).cast("long")
    return docs.select(place.alias("doc_id"), F.col(text).alias("text"), F.coalesce(place, F.lit(_LAST)).alias("doc"), half(1).alias("t0"), half(17).alias("t1"))


def _lines(named: DataFrame) -> DataFrame:
    """doc (first with the text), t0, t1, line, words, l0, l1 (identifier) of each line of each different text, and copies of the text."""

    def run(batch: pa.RecordBatch):
        ids, words, sizes = [], [], []
        for t in batch.column(0).to_pylist():
            lines = (t or "").encode().split(b"\n")
            ids += [hashlib.sha256(x).digest()[:16] for x in lines]
            words += [len(x.split()) for x in lines]
            sizes.append(len(lines))
        row = np.repeat(np.arange(len(sizes)), sizes)
        line = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        doc, t0, t1 = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (1, 2, 3))
        pair = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
        yield {"doc": pa.array(doc), "t0": pa.array(t0), "t1": pa.array(t1), "line": pa.array(line.astype(np.int32)), "words": pa.array(words, pa.int32()), "l0": pa.array(pair[:, 0]), "l1": pa.array(pair[:, 1])}

    found = arrow_map(named.select("text", "doc", "t0", "t1"), run, f"{_SUFFIX}, l0 long, l1 long", 256)
    return found.groupBy("t0", "t1", "line", "words", "l0", "l1").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"), F.count("*").alias("copies"))


def _stream(n_keys: int):
    """Over rows (keys, doc, t0, t1, line, words, pid) in order of keys and place: adds the row at which the row's group begins and its first place.

    Rows that are alone in their group are left out, but for those at the edges, whose group may reach into the next task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = None, 0  # the last row, its columns at, alone so far, first_doc, first_line

        def out(columns, at, alone, doc, line) -> pa.RecordBatch:
            names = [*(f"k{i}" for i in range(n_keys)), "doc", "t0", "t1", "line", "words", "pid", "at", "alone", "first_doc", "first_line"]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(at), pa.array(alone), pa.array(doc), pa.array(line)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held[0], columns)]
            keys, doc, line = columns[:n_keys], columns[n_keys], columns[n_keys + 3]
            new = np.ones(len(doc), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            start = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
            at, first_doc, first_line = start + count, doc[start], line[start]
            if held is not None:
                same = start == 0
                new[0] = held[2]
                at[same], first_doc[same], first_line[same] = held[1], held[3], held[4]
            alone = new.copy()
            alone[:-1] &= new[1:]
            keep = ~alone | (at == 0)
            keep[-1] = False
            yield out([c[keep] for c in columns], at[keep], alone[keep], first_doc[keep], first_line[keep])
            held = ([c[-1:] for c in columns], at[-1], bool(new[-1]), first_doc[-1], first_line[-1])
            count += len(doc) - 1
        if held is not None:
            yield out(held[0], *(np.array([v]) for v in (held[1], held[2], held[3], held[4])))

    return run


def _ranked(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """doc, t0, t1, line, words, rank and later (not the first place) of the rows whose keys others have too."""
    cols = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    order = [*names, "doc", "line", "t0", "t1"]
    dealt = rows.select(*cols, "doc", "t0", "t1", "line", "words").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"{', '.join(f'{k} long' for k in names)}, {_SUFFIX}, pid int, at long, alone boolean, first_doc long, first_line int"
    placed = scratch.keep(dealt.withColumn("pid", F.spark_partition_id()).mapInArrow(_stream(len(keys)), schema), name)
    group = F.struct("at", *names, "first_doc", "first_line")
    fixes, base, before = [], 0, None
    for r in placed.groupBy("pid").agg(F.min(group).alias("low"), F.max(group).alias("high")).orderBy("pid").collect():  # a row for each task
        low, high = r["low"], r["high"]
        goes_on = before is not None and before[0] == [low[k] for k in names]
        if goes_on:
            fixes[-1][7] = True
        first = before[1] if goes_on else (base, low["first_doc"], low["first_line"])
        fixes.append([r["pid"], base, *first, goes_on, high["at"], False])
        before = ([high[k] for k in names], first if high["at"] == 0 else (base + high["at"], high["first_doc"], high["first_line"]))
        base += high["at"] + 1
    kinds = (("pid", pa.int32()), ("base", pa.int64()), ("low_rank", pa.int64()), ("low_doc", pa.int64()), ("low_line", pa.int32()), ("low_on", pa.bool_()), ("high_at", pa.int64()), ("high_on", pa.bool_()))
    told = placed.sparkSession.createDataFrame(pa.table({k: pa.array([f[i] for f in fixes], t) for i, (k, t) in enumerate(kinds)}))
    joined = placed.join(F.broadcast(told), "pid")
    low = F.col("at") == 0
    alone = F.col("alone") & ~(low & F.col("low_on")) & ~((F.col("at") == F.col("high_at")) & F.col("high_on"))
    first = [F.when(low, F.col(a)).otherwise(F.col(b)) for a, b in (("low_doc", "first_doc"), ("low_line", "first_line"))]
    later = (F.col("doc") != first[0]) | (F.col("line") != first[1])
    return joined.filter(~alone).select("doc", "t0", "t1", "line", "words", F.when(low, F.col("low_rank")).otherwise(F.col("base") + F.col("at")).alias("rank"), later.alias("later"))


def _shifted(ranks: DataFrame, step: int) -> DataFrame:
    """``ranks`` whose text has a ranked suffix ``step`` lines on: with next (its rank) and the words of it added."""
    on = W.partitionBy("t0", "t1", "doc").orderBy("line").rangeBetween(step, step)
    return ranks.withColumns({"next": F.max("rank").over(on), "more": F.max("words").over(on)}).filter("next is not null")


def suffix_intervals(lines: DataFrame, scratch: Scratch, least: int, least_words: int) -> Iterator[tuple[int, DataFrame]]:
    """(h, frame of doc, t0, t1, line, words, rank, later): suffixes that share their first h lines with another, by their ranks.

    h is 1, 2, 4 ... until no suffix is left, and every number up to ``least``. ``words`` counts those of the h lines
    (and is not kept up beyond ``least``).
    """
    h, ranks = 1, _ranked(lines, ["l0", "l1"], scratch, "rank1")
    while not ranks.isEmpty():
        yield h, ranks
        for n in range(h + 1, min(least + 1, 2 * h)):
            # The first h and the last h of n lines: the words between are counted once.
            pairs = _shifted(ranks, n - h)
            yield n, _counted(_ranked(pairs, ["rank", "next"], scratch, f"rank{n}"), lines, n, least, least_words)
        pairs = _shifted(ranks, h).withColumn("words", F.col("words") + F.col("more"))
        ranks = _ranked(pairs, ["rank", "next"], scratch, f"rank{2 * h}")
        h *= 2


def _counted(ranks: DataFrame, lines: DataFrame, n: int, least: int, least_words: int) -> DataFrame:
    """``ranks`` with the words of n lines, which only runs shorter than ``least`` need."""
    if n >= least:
        return ranks
    on = W.partitionBy("t0", "t1").orderBy("line").rangeBetween(0, n - 1)
    total = lines.select("t0", "t1", "line", F.sum("words").over(on).cast("int").alias("words"))
    return ranks.drop("words").join(total.filter(F.col("words") >= least_words), ["t0", "t1", "line"]).select("doc", "t0", "t1", "line", "words", "rank", "later")


def repeated_runs(docs: DataFrame, least: int = LEAST_LINES, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """t0, t1 (name of a text), first (least doc_id with it), copies, and runs (line, lines): windows of it that have an earlier copy."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(_lines(_named(docs, key, text)), "lines")
    none = F.lit(None).cast("struct<line:int,lines:int>")
    found = lines.filter("line = 0 and copies > 1").select("t0", "t1", F.col("doc").alias("first"), "copies", none.alias("run"))
    for h, level in suffix_intervals(lines, scratch, least, least_words):
        counts = level.filter("later" if h >= least else F.col("later") & (F.col("words") >= least_words))
        found = found.unionByName(counts.select("t0", "t1", F.col("doc").alias("first"), F.lit(1).cast("long").alias("copies"), F.struct("line", F.lit(h).alias("lines")).alias("run")))
    # Of the windows that begin at one line the longest holds the others.
    longest = found.groupBy("t0", "t1", "first", F.col("run.line").alias("line")).agg(F.max("copies").alias("copies"), F.max("run").alias("run"))
    return longest.groupBy("t0", "t1").agg(F.min("first").alias("first"), F.max("copies").alias("copies"), F.collect_list("run").alias("runs"))


def line_dedup(docs: DataFrame, least: int = LEAST_LINES, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256, kept_text for every row."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    marks = scratch.keep(repeated_runs(docs, least, least_words, key, text), "marks")
    # Only texts with copies or marks move; of those with very many copies all but the first row need no mark.
    some, rest = sieve(_named(docs, key, text), marks, "t0")
    heavy = marks.filter((F.col("copies") > 1) & (F.col("copies") * HEAVY > docs.count())).select("t0", "t1", F.col("first").alias("heavy_first"))
    some = some.join(F.broadcast(heavy), ["t0", "t1"], "left")
    many = F.coalesce(F.col("doc") != F.col("heavy_first"), F.lit(False))
    # One shuffle for all of them, at every size: a join that is a broadcast while the marks are few would move texts from some size on only.
    few = some.filter(~many).join(marks.select("t0", "t1", "first", "runs").hint("merge"), ["t0", "t1"], "left")
    few = few.select("doc_id", "text", F.coalesce(F.col("doc") != F.col("first"), F.lit(False)).alias("copy"), "runs")
    # Of the others those that stay or go whole need no Python.
    body, lines = F.coalesce("text", F.lit("")), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n_lines = F.coalesce(lines, F.lit(1)).cast("long")
    enough = (n_lines >= least) | (F.size(F.regexp_extract_all(body, F.lit(_WORDS), F.lit(0))) >= least_words)

    def whole(df: DataFrame, gone: Column) -> DataFrame:
        kept = F.when(gone, "").otherwise(body)
        return df.select("doc_id", n_lines.alias("n_lines"), F.when(gone, n_lines).otherwise(F.lit(0).cast("long")).alias("n_removed"), F.when(gone, 1).otherwise(0).cast("long").alias("n_runs"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"), kept.alias("kept_text"))

    parts = [whole(rest, F.lit(False)), whole(some.filter(many), enough)]

    def finish(batch: pa.RecordBatch):
        rows = []
        for t, copy, runs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            lines = (t or "").split("\n")
            if copy:  # every window of it has an earlier copy
                runs = [{"line": 0, "lines": len(lines)}] if len(lines) >= least or len((t or "").encode().split()) >= least_words else []
            gone = bytearray(len(lines))
            n_runs, end = 0, -1
            for r in sorted(runs or (), key=lambda r: r["line"]):
                a, b = r["line"], r["line"] + r["lines"]
                n_runs += a > end
                end = max(end, b)
                gone[a:b] = b"\1" * (b - a)
            kept = "\n".join(x for x, g in zip(lines, gone) if not g)
            rows.append((len(lines), sum(gone), n_runs, hashlib.sha256(kept.encode()).hexdigest(), kept))
        columns = list(zip(*rows)) or [[]] * 5
        names = (("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_runs", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()))
        yield {"doc_id": batch.column(0), **{k: pa.array(c, kind) for (k, kind), c in zip(names, columns)}}

    out = arrow_map(few, finish, "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string, kept_text string", 512)
    return reduce(DataFrame.unionByName, parts, out)
