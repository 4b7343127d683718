"""Substring deduplication with run-length BWT indexes.

Every byte covered by a ``length``-byte string that also starts anywhere else goes.

Two equal windows of ``length`` bytes have the same minimizer (the least hash of the
``GRAM``-byte strings inside), so windows are dealt by minimizer: the maximal runs of
neighbouring windows with one minimizer ("pieces") are the unit. Equal pieces collapse to
one with a count before anything is indexed. Where different pieces share a minimizer, they
are put into a text of bounded size; of its Burrows-Wheeler transform only the runs, with
the suffix array sampled at the run ends, are kept. Inside a run the longest match of a suffix
shrinks by one from position to position, so the samples give all matching statistics of the
text against itself in one streaming pass; windows that match elsewhere for ``length`` bytes
or more are marked.

A minimizer whose different pieces exceed ``most`` is never put into one index: its windows
are dealt anew by halves of their distance to the minimizer, each half keyed by the bytes that
all of its windows share, until groups are small or a window stands alone (at most 9 rounds).

Edge cases: null is the empty text; texts shorter than ``length`` lose nothing; matches never
cross texts; equal texts of ``length`` bytes or more go whole; the number of equal rows counts,
so repeated rows remove each other. Empty tables give an empty result. Input columns other
than key and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pacekeeper.llm.base import HEAVY, Scratch, arrow_map, join_heavy, sieve, utf8

LENGTH, GRAM, LONGEST_PIECE, MOST, INDEX_BYTES = 400, 16, 1024, 1000, 1 << 19
_PACK = 7
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hashes(body: np.ndarray) -> np.ndarray:
    """64-bit hash of the 16 bytes at each position."""
    u = body.astype(np.uint64)
    for step in (1, 2, 4):
        u = u[:-step] | (u[step:] << np.uint64(8 * step))
    h = (u[:-8] * _A) ^ ((u[8:] ^ (u[8:] >> np.uint64(27))) * _B)
    h ^= h >> np.uint64(31)
    h *= _A
    return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    out, w = values, 1
    while 2 * w <= width:
        out = np.minimum(out[:-w], out[w:])
        w *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - w :]) if w < width else out


def pieces(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and number of windows of each piece of ``text``, and whether its minimizer occurs in it again."""
    none = np.empty(0, np.int64)
    if len(text) < length:
        return none.view(np.uint64), none, none, none.astype(bool)
    hashes = _gram_hashes(np.frombuffer(text, np.uint8))
    low = _least(hashes, length - GRAM + 1)
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.append(start, len(low)))
    if count.max() > LONGEST_PIECE:
        parts = -(-count // LONGEST_PIECE)
        offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, left = np.repeat(start, parts) + offset * LONGEST_PIECE, np.repeat(count, parts) - offset * LONGEST_PIECE
        count = np.minimum(left, LONGEST_PIECE)
    low = low[start]
    again = [np.count_nonzero(hashes[a : a + c + length - GRAM] == v) > 1 for a, c, v in zip(start.tolist(), count.tolist(), low)]
    return low, start, count, np.array(again)


class RunIndex:
    """Run-length BWT of a collection, with the suffix array at both ends of every run."""

    def __init__(self, bodies: list[bytes]) -> None:
        n = sum(map(len, bodies)) + len(bodies)
        self.marks = np.cumsum([len(b) + 1 for b in bodies]) - 1  # an end mark of its own for each body: no match crosses it
        self.text = np.frombuffer(b"\0".join([*bodies, b""]), np.uint8).astype(np.int64) + 1
        self.text[self.marks] = 0
        left = self.marks[np.searchsorted(self.marks, np.arange(n))] - np.arange(n)
        #: Seven bytes in one number, with nothing after an end mark.
        self.first = np.zeros(n, np.int64)
        for k in range(_PACK):
            self.first <<= 9
            self.first[: n - k] += np.where(left[: n - k] > k, self.text[k:], 0)
        sa = self._suffixes(left < _PACK)
        self.text[self.marks] = -np.arange(len(bodies))
        bwt = self.text[sa - 1]
        head = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        tail = np.append(head[1:], n) - 1
        self.symbols = bwt[head]
        self.heads, self.tails = sa[head], sa[tail]

    def _suffixes(self, short: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling from seven bytes on; ``short`` suffixes hold an end mark among them and so are unique."""
        n = len(self.text)
        order = np.argsort(self.first, kind="stable")
        rank, h = self._ranks(self.first[order], order, short), _PACK
        while rank.max() < n - 1:
            second = np.zeros(n, np.int64)
            second[:-h] = rank[h:] + 1
            pair = rank * np.int64(n + 1) + second
            order = np.argsort(pair)
            rank = self._ranks(pair[order], order)
            h *= 2
        return order

    @staticmethod
    def _ranks(values: np.ndarray, order: np.ndarray, unique: np.ndarray | None = None) -> np.ndarray:
        new = np.concatenate([[False], values[1:] != values[:-1]])
        if unique is not None:
            new[1:] |= unique[order[1:]] | unique[order[:-1]]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes a and b."""
        n, got, span = len(self.text), np.zeros(len(a), np.int64), np.arange(64)
        for lo in range(0, len(a), 8192):
            live = np.arange(lo, min(lo + 8192, len(a)))
            while len(live):
                i, j = (a[live] + got[live])[:, None] + span, (b[live] + got[live])[:, None] + span
                same = (self.text[np.minimum(i, n - 1)] == self.text[np.minimum(j, n - 1)]) & (np.maximum(i, j) < n)
                run = np.where(same.all(axis=1), 64, same.argmin(axis=1))
                got[live] += run
                live = live[run == 64]
        return got

    def matching(self, least: int) -> np.ndarray:
        """For each position, whether its longest match with another suffix reaches ``least``.

        The neighbour above (below) in suffix order of a position that is no run head (tail) is
        the successor of the neighbour of the position before, with one byte less in common. So
        samples whose match is below ``least`` stand for none.
        """
        n = len(self.text)
        a, b = self.heads[1:], self.tails[:-1]
        near = np.arange(len(a))
        for at in range(0, max(1, least - _PACK + 1), _PACK * 8):  # most pairs differ early
            near = near[(np.maximum(a[near], b[near]) + at < n)]
            near = near[self.first[a[near] + at] == self.first[b[near] + at]] if least - at >= _PACK else near
        common = np.zeros(len(a), np.int64)
        common[near] = self._common(a[near], b[near])
        best = np.zeros(n, bool)
        for own in (a, b):
            reach, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
            reach[own], at[own] = own + common, own
            np.maximum.accumulate(at, out=at)
            best |= reach[at] - np.arange(n) >= least
        return best


def _flags_to_spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def repeated_windows(bodies: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each of several different bodies, the ranges of windows that start elsewhere in them too."""
    flags = RunIndex(bodies).matching(length)
    out, at = [], 0
    for b in bodies:
        out.append(_flags_to_spans(flags[at : at + max(0, len(b) - length + 1)]))
        at += len(b) + 1
    return out


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_SPAN_SCHEMA = "array<struct<a:int,b:int>>"


def _spans(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in s] for s in found], _SPANS)


def _name(*parts: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(b"\0".join(parts))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _indexed(rows: DataFrame, length: int) -> DataFrame:
    """key, c1, c2, spans for rows (key, c1, c2, n, body) whose keys have few rows; indexes whole keys, several at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            found = repeated_windows([r[4] for r in rows], length)
            found = [[(0, len(r[4]) - length + 1)] if r[3] > 1 else f for r, f in zip(rows, found)]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*cols, _spans(found)], names=["key", "c1", "c2", "spans"])

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= INDEX_BYTES and held and held[-1][0] != r[0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield flush(held)

    return rows.select("key", "c1", "c2", "n", "body").repartition("key").sortWithinPartitions("key").mapInArrow(run, f"key long, c1 long, c2 long, spans {_SPAN_SCHEMA}")


def _halves(length: int, level: int) -> Callable[[pa.RecordBatch], Iterator[dict]]:
    """Cuts rows (key, c1, c2, n, body, least) into windows whose distance to the minimizer lies in one of 2^level ranges."""
    width = max(1, (1 << (length - 1).bit_length()) >> level)

    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("key", "c1", "c2", "n", "body", "least", "p0", "p1", "p2", "at")}
        for key, c1, c2, n, body, least in zip(*(batch.column(i).to_pylist() for i in range(6))):
            hashes = _gram_hashes(np.frombuffer(body, np.uint8)).view(np.int64)
            spots = np.flatnonzero(hashes == least)
            windows = np.arange(len(body) - length + 1)
            spot = spots[np.searchsorted(spots, windows)]
            part = (spot - windows) // width
            start = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (spot[1:] != spot[:-1])]))
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(windows)]):
                p, d = int(spot[a]), int(part[a])
                core = body[p - d * width : p - min((d + 1) * width - 1, length - GRAM) + length]
                piece = body[a : b - 1 + length]
                k, _ = _name(b"core", least.to_bytes(8, "little", signed=True), bytes([level]), d.to_bytes(4, "little"), core)
                x, y = _name(b"piece", piece)
                for name, v in zip(out, (k, x, y, n, piece, least, key, c1, c2, a)):
                    out[name].append(v)
        kinds = {"body": pa.binary(), "at": pa.int32()}
        yield {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}

    return run


def _solve(joined: DataFrame, scratch: Scratch, length: int, most: int, level: int = 1) -> DataFrame:
    """key, c1, c2, spans for written rows (key, c1, c2, n, body, least, again, _size), distinct in (key, c1, c2); ``_size`` counts the rows of the key."""
    # At one window a row has no equal but itself: nothing is left to compare.
    alone = F.expr("_size = 1 and not again") if (1 << level - 1) <= length else F.lit(True)
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.length("body") - length + 1).cast("int").alias("b")))
    done = joined.filter(alone & (F.col("n") > 1)).select("key", "c1", "c2", whole.alias("spans"))
    several = joined.filter(~alone & (F.col("_size") <= most))
    large = joined.filter(~alone & (F.col("_size") > most)).drop("_size")
    out = done.unionByName(_indexed(several, length))
    if large.isEmpty():
        return out
    cut = "key long, c1 long, c2 long, n long, body binary, least long, p0 long, p1 long, p2 long, at int"
    parts = scratch.keep(arrow_map(large.select("key", "c1", "c2", "n", "body", "least"), _halves(length, level), cut, 256), f"halves{level}")
    # Equal pieces of one parent piece stand at different places, so each counts.
    again = parts.groupBy("key", "c1", "c2").agg(F.sum("n").alias("n"), F.first("body").alias("body"), F.first("least").alias("least"), F.lit(False).alias("again"))
    again = scratch.keep(again, f"again{level}")
    sizes = scratch.keep(again.groupBy("key").agg(F.count("*").alias("_size")), f"sizes{level}")
    sized = scratch.keep(join_heavy(again, sizes, ["key"], sizes.filter(F.col("_size") * HEAVY > again.count())), f"sized{level}")
    solved = scratch.keep(_solve(sized, scratch, length, most, level + 1), f"solved{level}")
    back = parts.select("key", "c1", "c2", "p0", "p1", "p2", "at").join(solved, ["key", "c1", "c2"])
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b")))
    lifted = back.select(F.col("p0").alias("key"), F.col("p1").alias("c1"), F.col("p2").alias("c2"), moved.alias("spans"))
    return out.unionByName(lifted)


def marked_windows(docs: DataFrame, length: int = LENGTH, most: int = MOST, text: str = "text") -> DataFrame:
    """t1, t2 (name of a text), copies (rows with it) and spans (ranges of windows that also start elsewhere)."""
    scratch = Scratch(docs.sparkSession, "substrings")
    long_enough = docs.select(F.col(text).alias("text")).filter(F.octet_length("text") >= length)
    named = long_enough.select("text", *text_names("text"))

    def scan(batch: pa.RecordBatch):
        cols: dict[str, list] = {k: [] for k in ("key", "start", "count", "again", "t1", "t2")}
        names: list[tuple[int, int]] = []
        t1, t2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        for i, t in enumerate(utf8(batch.column(0))):
            low, start, count, again = pieces(t, length)
            names += [_name(b"piece", t[a : a + c - 1 + length]) for a, c in zip(start.tolist(), count.tolist())]
            for k, v in zip(cols, (low.view(np.int64), start, count, again, np.full(len(low), t1[i]), np.full(len(low), t2[i]))):
                cols[k].append(v)
        flat = {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in cols.items()}
        pair = np.array(names, np.int64).reshape(-1, 2)
        yield {"key": pa.array(flat["key"]), "c1": pa.array(pair[:, 0]), "c2": pa.array(pair[:, 1]), "t1": pa.array(flat["t1"]), "t2": pa.array(flat["t2"]), "at": pa.array(flat["start"].astype(np.int32)), "count": pa.array(flat["count"].astype(np.int32)), "again": pa.array(flat["again"].astype(bool))}

    found = arrow_map(named, scan, "key long, c1 long, c2 long, t1 long, t2 long, at int, count int, again boolean", 256)
    # Copies of a text collapse before they are written: one row for each text and piece.
    members = scratch.keep(found.groupBy("key", "c1", "c2", "t1", "t2", "at", "count", "again").agg(F.count("*").alias("n")), "members")
    distinct = members.groupBy("key", "c1", "c2").agg(F.sum("n").alias("n"), F.min("count").alias("count"), F.max("again").alias("again"), F.count("*").alias("texts"), F.min(F.struct("t1", "t2", "at")).alias("rep"))
    distinct = scratch.keep(distinct, "distinct")
    # A key with one piece, once in it, needs no index: that piece is carried along.
    one = F.min(F.struct("c1", "c2", "n", "count"))
    sizes = scratch.keep(distinct.groupBy("key").agg(F.count("*").alias("_size"), F.max("again").alias("any_again"), one.alias("one")), "sizes")
    plain = F.expr("_size = 1 and not any_again")
    many = sizes.filter(~plain).select("key", "_size")
    mixed = join_heavy(distinct, many, ["key"], many.filter(F.col("_size") * HEAVY > distinct.count())).select("key", "c1", "c2", "n", "count", "again", "_size", "rep.*")
    wanted = scratch.keep(mixed.groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "c1", "c2", "n", "at", "count", "again", "_size")).alias("wanted")), "wanted")
    bodies = sieve(named, wanted, "t1")[0].groupBy("t1", "t2").agg(F.first("text").alias("text")).join(wanted, ["t1", "t2"])

    def cut(batch: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("key", "c1", "c2", "n", "body", "least", "again", "_size")}
        kinds = {"body": pa.binary(), "again": pa.bool_()}
        for t, pieces_of in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
            for w in pieces_of:
                body = t[w["at"] : w["at"] + w["count"] - 1 + length]
                for k, v in zip(out, (w["key"], w["c1"], w["c2"], w["n"], body, w["key"], w["again"], w["_size"])):
                    out[k].append(v)
        yield {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}

    rows = scratch.keep(arrow_map(bodies.select("text", "wanted"), cut, "key long, c1 long, c2 long, n long, body binary, least long, again boolean, _size long", 128), "mixed")
    solved = _solve(rows, scratch, length, most)
    whole = sizes.filter(plain & (F.col("one.n") > 1)).select("key", "one.c1", "one.c2", F.array(F.struct(F.lit(0).alias("a"), F.col("one.count").alias("b"))).alias("spans"))
    marks = scratch.keep(solved.filter(F.size("spans") > 0).unionByName(whole), "marks")
    heavy = distinct.filter(F.col("texts") * HEAVY > members.count())
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b")))
    hit = join_heavy(members.select("key", "c1", "c2", "t1", "t2", "at", "n"), marks, ["key", "c1", "c2"], heavy).select("t1", "t2", "n", moved.alias("spans"))
    return scratch.keep(hit.groupBy("t1", "t2").agg(F.max("n").alias("copies"), F.flatten(F.collect_list("spans")).alias("spans")), "hit")


def text_names(text: str) -> list:
    """Two 64-bit names of a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), F.col(text), F.octet_length(text)).alias("t2")]


def remove_repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) for every row."""
    hit = marked_windows(docs, length, most, text)
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *text_names("text"))
    # Only texts with a mark move; of those with very many copies all windows are marked, so a name is enough.
    some, rest = sieve(plain, hit, "t1")
    heavy = F.broadcast(hit.filter((F.col("copies") > 1) & (F.col("copies") * HEAVY > docs.count())).select("t1", "t2"))
    many = some.join(heavy, ["t1", "t2"], "left_semi")
    few = some.join(heavy, ["t1", "t2"], "left_anti").join(hit.select("t1", "t2", "spans").hint("merge"), ["t1", "t2"], "left").select("doc_id", "text", "spans")
    # Of the others those that stay or go whole need no Python.
    body = F.coalesce("text", F.lit("")).cast("binary")
    size = F.octet_length(body).cast("long")

    def whole(df: DataFrame, gone: bool) -> DataFrame:
        kept = F.lit(b"") if gone else body
        return df.select("doc_id", size.alias("n_bytes"), (size if gone else F.lit(0).cast("long")).alias("n_removed"), F.lit(int(gone)).cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), kept.alias("kept"))

    parts = [whole(rest, False), whole(many, True)]

    def finish(batch: pa.RecordBatch):
        rows = []
        for t, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
            out, at, gone, runs = [], 0, 0, 0
            for s in sorted(spans or (), key=lambda s: s["a"]):
                a, b = s["a"], s["b"] + length - 1
                if a > at or not runs:
                    runs += 1
                    out.append(t[at:a])
                    at = a
                if b > at:
                    gone += b - at
                    at = b
            out.append(t[at:])
            kept = b"".join(out)
            rows.append((len(t), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows)) or [[]] * 5
        names = (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()))
        yield {"doc_id": batch.column(0), **{k: pa.array(c, kind) for (k, kind), c in zip(names, columns)}}

    out = arrow_map(few, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", 256)
    return reduce(DataFrame.unionByName, parts, out)
