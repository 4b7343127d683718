"""Class-based n-gram language model with exchange clustering.

Counts cover all training rows, and every training word gets one of ``classes`` classes. The
``most_words`` most frequent words take part in the exchange: in a round the words of one half
of them look for the class to which their move raises the likelihood of the class pairs most (by
the exact change, all other words staying where they are); these moves are made together if the
likelihood of the whole rises, else those of a half or a quarter of them, whichever helps more. Rounds
stop when no move helps. Every further word (the tail) then goes to the class that raises the likelihood most.

P(word | previous) = P(class | class of previous) P(word | class). Class transitions are
interpolated with class frequencies by Witten-Bell weights, so that no transition is impossible.
Words never seen are one event with a class of its own: it follows a class as often as words seen
once do (Good-Turing), and what follows it is what follows them. Probabilities add up to one.

What a task holds is bounded by parameters: ``most_words`` words of at most ``longest_word`` bytes
with their classes, and classes x classes counts. The exchange reads, for each word, the packed ids
of its neighbours: three bytes for each, in rows of about half a million; words of over ``light``
neighbours lie in many rows and tasks, and their counts by class are added up by a shuffle. The
classes of the tail are a table that meets the tokens by a join.

Edge cases: a null text is the empty text, which is one end token; without training rows all
words are unseen and base_score follows its formula with N = V = 0; an empty table gives an
empty result; ties between words go by a hash of the word. Input columns other than key and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pacekeeper.llm.base import HEAVY, Scratch, arrow_map, join_heavy

CLASSES, MOST_WORDS, LONGEST_WORD, ROUNDS, LIGHT = 48, 1 << 17, 128, 10, 1 << 17
END = b"\n"  # no word holds white space
_CHUNK, _COUNTED = 1_000_000, 3_000_000  # neighbours and words held at a time
_BUCKETS = 16  # of the logarithm of a count
_RANGES = 256  # of a word's hash
_UNKNOWN, _ONCE = 255, 128  # codes of tokens: no class yet; flag of words seen once


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts as one array of bytes, and how many each text has: A-Z lower-cased, split at 0x20 and 0x09-0x0D."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, sizes = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at the ends of a text
    if not full.all():
        flat, sizes = flat.filter(pa.array(full)), np.add.reduceat(full, np.cumsum(sizes) - sizes, dtype=np.int64)
    return flat, sizes.astype(np.int64)


def _counts(docs: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        texts = 0

        def flush() -> pa.RecordBatch:
            found = pa.concat_arrays(held).value_counts()
            held.clear()
            return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                held.append(words(batch.column(0).slice(at, 4096))[0])
                texts += min(4096, batch.num_rows - at)
                if sum(map(len, held)) > _COUNTED:
                    yield flush()
                    pa.default_memory_pool().release_unused()
        if held:
            yield flush()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], names=["word", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _kept_words(counts: DataFrame, most_words: int, longest_word: int) -> list[tuple[bytes, int]]:
    """The end token and the most frequent words, ``most_words`` in all, most frequent first; chosen by histograms and not by a sort.

    Among words of the count at the edge ranges of a hash decide, so up to one range of places stays free.
    """
    ends = [(END, r["n"]) for r in counts.filter(F.col("word") == F.lit(END)).collect()]
    fit = counts.filter((F.octet_length("word") <= longest_word) & (F.col("word") != F.lit(END))).withColumn("bucket", F.floor(F.log2("n") * _BUCKETS)).withColumn("range", F.pmod(F.xxhash64("word"), F.lit(_RANGES)))
    take, total = None, len(ends)
    for bucket, size in sorted(fit.groupBy("bucket").agg(F.count("*")).collect(), reverse=True):
        if total + size > most_words:
            break
        take, total = bucket, total + size
    keep = F.lit(False) if take is None else F.col("bucket") >= take
    edge = fit.filter(F.col("bucket") < (2**62 if take is None else take)).agg(F.max("bucket")).first()[0]
    if edge is not None and total < most_words:
        least = None
        for n, r, size in sorted(fit.filter(F.col("bucket") == edge).groupBy("n", "range").agg(F.count("*")).collect(), reverse=True):
            if total + size > most_words:
                break
            least, total = (n, r), total + size
        if least is not None:
            keep = keep | ((F.col("bucket") == edge) & ((F.col("n") > least[0]) | ((F.col("n") == least[0]) & (F.col("range") >= least[1]))))
    rows = fit.filter(keep).select("word", "n").toArrow()
    return sorted([*ends, *zip(rows["word"].to_pylist(), rows["n"].to_pylist())], key=lambda x: (-x[1], x[0]))


# -- packed neighbours ----------------------------------------------------------


def _lists(keys: np.ndarray, others: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ``others`` each key has, and all others in order of keys."""
    both = keys * np.int64(1 << 24)
    both += others
    both.sort()
    both &= (1 << 24) - 1
    return np.bincount(keys, minlength=n_ids), both.astype(np.int32)


def _blobs(sizes: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
    """Lists of ids as two binary columns: low 16 bits and the bits above."""
    out = []
    for plane, width in ((ids.astype(np.uint16), 2), ((ids >> 16).astype(np.uint8), 1)):
        offsets = np.concatenate([[0], np.cumsum(sizes * width)]).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(plane.tobytes())]))
    return out


def _unpacked(low: pa.Array, high: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the lists, and all ids."""
    planes = []
    for column, kind in ((low, np.uint16), (high, np.uint8)):
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        planes.append((np.diff(at), np.frombuffer(data.tobytes(), kind)))
    ids = planes[1][1].astype(np.int32)
    ids <<= 16
    ids |= planes[0][1]
    return planes[1][0], ids


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    """All numbers in some rows of a binary column."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].tobytes(), kind)


def _joined(column: pa.Array, start: np.ndarray) -> pa.Array:
    """Values of a binary column put together from each of ``start`` to the next."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(at[start], at[-1]).astype(np.int32).tobytes()), column.buffers()[2]])


def _groups(n: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """Group and half of each id from the counts in falling order (the last id, the tail, is on its own in half 4).

    Words of one half and about one count make a group of at most 256 words and about half a million neighbours. Words
    of over ``light`` neighbours have a group each, of half 2 or 3.
    """
    ids = np.arange(len(n), dtype=np.uint64)
    half = ((ids * np.uint64(2654435761) >> np.uint64(16)) & np.uint64(1)).astype(np.int64)
    name = np.full((len(n) + 1, 4), -1)
    name[:-1, 0] = np.where(n > light, half + 2, half)
    name[-1, 0] = 4
    for h in (0, 1):
        mine = np.flatnonzero((half == h) & (n <= light))
        name[mine, 1], name[mine, 2] = np.cumsum(n[mine]) // (_CHUNK // 2), np.arange(len(mine)) // 256
    hot = np.flatnonzero(n > light)
    name[hot, 3] = hot
    found, group = np.unique(name, axis=0, return_inverse=True)
    return group.reshape(-1), found[:, 0]


_PACKED = ("w", "nl", "nr", "l0", "l1", "r0", "r1")


def _neighbours(rows: DataFrame, kept: list[tuple[bytes, int]], scratch: Scratch, light: int) -> DataFrame:
    """Packed lists of the ids that stand before (l0, l1) and after (r0, r1) words in ``rows`` (low, high); the id after the last kept word stands for the tail.

    A row has the words (w) of a group and how many neighbours each has (nl, nr); a word may come several times. Half is
    0 or 1 for groups in one row, 2 and 3 for single words with over ``light`` neighbours, in many rows, 4 for the tail.
    """
    n_ids = len(kept) + 1
    end = next(i for i, (w, _) in enumerate(kept) if w == END)
    group, half = _groups(np.array([n for _, n in kept]), light)
    order = np.argsort(group, kind="stable")  # ids, group by group
    place = np.empty(n_ids, np.int64)
    place[order] = np.arange(n_ids)
    shared = rows.sparkSession.sparkContext.broadcast((group[order], half, order, place))
    schema = "g int, half int, " + ", ".join(f"{c} binary" for c in _PACKED)
    names = ["g", "half", *_PACKED]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, half, order, place = shared.value
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            seq = np.concatenate([[end], *held])  # texts end with the end token, which also stands before the next
            held.clear()
            (before, left), (after, right) = _lists(place[seq[1:]], seq[:-1], n_ids), _lists(place[seq[:-1]], seq[1:], n_ids)
            there = np.flatnonzero(before + after)
            start = np.flatnonzero(np.concatenate([[True], group[there][1:] != group[there][:-1]]))
            g = group[there[start]]
            words = [_joined(c, start) for c in (_numbers(order[there]), _numbers(before[there]), _numbers(after[there]))]
            lists = [_joined(c, start) for sizes, ids in ((before, left), (after, right)) for c in _blobs(sizes[there], ids)]
            return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(half[g].astype(np.int32)), *words, *lists], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                held.append(_unpacked(batch.column(0).slice(at, 1024), batch.column(1).slice(at, 1024))[1])
                if sum(map(len, held)) > _CHUNK:
                    yield flush()
                    pa.default_memory_pool().release_unused()
        if held:
            yield flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for the rows of a group, but for words that lie in many rows anyway."""
        held: pa.Table | None = None

        def merged(table: pa.Table, start: np.ndarray) -> pa.RecordBatch:
            whole = table.combine_chunks().to_batches()[0]
            firsts = [pa.array(whole.column(i).to_numpy()[start]) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*firsts, *(_joined(c, start) for c in whole.columns[2:])], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            table = now if held is None else pa.concat_tables([held, now])
            g, many = table["g"].to_numpy(), table["half"].to_numpy() > 1
            start = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | many[1:]]))
            if len(start) > 1:
                yield merged(table.slice(0, start[-1]), start[:-1])
            held = table.slice(start[-1])
        if held is not None:
            yield merged(held, np.array([0]))

    packed = rows.select("low", "high").mapInArrow(pack, schema)
    deal = F.when(F.col("half") > 1, -1 - F.pmod(F.xxhash64("l0", "r0"), F.lit(1 << 20))).otherwise(F.col("g"))
    dealt = packed.withColumn("deal", deal).repartition("deal").sortWithinPartitions("g").select(*names).mapInArrow(join, schema)
    return scratch.keep(dealt.select("g", *_PACKED, "half"), "neighbours", "half")


def _numbers(values: np.ndarray) -> pa.Array:
    """Each number as a value of a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(0, 4 * len(values) + 1, 4, dtype=np.int32).tobytes()), pa.py_buffer(values.astype(np.int32).tobytes())])


def _parts(batch: pa.RecordBatch, low: int) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, with few ids in the column ``low``."""
    size = np.diff(np.frombuffer(batch.column(low).buffers()[1], np.int32)[batch.column(low).offset :][: batch.num_rows + 1])
    turn = np.searchsorted(np.cumsum(size), np.arange(0, max(1, size.sum()), _CHUNK))
    for a, b in zip(turn.tolist(), [*turn[1:].tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


# -- exchange ---------------------------------------------------------------------


def _f(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0.0)
    return x * np.log(np.maximum(x, 1e-300))


def _likelihood(m: np.ndarray) -> float:
    return float(_f(m).sum() - _f(m.sum(axis=0)).sum() - _f(m.sum(axis=1)).sum())


def move_gains(m: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, self_pairs: np.ndarray) -> np.ndarray:
    """Change in likelihood if each word alone moved to each class.

    m: class pair counts. For each word: its class, counts of classes before and after it, and of itself after itself.
    """
    n, k = left.shape
    at = np.arange(n)
    s = self_pairs[:, None].astype(float)
    total = np.zeros((n, k))
    for counts, table in ((right, m), (left, m.T)):
        out = _f(table[own] - counts) - _f(table)[own]
        total += out.sum(axis=1, keepdims=True) - out - out[at, own][:, None]
        word, slot = np.nonzero(counts)
        gone = slot == own[word]
        word, slot = word[~gone], slot[~gone]
        by_slot = np.ascontiguousarray(table.T)
        into = by_slot[slot] + counts[word, slot][:, None]  # above 0
        into *= np.log(into)
        into -= _f(by_slot)[slot]
        into[np.arange(len(word)), slot] = 0
        if len(word):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            total[word[first]] += np.add.reduceat(into, first, axis=0)
        size = counts.sum(axis=1, keepdims=True)
        sums = table.sum(axis=1)
        total -= _f(sums[own][:, None] - size) - _f(sums)[own][:, None] + _f(sums[None, :] + size) - _f(sums)[None, :]
    r_own, l_own = right[at, own][:, None], left[at, own][:, None]
    diag = np.diag(m)
    total += _f(m[own, own][:, None] - r_own - l_own + s) - _f(m[own, own][:, None])
    total += _f(m[own] - right + l_own - s) - _f(m[own])
    total += _f(m.T[own] - left + r_own - s) - _f(m.T[own])
    total += _f(diag[None, :] + right + left + s) - _f(diag[None, :])
    total[at, own] = 0
    return total


def _best(m: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, self_pairs: np.ndarray) -> np.ndarray:
    """Best class of each word; the last class is none to move to."""
    out = np.empty(len(own), np.int64)
    for at in range(0, len(own), 256):
        part = slice(at, at + 256)
        gains = move_gains(m, own[part], left[part], right[part], self_pairs[part])[:, :-1]
        out[part] = gains.argmax(axis=1)
        stay = (gains.max(axis=1) <= 1e-9) & (own[part] < len(m) - 1)
        out[part][stay] = own[part][stay]
    return out


def _vectors(batch: pa.RecordBatch, of: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of packed rows, counts of classes before and after them, and of each itself after itself; some rows at a time."""
    for part in _parts(batch, 3):
        words, row = np.unique(_flat(part.column(0), np.int32), return_inverse=True)
        row = row.reshape(-1)
        found = []
        for i, low in ((1, 3), (2, 5)):
            sizes, ids = _flat(part.column(i), np.int32), _unpacked(part.column(low), part.column(low + 1))[1]
            at = np.repeat(row * k, sizes)
            if i == 2:
                same = at[np.repeat(words[row], sizes) == ids] // k
            at += of[ids]
            found.append(np.bincount(at, minlength=len(words) * k).reshape(-1, k).astype(float))
        yield words.astype(np.int64), *found, np.bincount(same, minlength=len(words))


def _class_pairs(views: DataFrame, candidates: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Class pair counts under each of some assignments, in one pass."""
    shared = views.sparkSession.sparkContext.broadcast(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(shared.value), k * k), np.int64)
        for batch in batches:
            for part in _parts(batch, 2):
                w, sizes, ids = _flat(part.column(0), np.int32), _flat(part.column(1), np.int32), _unpacked(part.column(2), part.column(3))[1]
                for total, of in zip(totals, shared.value):
                    place = np.repeat(of[w].astype(np.int64) * k, sizes)
                    place += of[ids]
                    total += np.bincount(place, minlength=k * k)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals.ravel()[at])], names=["at", "n"])

    rows = views.select("w", "nr", "r0", "r1").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most k x k rows for each
    out = np.zeros(len(candidates) * k * k)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return list(out.reshape(-1, k, k))


def _choices(views: DataFrame, of: np.ndarray, m: np.ndarray, half: int) -> np.ndarray:
    """Classes after each word of one half has gone to its best class."""
    k = len(m)
    shared = views.sparkSession.sparkContext.broadcast((of, m))
    chosen = "w int, c int"

    def result(w: np.ndarray, c: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        moved = c != of[w]
        return pa.RecordBatch.from_arrays([pa.array(w[moved].astype(np.int32)), pa.array(c[moved].astype(np.int32))], names=["w", "c"])

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, m = shared.value
        for batch in batches:
            for w, left, right, own in _vectors(batch, of, k):
                yield result(w, _best(m, of[w].astype(np.int64), left, right, own), of)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, _ = shared.value
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, left, right, own in _vectors(batch, of, k):
                for i, row in zip(w.tolist(), np.concatenate([left, right, own[:, None]], axis=1)):
                    held[i] = held.get(i, 0) + row
        for at in range(0, len(held), 1024):
            keys = list(held)[at : at + 1024]
            dense = np.stack([held[i] for i in keys])
            row, slot = np.nonzero(dense)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int32)[row]), pa.array(slot.astype(np.int32)), pa.array(dense[row, slot])], names=["w", "slot", "x"])

    def whole(batch: pa.RecordBatch):
        of, m = shared.value
        w = batch.column(0).to_numpy().astype(np.int64)
        dense = np.zeros((len(w), 2 * k + 1))
        for row, slots in zip(dense, batch.column(1).to_pylist()):
            row[[s["slot"] for s in slots]] = [s["x"] for s in slots]
        found = result(w, _best(m, of[w].astype(np.int64), dense[:, :k], dense[:, k : 2 * k], dense[:, -1]), of)
        yield {"w": found.column(0), "c": found.column(1)}

    some = views.filter(F.col("half") == half).select(*_PACKED).mapInArrow(light, chosen)
    many = views.filter(F.col("half") == half + 2).select(*_PACKED).mapInArrow(parts, "w int, slot int, x double")
    many = many.groupBy("w", "slot").agg(F.sum("x").alias("x")).groupBy("w").agg(F.collect_list(F.struct("slot", "x")).alias("slots"))
    rows = some.unionByName(arrow_map(many, whole, chosen)).toArrow()  # at most a row for each kept word
    out = of.copy()
    out[rows["w"].to_numpy()] = rows["c"].to_numpy().astype(of.dtype)
    return out


def exchange(views: DataFrame, n_ids: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each id (the last id, the tail, alone in the last class), class pair counts, likelihood after each round."""
    k = classes + 1
    of = (np.arange(n_ids) % classes).astype(np.uint8)
    of[-1] = classes
    m = _class_pairs(views, [of], k)[0]
    history, failed, whole = [_likelihood(m)], 0, [True, True]
    for i in range(rounds):
        wanted = _choices(views, of, m, i % 2)
        moved = np.flatnonzero(wanted != of)
        raised = False
        # A half whose words could not move together any more does not try to again.
        for shares in ([(1,)] if whole[i % 2] else []) + [(2, 4)]:
            tried = []
            for share in shares:
                new = of.copy()
                some = moved[moved * 2654435761 % (1 << 32) >> 16 & (share - 1) == 0]
                new[some] = wanted[some]
                tried.append(new)
            tables = _class_pairs(views, tried, k) if len(moved) else []
            now, best = max(((_likelihood(t), -j) for j, t in enumerate(tables)), default=(history[-1], 0))
            if now > history[-1]:
                of, m, raised = tried[-best], tables[-best], True
                history.append(now)
                break
            whole[i % 2] = False
        failed = 0 if raised else failed + 1
        if failed == 2:
            break
    return of, m, history


# -- scoring ------------------------------------------------------------------------


def _tail_classes(rows: DataFrame, codes: np.ndarray, m: np.ndarray) -> DataFrame:
    """word, n, class for each word beyond the kept ones in ``rows`` (low, high, rare), from the classes around it."""
    k = len(m)
    shared = rows.sparkSession.sparkContext.broadcast((np.where(codes == _UNKNOWN, k - 1, codes & (_ONCE - 1)).astype(np.uint8), m))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, _ = shared.value
        found: list[pa.Array] = []
        around: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            named = pa.concat_arrays(found).dictionary_encode()
            at = named.indices.to_numpy()
            slots = np.concatenate(around)[np.argsort(at, kind="stable")]
            offsets = np.concatenate([[0], 2 * np.cumsum(np.bincount(at, minlength=len(named.dictionary)))]).astype(np.int32)
            found.clear()
            around.clear()
            blobs = pa.Array.from_buffers(pa.binary(), len(named.dictionary), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(slots.tobytes())])
            return pa.RecordBatch.from_arrays([named.dictionary, blobs], names=["word", "slots"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = _unpacked(part.column(0), part.column(1))[1]
                spot = np.flatnonzero(ids == len(of) - 1)
                if len(spot):  # never the last token of a text, and before its first stands the end token, as at the end of all
                    before = of[ids[spot - 1]]
                    around.append(np.stack([before, of[ids[spot + 1]]], axis=1).astype(np.uint8))
                    found.append(part.column(2).flatten())
            if sum(map(len, found)) > _CHUNK // 2:
                yield flush()
        if found:
            yield flush()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value[1]
        once = result_of(np.repeat(np.eye(k), k, axis=0), np.tile(np.eye(k), (k, 1)), m).reshape(k, k)
        held_word, held = None, np.zeros(2 * k)
        for batch in batches:
            if not batch.num_rows:
                continue
            words_in = batch.column(0).to_pylist()
            slots = batch.column(1)
            at = np.frombuffer(slots.buffers()[1], np.int32)[slots.offset : slots.offset + len(slots) + 1]
            data = np.frombuffer(slots.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].reshape(-1, 2).astype(np.int64)
            start = [i for i, w in enumerate(words_in) if i == 0 or w != words_in[i - 1]]
            group = np.zeros(len(words_in), np.int64)
            group[start[1:]] = 1
            row = np.repeat(np.cumsum(group), np.diff(at) // 2)
            dense = sum(np.bincount(row * 2 * k + side * k + data[:, side], minlength=len(start) * 2 * k) for side in (0, 1)).reshape(-1, 2 * k).astype(float)
            names = [words_in[i] for i in start]
            if names[0] == held_word:
                dense[0] += held
            elif held_word is not None:
                names, dense = [held_word, *names], np.concatenate([held[None, :], dense])
            held_word, held = names[-1], dense[-1]
            if len(names) > 1:
                yield result(names[:-1], dense[:-1], m, once)
        if held_word is not None:
            yield result([held_word], held[None, :], m, once)

    def result_of(left: np.ndarray, right: np.ndarray, m: np.ndarray) -> np.ndarray:
        return _best(m, np.full(len(left), k - 1), left, right, np.zeros(len(left)))

    def result(names: list[bytes], dense: np.ndarray, m: np.ndarray, once: np.ndarray) -> pa.RecordBatch:
        """Most words stand in one place only; ``once`` tells their class from the two around them."""
        n = dense[:, :k].sum(axis=1).astype(np.int64)
        best = once[dense[:, :k].argmax(axis=1), dense[:, k:].argmax(axis=1)]
        best[n > 1] = result_of(dense[n > 1, :k], dense[n > 1, k:], m)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n), pa.array(best.astype(np.int32))], names=["word", "n", "class"])

    found = rows.select("low", "high", "rare").mapInArrow(contexts, "word binary, slots binary")
    dealt = found.withColumn("h", F.xxhash64("word")).repartition("h").sortWithinPartitions("h", "word")  # numbers first, they sort faster
    return dealt.select("word", "slots").mapInArrow(choose, "word binary, n long, class int")


class Model:
    """Log10 class transitions with the class of unseen words, and the log10 number of tokens of each class."""

    def __init__(self, m: np.ndarray, after_once: np.ndarray, before_once: np.ndarray, once_once: float) -> None:
        """m: class pair counts; of words seen once: by the class before, by the class after, and among themselves."""
        k = len(m)
        mass = m.sum(axis=0)
        share = (mass + 1) / (mass.sum() + k)
        table = np.vstack([m, before_once])
        follow, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
        keep = follow / np.maximum(follow + kinds, 1)
        known = keep * table / np.maximum(follow, 1) + (1 - keep) * share[None, :]
        unseen = (np.append(after_once, once_once) + 0.5) / (follow[:, 0] + 1)
        self.transition = np.log10(np.hstack([known * (1 - unseen[:, None]), unseen[:, None]]))
        self.mass = np.append(np.log10(np.maximum(mass, 1)), 0.0)


def _sequences(column: pa.Array, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens, the code before each, and where each text begins. Texts end with the end token, whose code is ``first``."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    code = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return code, np.concatenate([[np.uint8(first)], code[:-1]]), at[:-1] - at[0]


def _final_counts(full: DataFrame, k: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Class pairs of the training rows; those that end, begin, and do both in a word seen once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 * k * k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                code, before, _ = _sequences(batch.column(0).slice(at, 1024), first)
                a, b = before.astype(np.int64), code.astype(np.int64)
                kind = (a >= _ONCE) * 2 + (b >= _ONCE)
                total += np.bincount(kind * k * k + (a & (_ONCE - 1)) * k + (b & (_ONCE - 1)), minlength=4 * k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = full.filter("train").select("seq").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most 4 k x k rows
    out = np.zeros(4 * k * k)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    out = out.reshape(4, k, k)
    return out.sum(axis=0), (out[1] + out[3]).sum(axis=1), (out[2] + out[3]).sum(axis=0), float(out[3].sum())


def _encoded(plain: DataFrame, kept: list[tuple[bytes, int]], total: int, types: int) -> DataFrame:
    """row, doc_id, train, packed ids (low, high), words beyond the kept ones in their order (rare), and of the kept ones the sums of base_score and of log10 of their counts."""
    n, n_kept = np.array([c for _, c in kept], float), len(kept)
    known = [w for w, _ in kept]
    end = known.index(END) if kept else 0
    shared = plain.sparkSession.sparkContext.broadcast((known, np.append(np.log10((n + 1) / (total + types + 1)), 0.0), np.append(np.log10(n), 0.0)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, log_n = shared.value
        known = pa.array(known, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                flat, sizes = words(part.column(1))
                place = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
                ids = np.full(len(flat) + len(sizes), end, np.int32)
                ids[place] = pc.fill_null(pc.index_in(flat, value_set=known), n_kept).to_numpy(zero_copy_only=False)
                source = np.full(len(ids), len(flat))
                source[place] = np.arange(len(flat))
                sizes = sizes + 1
                start = np.cumsum(sizes) - sizes
                spot = np.flatnonzero(ids == n_kept)
                rare = pa.concat_arrays([flat, pa.array([END], pa.binary())]).take(pa.array(source[spot]))
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(spot, np.append(start, len(ids))), pa.int32()), rare)
                sums = [pa.array(np.add.reduceat(x[ids], start)) for x in (base, log_n)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes), *sums, *_blobs(sizes, ids), rare], names=["doc_id", "train", "n_tokens", "base_own", "log_own", "low", "high", "rare"])

    schema = "doc_id long, train boolean, n_tokens long, base_own double, log_own double, low binary, high binary, rare array<binary>"
    return plain.select("doc_id", F.col("text").cast("string"), "train").mapInArrow(encode, schema).withColumn("row", F.monotonically_increasing_id())


def _filled(rows: DataFrame, got: DataFrame, codes: np.ndarray, classes: int, all_of: int) -> DataFrame:
    """Rows with the codes of all tokens (seq), n_known, base_score and log_n (sum of log10 of the counts).

    ``got`` (row, i, n, class) are the words beyond the kept ones that were found; those that were not get the code
    of the unseen. A row and its words come together by a shuffle.
    """
    columns = ["doc_id", "train", "n_tokens", "base_own", "log_own"]
    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def code(batch: pa.RecordBatch):
        sizes, ids = _unpacked(batch.column(0), batch.column(1))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        seq = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(shared.value[ids].tobytes())])
        yield {"row": batch.column(2), "seq": seq, **{c: batch.column(i) for i, c in enumerate(columns, 3)}}

    kinds = "doc_id long, train boolean, n_tokens long, base_own double, log_own double"
    coded = arrow_map(rows.select("low", "high", "row", *columns), code, f"row long, seq binary, {kinds}", 1024)
    # 4096 rows of one task that wrote them make a bucket; their words travel as one list.
    bucket = F.shiftright("row", 12).alias("bucket")
    code_of = F.col("class") + F.when(F.col("n") == 1, _ONCE).otherwise(0)
    told = F.struct("row", "i", "n", code_of.cast("int").alias("code"))
    both = coded.select("*", bucket).unionByName(got.groupBy(bucket).agg(F.collect_list(told).alias("found")), allowMissingColumns=True)

    def filled(table: pa.Table) -> pa.RecordBatch:
        docs = table.filter(pc.is_valid(table["row"])).sort_by("row").combine_chunks().to_batches()[0]
        told = table["found"].combine_chunks().flatten().flatten()
        row, i, n, code = (c.to_numpy(zero_copy_only=False) for c in told)
        seq, _, start = _sequences(docs.column("seq"), 0)
        seq, d = seq.copy(), np.searchsorted(docs.column("row").to_numpy(), row)
        spot = np.flatnonzero(seq == _UNKNOWN)
        seq[spot] = classes
        first = np.searchsorted(spot, np.append(start, len(seq)))
        seq[spot[first[d] + i]] = code
        n = n.astype(float)
        found, base, log_n = (np.bincount(d, w, minlength=docs.num_rows) for w in (None, np.log10((n + 1) / all_of), np.log10(n)))
        unseen = np.diff(first) - found
        offsets = np.append(start, len(seq)).astype(np.int32)
        out = [
            pa.Array.from_buffers(pa.binary(), docs.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(seq.tobytes())]), docs.column("doc_id"), docs.column("train"), docs.column("n_tokens"),
            pa.array(docs.column("n_tokens").to_numpy() - unseen), pa.array(docs.column("base_own").to_numpy() + base - np.log10(all_of) * unseen), pa.array(docs.column("log_own").to_numpy() + log_n),
        ]
        return pa.RecordBatch.from_arrays(out, names=["seq", "doc_id", "train", "n_tokens", "n_known", "base_score", "log_n"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # what has come of the last bucket so far
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            at = table["bucket"].to_numpy()
            for a, b in zip(turn := [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()], turn[1:]):
                yield filled(table.slice(a, b - a))
            held = table.slice(turn[-1])
        if held is not None:
            yield filled(held)

    schema = "seq binary, doc_id long, train boolean, n_tokens long, n_known long, base_score double, log_n double"
    return both.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(fill, schema)


def score(docs: DataFrame, train: Column, classes: int = CLASSES, most_words: int = MOST_WORDS, longest_word: int = LONGEST_WORD, rounds: int = ROUNDS, light: int = LIGHT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row."""
    if not 0 < classes < _ONCE - 1:
        raise ValueError("between 1 and 126 classes")
    spark = docs.sparkSession
    scratch = Scratch(spark, "class-lm")
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = scratch.keep(_counts(plain.filter("train"), "text"), "counts")
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("types")).first()
    total, types = facts["total"], facts["types"]
    kept = _kept_words(counts, most_words, longest_word)
    n = np.array([c for _, c in kept], float)
    rows = scratch.keep(_encoded(plain, kept, total, types), "rows")
    learn = rows.filter("train")
    if kept:
        of, m, _ = exchange(_neighbours(learn, kept, scratch, light), len(kept) + 1, classes, rounds)
        scratch.drop("neighbours")
    else:
        of, m = np.array([classes], np.uint8), np.zeros((classes + 1, classes + 1))
    codes = np.append(of[:-1] | np.where(n == 1, _ONCE, 0).astype(np.uint8), np.uint8(_UNKNOWN))
    # What begins a text is the end token; it is unseen, in a class of its own, where nothing was learnt.
    first = int(codes[[w for w, _ in kept].index(END)]) if kept else classes
    # Words beyond the kept ones: their counts and classes come by a join on the words.
    tail = scratch.keep(_tail_classes(learn, codes, m), "tail")
    hashed = lambda d: d.withColumn("h", F.xxhash64("word"))
    rare, tail = hashed(rows.select("row", F.posexplode("rare").alias("i", "word"))), hashed(tail)
    got = join_heavy(rare, tail, ["h", "word"], tail.filter(F.col("n") * HEAVY > total))
    full = scratch.keep(_filled(rows, got, codes, classes, total + types + 1), "full")
    model = spark.sparkContext.broadcast(Model(*_final_counts(full, classes, first)))

    def finish(batch: pa.RecordBatch):
        x = model.value
        code, before, start = _sequences(batch.column(0), first)
        code, before = code & np.uint8(_ONCE - 1), before & np.uint8(_ONCE - 1)
        steps = np.add.reduceat(x.transition[before, code] - x.mass[code], start) if len(code) else np.empty(0)
        held_out = pa.array([not t for t in batch.column(2).to_pylist()], pa.bool_())
        scores = pa.array(steps + batch.column(6).to_numpy(zero_copy_only=False))
        yield {"doc_id": batch.column(1), "held_out": held_out, "n_tokens": batch.column(3), "n_known": batch.column(4), "train_tokens": pa.array([int(total)] * batch.num_rows, pa.int64()), "base_score": batch.column(5), "score": scores}

    out = arrow_map(full, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", 512)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
