"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised item word sequences is streamed over the words of every
document, tracking the longest match that ends at each word. Where it reaches the window
length, the last ``window`` words occur in an item; items shorter than a window count as
one window of their own length.

The automaton goes to the executors as a broadcast of bounded size: items are taken in
blocks of at most ``block_words`` words (items longer than a block are cut into pieces that
overlap by window - 1 words, which keeps every window). A benchmark of one block takes one
pass without any shuffle; of more blocks, each is run against all documents in turn, and the
hits of a document are then united.

Edge cases: null text has no words; an item without words has no window; a null item_id is
named "null"; repeated items and item_ids count once. Empty tables give clean documents or an
empty result. Input columns other than key and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pacekeeper.llm.base import Scratch, arrow_map, sieve, utf8

WINDOW, BLOCK_WORDS = 10, 400_000
#: Word bytes are 0-9, a-z and everything beyond ASCII; A-Z are lower-cased, the rest separates.
_TABLE = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the root."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[str, int, list[int]]] = []
        for name, seq in items:
            last, path = 0, []
            for w in seq:
                last = self._extend(last, w)
                path.append(w)
            if path:
                ends.append((name, len(path), path))
        n = len(self.next)
        owners: list[set[str]] = [set() for _ in range(n)]
        self.short: list[tuple[tuple[int, str], ...]] = [()] * n
        own_short: dict[int, list[tuple[int, str]]] = {}
        for name, size, path in ends:
            v = 0
            for w in path:
                v = self.next[v][w]
                u = v
                while u > 0 and name not in owners[u]:
                    owners[u].add(name)
                    u = self.link[u]
            if size < window:
                own_short.setdefault(v, []).append((size, name))
        #: For each state, the state on its suffix path that holds the word window, or 0.
        self.holder = [0] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= window:
                self.holder[v] = v if self.length[up] < window else self.holder[up]
            self.short[v] = self.short[up] + tuple(sorted(set(own_short.get(v, ()))))
        self.items = {v: tuple(owners[v]) for v in set(self.holder) if v}

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link = self.next, self.link
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def hits(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit ranges [start, end) of word positions, and the items whose windows occur."""
        nxt, link, length, holder, short, window = self.next, self.link, self.length, self.holder, self.short, self.window
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        names: set[str] = set()
        root = nxt[0]
        v = size = 0
        for at, w in enumerate(seq, 1):
            if v == 0:
                v = root.get(w, 0)
                if v == 0:
                    continue
                size = 1
            else:
                to = nxt[v].get(w)
                while to is None and v:
                    v = link[v]
                    size = length[v]
                    to = nxt[v].get(w)
                if to is None:
                    size = 0
                    continue
                v = to
                size += 1
            start = at
            if size >= window:
                start = at - window
                found.add(holder[v])
            if short[v]:
                for n, name in short[v]:
                    if n <= size:
                        names.add(name)
                        start = min(start, at - n)
            if start < at:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at))
        for h in found:
            names.update(self.items[h])
        return spans, names


def _blocks(items: DataFrame, key: str, text: str, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Streams the items to the driver partition by partition and packs them; a block is all it holds."""
    block, size = [], 0
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")).cast("binary"))
    for name, body in rows.toLocalIterator():
        seq = words(bytes(body))
        for at in range(0, max(1, len(seq) - window + 1), block_words):
            piece = seq[at : at + block_words + window - 1]
            if size and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append((name, piece))
            size += len(piece)
    yield block


def _digest(names: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (word ranges) and text_hash for every row of ``docs``."""
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>, text_hash long"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def columns(ids, sizes, spans, names, hashes) -> dict:
        hit = [sum(b - a for a, b in s) for s in spans]
        return {
            "doc_id": ids, "n_words": pa.array(sizes, pa.int64()), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(n) for n in names], pa.int64()),
            "items_sha256": pa.array([_digest(n) for n in names], pa.string()), "contaminated": pa.array([h > 0 for h in hit], pa.bool_()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span_type), "text_hash": hashes,
        }

    blocks = _blocks(items, item_key, item_text, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        model = spark.sparkContext.broadcast(Automaton(first, window))

        def one(batch: pa.RecordBatch):
            seqs = [words(t) for t in utf8(batch.column(1))]
            found = [model.value.hits(s) for s in seqs]
            yield columns(batch.column(0), [len(s) for s in seqs], [f[0] for f in found], [f[1] for f in found], batch.column(2))

        return arrow_map(plain, one, schema, 512)

    scratch = Scratch(spark, "decontaminate")
    parts = []
    for i, block in enumerate(x for group in ([first, second], blocks) for x in group):
        model = spark.sparkContext.broadcast(Automaton(block, window))

        def some(batch: pa.RecordBatch, model=model):
            found = [(t, *model.value.hits(words(t))) for t in utf8(batch.column(0))]
            found = [f for f in found if f[1]]
            yield {
                "text_key": pa.array([hashlib.sha256(f[0]).digest() for f in found], pa.binary()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in f[1]] for f in found], span_type),
                "names": pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())),
            }

        parts.append(scratch.keep(arrow_map(plain.select("text"), some, "text_key binary, spans array<struct<start:int,end:int>>, names array<string>", 512), f"block{i}"))
        model.unpersist()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # A text meets each block once; equal texts have equal hits, so one row for each text and block is enough.
    every = every.dropDuplicates().groupBy("text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    every = scratch.keep(every, "hits")
    joined = plain.withColumn("text_key", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))).join(every, "text_key", "left")

    def finish(batch: pa.RecordBatch):
        spans = [_union((x["start"], x["end"]) for x in s or ()) for s in batch.column(3).to_pylist()]
        names = [set(n or ()) for n in batch.column(4).to_pylist()]
        yield columns(batch.column(0), [len(words(t)) for t in utf8(batch.column(1))], spans, names, batch.column(2))

    return arrow_map(joined.select("doc_id", "text", "text_hash", "spans", "names"), finish, schema, 512)


def strip_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the characters of the hit word ranges, from the first to the last word of each."""
    out, at, word = [], 0, 0
    flat = text.translate(_TABLE)
    edges: list[tuple[int, int]] = []
    pos, n = 0, len(flat)
    wanted = sorted(spans)
    i = 0
    start = 0
    while pos < n and i < len(wanted):
        while pos < n and flat[pos] == 32:
            pos += 1
        if pos >= n:
            break
        if word == wanted[i][0]:
            start = pos
        end = flat.find(b" ", pos)
        pos = n if end < 0 else end
        word += 1
        if word == wanted[i][1]:
            edges.append((start, pos))
            i += 1
    for a, b in edges:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, most_hits: int = 0, most_share: float = 0.5, key: str = "doc_id", text: str = "text", window: int = WINDOW, length: str | None = None) -> DataFrame:
    """``docs`` with hit spans cut out of their texts; rows go whose hit words exceed ``most_share`` of their words.

    Rows with at most ``most_hits`` hit words stay as they are. All columns stay; only the text changes, and the column ``length``,
    if one is named, to its number of characters.
    """
    names = docs.columns
    scratch = Scratch(docs.sparkSession, "decontaminated")
    found = scratch.keep(contamination(docs, items, key, text, window=window).filter(F.col("n_hit") > most_hits).select(F.col("doc_id").alias("__pk_id"), F.col("text_hash").alias("__pk_hash"), F.col("spans").alias("__pk_spans"), (F.col("n_hit") > most_share * F.col("n_words")).alias("__pk_gone")).dropDuplicates(["__pk_id", "__pk_hash"]), "found")
    told = docs.withColumn("__pk_text_hash", F.xxhash64(text))
    some, rest = sieve(told, found, "__pk_hash", "__pk_text_hash")
    on = F.col(key).cast("long").eqNullSafe(F.col("__pk_id")) & (F.col("__pk_text_hash") == F.col("__pk_hash"))

    @F.udf("string", useArrow=True)
    def cut(body: str, spans: list) -> str:
        return strip_spans(body.encode(), [(s["start"], s["end"]) for s in spans]).decode("utf-8", "replace")

    hit = some.join(found.filter("not __pk_gone"), on).withColumn(text, cut(F.col(text), F.col("__pk_spans")))  # Python sees these rows only
    if length is not None:
        hit = hit.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    out = rest.select(*names).unionByName(some.join(found, on, "left_anti").select(*names))
    return out.unionByName(hit.select(*names))
