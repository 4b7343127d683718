"""BPE encoding and decoding with a word-end vocabulary.

A word is a doubly linked list of symbols with a heap of (merge rank, position); a popped
entry whose symbols have changed meanwhile is stale and skipped. Words repeat, so their
results are kept in a bounded table per worker. Decoding concatenates vocabulary strings,
joined by a space as a tokenizer without decoder does.

The vocabulary file is read on the driver and broadcast; its size is checked first.

Edge cases: null is the empty text with no ids; marks of special tokens inside a text are
taken as those tokens before anything else; text of any length is one list of words, and a
word of n symbols costs O(n log n). Empty tables give an empty result. Input columns other
than key and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from pacekeeper.llm.base import arrow_map

MOST_VOCABULARY_BYTES = 64_000_000
MOST_CACHED_WORDS = 200_000  # of each part of the two tables
LONGEST_CACHED_WORD = 64
_BITS = 24  # of an id in a pair
#: White space of the tokenizer's own regular expressions (unlike str.split, not 0x1C-0x1F).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = re.compile(f"[^{_SPACE}]+")
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself if printable in Latin-1, else the next from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [rest.get(b, chr(b)) for b in range(256)]


class _Recent:
    """A bounded table of two parts: a full young one becomes the old one, so what is in use stays."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def get(self, key: str):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value) -> None:
        if len(key) <= LONGEST_CACHED_WORD:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = value


class Bpe:
    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.strings = {i: s for s, i in {**self.vocab, **self.special}.items()}
        #: By pair of ids (one number): rank of the merge; by rank: the pair and the id that it makes.
        self.ranks: dict[int, int] = {}
        self.pairs: list[int] = []
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = self.vocab[a] << _BITS | self.vocab[b]
            self.ranks[key] = rank
            self.pairs.append(key)
            self.made.append(self.vocab[a + b])
        letters = byte_letters()
        self.inner = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.end) for c in letters]
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.forget()

    def forget(self) -> None:
        """Empties the tables of words and pieces."""
        self._words, self._pieces = _Recent(MOST_CACHED_WORDS), _Recent(MOST_CACHED_WORDS)

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        body = piece.encode()
        inner = self.inner
        ids = [inner[b] for b in body]
        ids[-1] = self.last[body[-1]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return ids
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        rank_of, pairs, push, pop = self.ranks.get, self.pairs, heapq.heappush, heapq.heappop
        heap = []
        for i in range(n - 1):
            r = rank_of(ids[i] << _BITS | ids[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j < 0 or ids[i] < 0 or ids[i] << _BITS | ids[j] != pairs[r]:
                continue  # stale: one of the two was merged already
            new = ids[i] = self.made[r]
            ids[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                r = rank_of(new << _BITS | ids[k])
                if r is not None:
                    push(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank_of(ids[h] << _BITS | new)
                if r is not None:
                    push(heap, r << 32 | h)
        return [i for i in ids if i >= 0]

    def _held(self, ids: list[int]) -> tuple:
        """What the tables hold of a word: count, ids and decoded text."""
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def _joined(self, parts: list[tuple]) -> tuple:
        return sum(p[0] for p in parts), " ".join([p[1] for p in parts if p[0]]), " ".join([p[2] for p in parts if p[0]])

    def _piece(self, piece: str) -> tuple:
        """What is held of a pre-token."""
        found = self._pieces.get(piece)
        if found is None:
            found = self._held(self.merge(piece))
            self._pieces.put(piece, found)
        return found

    def _word(self, word: str) -> tuple:
        """What is held of what stands between two spaces."""
        found = self._words.get(word)
        if found is None:
            parts = [self._piece(p) for p in _PIECES.findall(word)]
            found = parts[0] if len(parts) == 1 else self._joined(parts)
            self._words.put(word, found)
        return found

    def _parts(self, text: str) -> list[tuple]:
        """What is held of words and special marks in order."""
        if not any(m in text for m in self.special):
            young, word = self._words.young.get, self._word
            parts = [young(w) or word(w) for w in self._split(text)]
        else:
            parts, at = [], 0
            for m in self.marks.finditer(text):
                parts += map(self._word, self._split(text[at : m.start()]))
                parts.append(self._held([self.special[m[0]]]))
                at = m.end()
            parts += map(self._word, self._split(text[at:]))
        return parts

    @staticmethod
    def _split(text: str) -> list[str]:
        flat = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter by itself: no final sigma
        return _WORDS.findall(flat.lower())

    def encode(self, text: str) -> list[int]:
        return [int(i) for n, ids, _ in self._parts(text) if n for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids joined by a space, SHA-256 of the decoded text."""
        parts = [p for p in self._parts(text) if p[0]]
        sha = lambda k: hashlib.sha256(" ".join([p[k] for p in parts]).encode()).hexdigest()
        return sum(p[0] for p in parts), sha(1), sha(2)


class IdBpe(Bpe):
    """For ids alone: the tables hold the ids of a word, which are objects of the vocabulary, and no strings made of them."""

    def _held(self, ids: list[int]) -> tuple:
        return tuple(ids)

    def _joined(self, parts: list[tuple]) -> tuple:
        return tuple(chain.from_iterable(parts))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self._parts(text)))


@lru_cache(maxsize=2)
def _loaded(source: str, kind: type[Bpe]) -> Bpe:
    return kind(source)


def _source(spark, vocabulary: str):
    with open(vocabulary, encoding="utf-8") as f:
        source = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(source) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file over {MOST_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(source)


def _map(docs: DataFrame, vocabulary: str, names: list[str], schema: str, fn, kind: type[Bpe] = IdBpe) -> DataFrame:
    source = _source(docs.sparkSession, vocabulary)

    def run(batch: pa.RecordBatch):
        yield fn(_loaded(source.value, kind), batch)

    return arrow_map(docs.select(*names), run, schema, 512, lambda: _loaded(source.value, kind).forget())


def token_digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""

    def fn(bpe: Bpe, batch: pa.RecordBatch) -> dict:
        found = [bpe.digest(t or "") for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_tokens": pa.array([f[0] for f in found], pa.int64()), "ids_sha256": pa.array([f[1] for f in found], pa.string()), "decoded_sha256": pa.array([f[2] for f in found], pa.string())}

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _map(plain, vocabulary, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", fn, Bpe)


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (array<int>) for every row."""

    def fn(bpe: Bpe, batch: pa.RecordBatch) -> dict:
        ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))}

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _map(plain, vocabulary, ["doc_id", "text"], "doc_id long, n_tokens long, ids array<int>", fn)


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 (of the text decoded from the ids) for every row."""

    def fn(bpe: Bpe, batch: pa.RecordBatch) -> dict:
        ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
        sha = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]
        return {"doc_id": batch.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded_sha256": pa.array(sha, pa.string())}

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _map(plain, vocabulary, ["doc_id", "text"], "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", fn)


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and decoded text for every row of ids; null ids give the empty text."""

    def fn(bpe: Bpe, batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "text": pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())}

    plain = encoded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).alias("ids"))
    return _map(plain, vocabulary, ["doc_id", "ids"], "doc_id long, text string", fn)
