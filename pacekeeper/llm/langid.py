"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams of the lower-cased text in which everything but
letters is one space; a feature's value is its share of the text's n-grams times its inverse
document frequency. Weights are learnt by follow-the-regularised-leader with elastic-net
penalties on a bounded sample of the labelled rows, and the softmax is calibrated by one
temperature on a part of that sample which the weights have not seen.

Limits (parameters): the ``most_langs`` most frequent labels are learnt, others are not and never
predicted; at most about ``sample`` rows of together at most ``sample_chars`` characters for
fitting, shared evenly over the languages and chosen by a hash of the key (a text that does not fit
into what is left is passed over); 2^``bits`` features. Document frequencies count all labelled
training rows, and prediction reads every whole text. The model (features x languages floats) is
broadcast; its size is fixed by parameters.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null
or empty label are not learnt from; without any labelled row everything is ``und``; one
language is predicted with score 1. Only the text enters a prediction. Input columns other
than key, text and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pacekeeper.llm.base import arrow_map

UNKNOWN = "und"
SAMPLE, SAMPLE_CHARS, BITS, MOST_LANGS, EPOCHS = 4000, 20_000_000, 16, 256, 3
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_STEP = 200_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after a 0, with runs of other than letters between them as one 0; and each text's start."""
    raw = np.frombuffer("\n".join(["", *(t.lower().replace("\n", " ") for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = raw == 10
    code = np.where(_letters()[raw], raw, np.uint32(0))
    keep = mark | (code != 0)
    keep[1:] |= code[:-1] != 0
    code, mark = code[keep], mark[keep]
    keep = np.ones(len(code), bool)  # neither first nor last in a text may be a space
    keep[:-1] &= mark[:-1] | (code[:-1] != 0) | ~mark[1:]
    code, mark = code[keep], mark[keep]
    return code, np.flatnonzero(mark)


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams and the start of each text among them (with the end)."""
    code, starts = _codes(texts)
    n = len(code)
    one = code * _PRIMES[0]
    owner = np.searchsorted(starts, np.arange(n), side="right") - 1
    rows, feats = [], []
    h = np.zeros(n, np.uint32)
    for k in range(3):
        if n <= k:
            break
        h = h[: n - k] * np.uint32(31) + (one[k:] ^ (one[k:] >> np.uint32(15))) * _PRIMES[1] + _PRIMES[2]
        ok = owner[: n - k] == owner[k:]
        if k == 0:
            ok = ok & (code != 0)
        else:
            ok = ok & ((code[: n - k] != 0) | (code[k:] != 0))
        mixed = (h ^ (h >> np.uint32(13))) * _PRIMES[0]
        feats.append((mixed >> np.uint32(32 - bits))[ok].astype(np.int32))
        rows.append(owner[: n - k][ok])
    row = np.concatenate(rows) if rows else np.empty(0, np.int64)
    feat = np.concatenate(feats) if feats else np.empty(0, np.int32)
    order = np.argsort(row, kind="stable")
    return feat[order], np.searchsorted(row[order], np.arange(len(texts) + 1))


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, bits: int) -> None:
        self.langs, self.weights, self.bias, self.temperature, self.bits = langs, weights, bias, temperature, bits

    def logits(self, texts: list[str]) -> np.ndarray:
        feat, at = grams(texts, self.bits)
        out = np.tile(self.bias, (len(texts), 1)).astype(np.float64)
        full = np.flatnonzero(at[1:] > at[:-1])
        if len(full):
            sums = np.add.reduceat(self.weights[feat], at[full], axis=0, dtype=np.float64)
            out[full] += sums / (at[full + 1] - at[full])[:, None]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        z = self.logits(texts) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.langs[i] for i in best], p[np.arange(len(best)), best].clip(0, 1).tolist()


def _portions(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of neighbouring texts, at most ``_STEP`` characters together unless one is longer."""
    some, size = [], 0
    for i, t in enumerate(texts):
        if some and size + len(t) > _STEP:
            yield some
            some, size = [], 0
        some.append(i)
        size += len(t)
    if some:
        yield some


def document_frequencies(docs: DataFrame, text: str = "text", bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many of all texts each feature occurs, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(0).slice(at, 512).to_pylist()
                total[-1] += len(texts)
                for some in _portions(texts):
                    feat, starts = grams([texts[i] for i in some], bits)
                    row = np.repeat(np.arange(len(some), dtype=np.int64), np.diff(starts))
                    both = np.sort(row << bits | feat)
                    first = np.ones(len(both), bool)
                    first[1:] = both[1:] != both[:-1]
                    total[:-1] += np.bincount(both[first] & ((1 << bits) - 1), minlength=1 << bits)
            pa.default_memory_pool().release_unused()
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["feature", "n"])

    rows = docs.select(F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # at most 2^bits + 1 rows
    out = np.zeros((1 << bits) + 1)
    out[rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return out[:-1], int(out[-1])


def fit(texts: list[str], labels: list[str], frequencies: tuple[np.ndarray, int] | None = None, bits: int = BITS, epochs: int = EPOCHS, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 7) -> Model | None:
    """Weights of the sample; ``frequencies`` are those of all texts, by default of the sample."""
    langs = sorted(set(labels))
    if not langs:
        return None
    if len(langs) == 1:
        return Model(langs, np.zeros((1 << bits, 1), np.float32), np.zeros(1), 1.0, bits)
    size = 1 << bits
    data = []
    df = np.zeros(size)
    for some in _portions(texts):
        feat, at = grams([texts[i] for i in some], bits)
        for a, b in zip(at, at[1:]):
            f, c = np.unique(feat[a:b], return_counts=True)
            df[f] += 1 if frequencies is None else 0
            data.append((f, (c / max(1, c.sum())).astype(np.float32)))
    df, n_texts = frequencies or (df, len(texts))
    idf = np.log((1 + n_texts) / (1 + df)) + 1
    y = np.array([langs.index(x) for x in labels])
    order = np.random.default_rng(seed).permutation(len(texts))
    held = order[: len(order) // 5] if len(order) >= 20 else order
    learn = order[len(order) // 5 :] if len(order) >= 20 else order
    z, n = np.zeros((size + 1, len(langs))), np.zeros((size + 1, len(langs)))

    def weights(rows: np.ndarray) -> np.ndarray:
        zr = z[rows]
        w = (np.sign(zr) * l1 - zr) / ((beta + np.sqrt(n[rows])) / alpha + l2)
        return np.where(np.abs(zr) <= l1, 0.0, w)

    rng = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        for i in rng.permutation(learn):
            f, tf = data[i]
            rows = np.append(f, size)
            x = np.append(tf * idf[f] * 20.0, 1.0)
            w = weights(rows)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - sigma * w
            n[rows] += g * g
    w = weights(np.arange(size + 1))
    model = Model(langs, (w[:size] * idf[:, None] * 20.0).astype(np.float32), w[size], 1.0, bits)
    tests = [texts[i] for i in held]
    raw = np.concatenate([model.logits([tests[i] for i in some]) for some in _portions(tests)])
    yh = y[held]

    def loss(t: float) -> float:
        s = raw / t
        m = s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s - m).sum(axis=1)) + m[:, 0] - s[np.arange(len(yh)), yh]).mean())

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    model.temperature = float(min(grid, key=loss))
    return model


def train(docs: DataFrame, rows: Column, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, bits: int = BITS, most_langs: int = MOST_LANGS) -> Model | None:
    """Fits on about ``sample`` labelled rows of ``docs`` among ``rows``."""
    known = docs.filter(rows & F.col(text).isNotNull() & (F.coalesce(F.col(label), F.lit("")) != "")).select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    found = {r["label"]: (r["n"], r["chars"]) for r in known.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.least(F.length("text"), F.lit(max(1, sample_chars // 1000)))).alias("chars")).orderBy(F.desc("n"), "label").limit(most_langs).collect()}
    if not found:
        return None
    each = max(16, sample // len(found))
    # A share of each language by a hash of its keys: no sort and no language in one task.
    share = F.create_map(*[F.lit(v) for lang, (n, chars) in found.items() for v in (lang, min(1.0, each / n, sample_chars / len(found) / max(1.0, n * chars)))])
    part = (F.xxhash64("k", F.lit(17)).bitwiseAND(F.lit(2**52 - 1)) / float(2**52)) < F.coalesce(share[F.col("label")], F.lit(0.0))
    drawn = known.filter(part).withColumns({"order": F.xxhash64("k", F.lit(18)), "name": F.xxhash64("text"), "chars": F.length("text")})
    # Sizes come first, so that what comes to the driver is bounded in characters.
    listed = drawn.select("order", "k", "name", "chars").orderBy("order", "k", "name").limit(2 * sample + most_langs).collect()
    left, names = sample_chars, []
    for r in listed:
        if r["chars"] <= left:
            left -= r["chars"]
            names.append((r["order"], r["k"], r["name"]))
    wanted = docs.sparkSession.createDataFrame(sorted(set(names), key=repr), "order long, k string, name long")
    on = drawn["order"].eqNullSafe(wanted["order"]) & drawn["k"].eqNullSafe(wanted["k"]) & drawn["name"].eqNullSafe(wanted["name"])
    got = drawn.join(F.broadcast(wanted), on, "left_semi").select("order", "k", "text", "label").limit(len(names)).collect()
    got = sorted(got, key=lambda r: (r["order"], r["k"] or "", r["text"], r["label"]))
    if not got:
        return None
    return fit([r["text"] for r in got], [r["label"] for r in got], document_frequencies(known, "text", bits), bits)


def _predicted(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    todo = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model is not None else []
    found = [texts[i] for i in todo]
    for some in _portions(found):
        for i, lang, score in zip(some, *model.predict([found[i] for i in some])):
            langs[todo[i]], scores[todo[i]] = lang, score
    return langs, scores


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        langs, scores = _predicted(shared.value, batch.column(1).to_pylist())
        yield {"doc_id": batch.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}

    return arrow_map(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, lang_pred string, score double", 512)


def drop_unidentified(docs: DataFrame, model: Model | None, text: str = "text", least_score: float = 0.0) -> DataFrame:
    """``docs`` without rows that are ``und`` or score below ``least_score``; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                langs, scores = _predicted(shared.value, part.column(place).to_pylist())
                yield part.filter(pa.array([lang != UNKNOWN and s >= least_score for lang, s in zip(langs, scores)], pa.bool_()))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
