"""The class language model against a plain reading of its formulas."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pacekeeper.llm import class_lm
from pacekeeper.llm.base import Scratch
from tests.llm.test_core import ODD, frame


def toks(t):
    return [*(t or "").encode().lower().split(), class_lm.END]


def texts_of(seed, n=60):
    """Two languages whose words alternate between two kinds."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        side = rng.choice("xy")
        out.append(" ".join(f"{side}{'ab'[i % 2]}{rng.randrange(4)}" for i in range(rng.randrange(3, 40))))
    return out


def plain_scores(texts, train, of, classes):
    """score of each text by the formulas, from classes by word."""
    counts = Counter(w for t, on in zip(texts, train) if on for w in toks(t))
    m, after_once, before_once = np.zeros((classes, classes)), np.zeros(classes + 1), np.zeros(classes)
    for t, on in zip(texts, train):
        if on:
            seq = [class_lm.END, *toks(t)]
            for a, b in zip(seq, seq[1:]):
                m[of[a], of[b]] += 1
                after_once[of[a]] += counts[b] == 1
                before_once[of[b]] += counts[a] == 1
                after_once[classes] += counts[a] == counts[b] == 1
    mass = Counter()
    for w, n in counts.items():
        mass[of[w]] += n
    rows = [*m, before_once]

    def step(a, b):
        row = rows[a]
        left = row.sum()
        unseen = (after_once[a] + 0.5) / (left + 1)
        if b == classes:
            return unseen
        share = (m[:, b].sum() + 1) / (m.sum() + classes)
        keep = left / (left + (row > 0).sum()) if left else 0
        return (1 - unseen) * ((keep * row[b] / left if left else 0) + (1 - keep) * share)

    out = []
    for t in texts:
        seq = [class_lm.END, *toks(t)]
        cls = [of.get(w, classes) for w in seq]
        out.append(sum(math.log10(step(a, b) * (counts[w] / mass[b] if w in counts else 1)) for a, b, w in zip(cls, cls[1:], seq[1:])))
    return out


@pytest.mark.parametrize("most_words", [1 << 17, 6])
@pytest.mark.parametrize("light", [1 << 17, 5])
def test_scores_follow_the_formulas(spark, monkeypatch, most_words, light):
    texts = texts_of(1) + ODD + ["rare one", "never seen", "never twice never", "rare two " * 3]
    df = frame(spark, texts).selectExpr("*", "1 as row", "2 as word", "3 as seq", "4 as first")
    seen = {}
    words_of, classes_of, tail_of = class_lm._kept_words, class_lm.exchange, class_lm._tail_classes

    def kept_words(*a):
        seen["words"] = words_of(*a)
        return seen["words"]

    def exchanged(*a):
        seen["result"] = classes_of(*a)
        return seen["result"]

    def tail(*a):
        found = tail_of(*a)
        seen["tail"] = {bytes(r.word): (r.n, r["class"]) for r in found.collect()}
        return found

    monkeypatch.setattr(class_lm, "_kept_words", kept_words)
    monkeypatch.setattr(class_lm, "exchange", exchanged)
    monkeypatch.setattr(class_lm, "_tail_classes", tail)
    rows = {r.doc_id: r for r in class_lm.score(df, F.col("doc_id") % 3 != 0, classes=4, most_words=most_words, rounds=3, light=light).collect()}
    train = [i % 3 != 0 for i in range(len(texts))]
    counts = Counter(w for t, on in zip(texts, train) if on for w in toks(t))
    n, v = sum(counts.values()), len(counts)
    assert len(seen["words"]) == min(v, most_words) if most_words > 6 else len(seen["words"]) <= 6
    of = {w: int(c) for (w, _), c in zip(seen["words"], seen["result"][0])}
    assert {w: c[0] for w, c in seen["tail"].items()} == {w: c for w, c in counts.items() if w not in of}
    of |= {w: c[1] for w, c in seen["tail"].items()}
    assert set(of) == set(counts) and all(0 <= c < 4 for c in of.values())
    want = plain_scores(texts, train, of, 4)
    for i, t in enumerate(texts):
        r, seq = rows[i], toks(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[i], len(seq), sum(counts[w] > 0 for w in seq), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in seq))
        assert r.score == pytest.approx(want[i])


def test_words():
    texts = ODD + [" a\tB\n\x0bc \x1cd\x85\u00a0e  ", "\n", "ÄÖ Z"]
    flat, sizes = class_lm.words(pa.array(texts, pa.string()))
    assert flat.to_pylist() == [w for t in texts for w in toks(t)[:-1]] and sizes.tolist() == [len(toks(t)) - 1 for t in texts]


def test_probabilities_add_up():
    x = class_lm.Model(np.array([[3, 2, 1], [1, 0, 2], [1, 2, 0]], float), np.array([1.0, 0, 2]), np.array([2.0, 1, 0]), 1.0)
    assert np.allclose((10.0**x.transition).sum(axis=1), 1) and x.transition.shape == (4, 4)
    assert np.allclose(10.0**x.mass, [5, 4, 3, 1])
    assert np.allclose((10.0 ** class_lm.Model(np.zeros((2, 2)), np.zeros(2), np.zeros(2), 0.0).transition).sum(axis=1), 1)


def class_pairs(seqs, of, k):
    m = np.zeros((k, k))
    for s in seqs:
        for a, b in zip(s, s[1:]):
            m[of[a], of[b]] += 1
    return m


def test_gain_of_a_move_is_the_change_in_likelihood():
    rng = random.Random(5)
    n, k = 12, 5
    seqs = [[0, *(rng.randrange(n) for _ in range(rng.randrange(30))), 0] for _ in range(20)] + [[3, 3, 3, 3, 4, 4]]
    of = np.array([rng.randrange(k) for _ in range(n)])
    m = class_pairs(seqs, of, k)
    left, right, own = np.zeros((n, k)), np.zeros((n, k)), np.zeros(n)
    for s in seqs:
        for a, b in zip(s, s[1:]):
            right[a, of[b]] += 1
            left[b, of[a]] += 1
            own[a] += a == b
    gains = class_lm.move_gains(m, of, left, right, own)
    for w in range(n):
        for c in range(k):
            moved = of.copy()
            moved[w] = c
            assert gains[w, c] == pytest.approx(class_lm._likelihood(class_pairs(seqs, moved, k)) - class_lm._likelihood(m), abs=1e-9)


def plain_exchange(seqs, n_ids, classes, rounds, half_of):
    """Rounds of exact moves of one half of the words against brute-force counts."""
    k = classes + 1
    of = np.arange(n_ids) % classes
    of[-1] = classes
    m = class_pairs(seqs, of, k)
    history, failed, whole = [class_lm._likelihood(m)], 0, [True, True]
    for i in range(rounds):
        wanted = of.copy()
        for w in range(n_ids - 1):
            if half_of[w] == i % 2:
                gains = []
                for c in range(classes):
                    moved = of.copy()
                    moved[w] = c
                    gains.append(class_lm._likelihood(class_pairs(seqs, moved, k)) - history[-1])
                if max(gains) > 1e-6:
                    wanted[w] = int(np.argmax(np.round(gains, 6)))
        moved = np.flatnonzero(wanted != of)
        raised = False
        for shares in [(1,), (2, 4)] if whole[i % 2] else [(2, 4)]:
            tried = []
            for share in shares:
                new = of.copy()
                some = [w for w in moved if ((int(w) * 2654435761 % 2**32) >> 16) & (share - 1) == 0]
                new[some] = wanted[some]
                tried.append((class_lm._likelihood(class_pairs(seqs, new, k)), -share, new))
            now, _, new = max(tried, key=lambda x: x[:2])
            if now > history[-1] + 1e-9:
                of, raised = new, True
                history.append(now)
                break
            whole[i % 2] = False
        failed = 0 if raised else failed + 1
        if failed == 2:
            break
    return of, history


def neighbours(spark, df, kept, light):
    rows = class_lm._encoded(df.selectExpr("doc_id", "text", "true as train"), kept, 1, 1)
    return class_lm._neighbours(rows, kept, Scratch(spark, "t"), light)


@pytest.mark.parametrize("light", [1 << 17, 20])
def test_exchange_against_brute_force(spark, light):
    texts = texts_of(2, 40)
    df = frame(spark, texts)
    kept = class_lm._kept_words(class_lm._counts(df, "text"), 1000, 64)
    ids = {w: i for i, (w, _) in enumerate(kept)}
    views = neighbours(spark, df, kept, light)
    half_of = {w: r.half % 2 for r in views.select("w", "half").collect() for w in np.frombuffer(r.w, np.int32).tolist()}
    assert any(r.half in (2, 3) for r in views.select("half").collect()) == (light == 20)
    of, m, history = class_lm.exchange(views, len(kept) + 1, 4, 8)
    seqs = [[ids[class_lm.END], *(ids[w] for w in toks(t))] for t in texts]
    want, likelihoods = plain_exchange(seqs, len(kept) + 1, 4, 8, half_of)
    assert (m == class_pairs(seqs, of, 5)).all()
    assert history == sorted(history) and history == pytest.approx(likelihoods) and (of == want).all()


def test_exchange_does_not_depend_on_files(spark):
    df = frame(spark, texts_of(2, 200))
    kept = class_lm._kept_words(class_lm._counts(df, "text"), 1000, 64)
    views = neighbours(spark, df, kept, 50)
    of, _, history = class_lm.exchange(views, len(kept) + 1, 4, 8)
    sides = defaultdict(set)
    for (w, _), c in zip(kept, of):
        if w != class_lm.END:
            sides[int(c)].add(w[:2])
    assert np.mean([len(s) for s in sides.values()]) < 4
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        again, _, other = class_lm.exchange(views, len(kept) + 1, 4, 8)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (again == of).all() and other == pytest.approx(history)


def test_kept_words_fill_their_places(spark):
    rows = [(b"w%d" % i, 1 + i // 50) for i in range(1000)] + [(class_lm.END, 3), (b"x" * 200, 10**6)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    for most in (1, 10, 333, 900, 1001, 2000):
        kept = class_lm._kept_words(counts, most, 128)
        assert most * 0.9 - 1 <= len(kept) <= most or len(kept) == 1001
        assert (class_lm.END, 3) in kept
        least = min(n for w, n in kept)
        assert sum(n > least for w, n in kept if w != class_lm.END) == sum(n > least for w, n in rows[:1000]) or least == 3


def test_model_beats_its_base_on_held_out_texts(spark):
    df = frame(spark, texts_of(3, 300))
    got = class_lm.score(df, F.col("doc_id") % 5 != 0, classes=4).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_without_training_rows(spark):
    rows = class_lm.score(frame(spark, ["a b", None]), F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in rows] == [(0, 0, 0.0), (0, 0, 0.0)] and all(r.score <= 0 for r in rows)
    assert class_lm.score(frame(spark, []), F.lit(True)).count() == 0
