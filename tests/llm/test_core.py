"""Sharding, exact dedup, SimHash, decontamination, BPE and language ID against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from pacekeeper.llm import bpe, decontaminate, exact_dedup, langid, sharding, simhash
from pacekeeper.llm.queries import fold, vocabulary_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, start=0):
    rows = [(i + start, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", " ", "a", "A", "a b", "a b c", "a b c", "x " * 30000, "é́ Σ ΑΣ", "\x00\x1c\x85 ", "<|endoftext|>'s don't 12½"]


# -- sharding ---------------------------------------------------------------


def test_shards_gapless_and_growth(spark):
    rows = sharding.assign_shards(frame(spark, [f"t{i}" for i in range(600)] + ODD), [1.0] * 5).collect()
    assert len(rows) == 600 + len(ODD)
    for s in range(5):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 5) for r in rows)
    assert 40 < sum(r.grown_shard == 5 for r in rows) < 180
    by_id = {r.doc_id: r for r in rows}
    for i, t in enumerate([f"t{i}" for i in range(600)] + ODD):
        body = (t or "").encode()
        assert by_id[i].size == len(body) + 8 and by_id[i].text_crc32 == zlib.crc32(body)


def test_shards_follow_weights_and_brute_force(spark):
    import math

    weights = [1.0, 3.0]
    rows = sharding.assign_shards(frame(spark, ["x"] * 800), weights).collect()

    def cost(k, s, w):
        u = (int(hashlib.md5(f"{k}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return -math.log(u) / w

    for r in rows:
        assert r.shard == min((0, 1), key=lambda s: cost(r.doc_id, s, weights[s]))
    assert 0.68 < sum(r.shard for r in rows) / len(rows) < 0.82


def test_shards_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 2), (7, "a", 3), (7, "a", 4)], "doc_id long, text string, shard int")
    rows = sharding.assign_shards(df, [1.0] * 3).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.doc_id == 7}) == 1
    assert sharding.assign_shards(df.limit(0), [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(df.doc_id, [])


# -- exact dedup ------------------------------------------------------------


def test_chunks_cover_text_and_follow_content():
    rng = np.random.default_rng(0)
    body = rng.integers(0, 256, 60000, dtype=np.uint8).tobytes()
    ends = exact_dedup.cut_points(body)
    assert ends[-1] == len(body) and ends == sorted(set(ends)) and max(np.diff([0, *ends])) <= exact_dedup.MOST
    moved = b"prefix" * 100 + body
    shared = {e + 600 for e in ends} & set(exact_dedup.cut_points(moved))
    assert len(shared) > 0.8 * len(ends)
    assert exact_dedup.cut_points(b"") == [] and exact_dedup.cut_points(b"\0" * 40000)[-1] == 40000


@pytest.mark.parametrize("bits", [128, 8])
def test_exact_groups(spark, bits):
    rng = random.Random(1)
    pool = ["".join(rng.choices("ab \n", k=rng.choice([0, 5, 700, 9000]))) for _ in range(12)]
    texts = [rng.choice(pool) for _ in range(60)] + ODD
    rows = exact_dedup.exact_dedup(frame(spark, texts), bits=bits).collect()
    assert len(rows) == len(texts)
    for r in rows:
        same = [i for i, t in enumerate(texts) if (t or "") == (texts[r.doc_id] or "")]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
        assert r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_exact_repeated_rows_and_nulls(spark):
    df = spark.createDataFrame([(5, "a"), (5, "a"), (None, "a"), (None, "b"), (5, "c")], "doc_id long, text string").selectExpr("*", "1 as kept", "2 as recipe", "3 as row")
    rows = exact_dedup.exact_dedup(df).collect()
    assert sum(r.kept for r in rows) == 3 and len(rows) == 5
    left = exact_dedup.drop_exact_copies(df)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "b"), (5, "a"), (5, "c")] and left.columns == df.columns
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_copies_go_with_one_written_table(spark, monkeypatch):
    """Each file that an executor writes starts a child of its JVM, whose memory counts twice until the child is another program."""
    written, keep = [], exact_dedup.Scratch.keep
    monkeypatch.setattr(exact_dedup.Scratch, "keep", lambda self, df, name, *parts: written.append(name) or keep(self, df, name, *parts))
    rng = random.Random(6)
    rows = [(rng.choice([None, -(2**63), *range(8)]), rng.choice(["a", "b", "", None, "c " * 3000])) for _ in range(200)]
    left = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    best = {}
    for d, t in rows:
        best[t or ""] = max(best.get(t or "", (False, 0)), (d is not None, d or 0))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in left.collect()) == sorted((v, t) for t, v in best.items())
    assert written == ["groups"]


# -- simhash ----------------------------------------------------------------


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, radius):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_groups(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choices("abcdefgh", k=n)) for n in (1, 2, 3, 4, 40, 200)]
    texts = [" ".join(rng.choice("abcdefgh") if rng.random() < 0.03 else w for w in t.split()) for t in base for _ in range(14)] + ODD
    rows = {r.doc_id: r for r in simhash.simhash_groups(frame(spark, texts)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [int(rows[i].fingerprint, 16) for i in range(len(texts))] == fps
    assert [rows[i].component_id for i in range(len(texts))] == slow_components(range(len(texts)), fps, 2)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_join_what_lies_near(spark, radius):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(8)]
    fps = list({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for s in seeds for _ in range(12)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    got = simhash.components(simhash.links(df, radius)).collect()
    root = {r.node % 2**64: r.root for r in got}
    want = slow_components(range(len(fps)), fps, radius)
    classes = {}
    for f, w in zip(fps, want):
        classes.setdefault(w, set()).add(root.get(f, f"alone{f}"))
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert len({r.root for r in simhash.components(df).collect()}) == 1


def test_near_copies_keep_one(spark):
    df = spark.createDataFrame([(3, "a b c"), (1, "A b c"), (1, "A b c"), (2, "z y x w"), (None, "q"), (9, None)], "doc_id long, text string").selectExpr("*", "1 as fp", "2 as root")
    left = simhash.drop_near_copies(df)
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "q"), (1, "A b c"), (2, "z y x w"), (9, "")]
    assert left.columns == df.columns and simhash.simhash_groups(df.limit(0)).count() == 0


# -- decontamination --------------------------------------------------------


def slow_hits(seq, items, window):
    hit, names = set(), set()
    for name, item in items:
        n = min(window, len(item))
        wins = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for p in range(len(seq) - n + 1):
            if n and tuple(seq[p : p + n]) in wins:
                hit.update(range(p, p + n))
                names.add(name)
    return hit, names


@pytest.mark.parametrize("seed", range(30))
def test_automaton_matches_brute_force(seed):
    rng = random.Random(seed)
    letters = [b"a", b"b", b"c"][: rng.choice([1, 2, 3])]
    items = [(str(i % 5), [rng.choice(letters) for _ in range(rng.randrange(12))]) for i in range(rng.randrange(1, 9))]
    model = decontaminate.Automaton(items, 5)
    for _ in range(12):
        seq = [rng.choice([*letters, b"z"]) for _ in range(rng.randrange(40))]
        spans, names = model.hits(seq)
        hit, want = slow_hits(seq, items, 5)
        assert {p for a, b in spans for p in range(a, b)} == hit and names == want
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:])) or all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("block", [400_000, 15])
def test_contamination_blocks(spark, block):
    rng = random.Random(3)
    item = [" ".join(rng.choices(["aa", "bb", "cc", "dd"], k=n)) for n in (1, 4, 12, 60, 0)] + [None]
    again = [(2, "aa aa bb bb cc cc dd dd aa bb cc dd"), (2, "e x aa bb cc dd e e e e e e e e e e e e")]  # items that share an id
    items = spark.createDataFrame([(i, t) for i, t in enumerate(item)] + [(None, "solo"), *again], "item_id long, text string").selectExpr("*", "'c' as spans", "1 as text_key")
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "e"], k=rng.randrange(30))) + " x " + rng.choice([t for t in item if t]) for _ in range(40)] + ODD + ["Solo!"]
    seqs = [(str(i), decontaminate.words((t or "").encode())) for i, t in enumerate(item)] + [("null", [b"solo"])] + [(str(i), decontaminate.words(t.encode())) for i, t in again]
    for r in decontaminate.contamination(frame(spark, texts), items, block_words=block).collect():
        seq = decontaminate.words((texts[r.doc_id] or "").encode())
        hit, names = slow_hits(seq, seqs, 10)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(seq), len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_spans_are_cut(spark):
    passage = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    long = "clean words stand here and there " * 5
    df = frame(spark, [long + passage.upper() + "! end", passage, "clean", None])
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(df, items).collect()}
    assert got == {0: long + "! end", 2: "clean", 3: None}
    assert decontaminate.contamination(df.limit(0), items).count() == 0 and decontaminate.contamination(df, items.limit(0)).filter("contaminated").count() == 0


# -- BPE --------------------------------------------------------------------


def test_bpe_equals_library(spark):
    lib = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(4)
    alphabet = "abcdeéßñ'sdt  \n\t\x1c\x85  .,!123½ΣσςΑİ日本語́🙂<|endoftext|>"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(300)] + ODD + ["supercalifragilistic" * 400, "<|startoftext|>a<|endoftext|>"]
    rows = {r.doc_id: r for r in bpe.token_digests(frame(spark, texts), vocabulary_path()).collect()}
    plain = {r.doc_id: r for r in bpe.encode(frame(spark, texts), vocabulary_path()).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert plain[i].ids == ids, repr(t)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    back = bpe.decode(bpe.encode(frame(spark, texts), vocabulary_path()), vocabulary_path())
    assert all(r.text == lib.decode(plain[r.doc_id].ids, skip_special_tokens=False) for r in back.collect())
    assert bpe.encode(frame(spark, []), vocabulary_path()).count() == 0


def test_bpe_of_repeated_rows_and_other_columns(spark):
    df = frame(spark, ["a bc", "a bc", None]).withColumn("doc_id", langid.F.lit(7).cast("long")).selectExpr("*", "'x' as ids", "1 as n_tokens", "2 as row")
    rows = bpe.token_digests(df, vocabulary_path()).collect()
    assert [r.doc_id for r in rows] == [7, 7, 7] and sorted(r.n_tokens for r in rows)[0] == 0 and len({r.ids_sha256 for r in rows}) == 2
    assert bpe.round_trip(df, vocabulary_path()).count() == 3


def test_bpe_for_ids_holds_no_strings():
    """Two workers of an executor hold such tables beside its JVM."""
    lib = Tokenizer.from_file(vocabulary_path())
    with open(vocabulary_path(), encoding="utf-8") as f:
        some = bpe.IdBpe(f.read())
    rng = random.Random(8)
    for text in ["".join(rng.choices("abcdeé'sdt  .,!12日\n\x85<|endoftext|>", k=80)) + " <|endoftext|>x" * (i % 2) for i in range(300)] + ["", " \n", "!" * 70, "don't" * 40]:
        assert some.encode(text) == lib.encode(text, add_special_tokens=False).ids, repr(text)
    held = [*some._words.young.values(), *some._pieces.young.values()]
    assert held and all(type(i) is int for found in held for i in found)


# -- language ID ------------------------------------------------------------


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(df, fold("doc_id", 4) != 2)
    rows = df.join(langid.identify(df, model).withColumnRenamed("doc_id", "k"), df.doc_id == langid.F.col("k"))
    held = rows.filter(fold("doc_id", 4) == 2).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in held) > 0.95 * len(held) and all(0 <= r.score <= 1 for r in held)


def test_language_id_odd_input(spark):
    df = spark.createDataFrame([(1, "abc abd", "x"), (2, "xyz", "y"), (3, None, "x"), (4, "12 !", "y"), (None, "abd", None), (6, "xy", "")], "doc_id long, text string, lang string")
    model = langid.train(df, langid.F.lit(True))
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert got[3] == got[4] == "und" and got[1] == "x" and got[2] == "y"
    assert sorted(r.doc_id or 0 for r in langid.drop_unidentified(df, model).collect()) == [0, 1, 2, 6]
    nothing = langid.train(df.limit(0), langid.F.lit(True))
    assert nothing is None and {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    one = langid.train(df.filter("lang = 'x'"), langid.F.lit(True))
    assert {r.score for r in langid.identify(df, one).filter("lang_pred = 'x'").collect()} == {1.0}


def test_language_id_many_languages_long_texts_and_other_columns(spark):
    rows = [(i, chr(0x3400 + 40 * (i % 300)) * 3 + " x", f"l{i % 300:03}") for i in range(1500)] + [(2000, "zq " * 200_000, "l000"), (2001, "qqq", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'a' as label", "1 as k", "2 as name", "3 as n", "4 as score", "5 as lang_pred")
    model = langid.train(df, langid.F.lit(True), sample=600, sample_chars=20_000, bits=12)
    assert len(model.langs) <= 256 and model.langs[0] == "l000"
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= set(model.langs)
    few = langid.train(df, langid.F.lit(True), most_langs=3, bits=10)
    assert few.langs == ["l000", "l001", "l002"]
    assert langid.drop_unidentified(df, few).columns == df.columns


def test_document_frequencies(spark):
    texts = ["ab", "ab ba", "", None, "c" * 500_000, "12", "ab"]
    want, n = Counter(), 0
    for t in texts:
        want.update(set(langid.grams([t or ""], 8)[0].tolist()))
    got, n = langid.document_frequencies(frame(spark, texts), "text", 8)
    assert n == len(texts) and {i: int(x) for i, x in enumerate(got) if x} == dict(want)


def plain_ftrl(texts, labels, bits, epochs, alpha, beta, l1, l2, seed):
    """Follow the regularised leader, one coordinate at a time."""
    langs = sorted(set(labels))
    rows = []
    for t in texts:
        found = Counter(langid.grams([t], bits)[0].tolist())
        rows.append({f: c / sum(found.values()) for f, c in sorted(found.items())})
    df = Counter(f for r in rows for f in r)
    idf = [math.log((1 + len(texts)) / (1 + df[f])) + 1 for f in range(1 << bits)]
    order = np.random.default_rng(seed).permutation(len(texts))
    learn = order[len(order) // 5 :]
    z, n = {}, {}

    def weight(f, c):
        v = z.get((f, c), 0.0)
        return 0.0 if abs(v) <= l1 else (math.copysign(l1, v) - v) / ((beta + math.sqrt(n.get((f, c), 0.0))) / alpha + l2)

    rng = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        for i in rng.permutation(learn):
            x = {f: v * idf[f] * 20 for f, v in rows[i].items()} | {"bias": 1.0}
            w = {(f, c): weight(f, c) for f in x for c in range(len(langs))}
            s = [sum(w[f, c] * v for f, v in x.items()) for c in range(len(langs))]
            e = [math.exp(v - max(s)) for v in s]
            for c in range(len(langs)):
                error = e[c] / sum(e) - (langs[c] == labels[i])
                for f, v in x.items():
                    g, before = error * v, n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[f, c]
                    n[f, c] = before + g * g
    return np.array([[weight(f, c) * idf[f] * 20 for c in range(len(langs))] for f in range(1 << bits)]), [weight("bias", c) for c in range(len(langs))]


def test_learner_against_plain_ftrl():
    rng = random.Random(11)
    labels = [rng.choice("xyz") for _ in range(60)]
    texts = ["".join(rng.choices({"x": "abc ", "y": "bcd ", "z": "cde "}[c], k=rng.randrange(3, 30))) for c in labels]
    model = langid.fit(texts, labels, bits=7, epochs=2, l1=0.05, l2=0.01)
    weights, bias = plain_ftrl(texts, labels, 7, 2, 2.0, 1.0, 0.05, 0.01, 7)
    assert np.allclose(model.weights, weights, rtol=1e-4, atol=1e-4) and np.allclose(model.bias, bias, atol=1e-6)
    assert (weights == 0).any() and (weights != 0).any()
    # The temperature is the best of the grid for the texts held back from the weights.
    held = np.random.default_rng(7).permutation(len(texts))[: len(texts) // 5]
    logits = np.array([[sum(weights[f, c] for f in langid.grams([texts[i]], 7)[0]) / max(1, len(langid.grams([texts[i]], 7)[0])) + bias[c] for c in range(3)] for i in held])

    def loss(t):
        return -sum(r[model.langs.index(labels[i])] / t - np.logaddexp.reduce(r / t) for i, r in zip(held, logits))

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    assert loss(model.temperature) == pytest.approx(min(map(loss, grid)), rel=1e-5)


def test_grams_do_not_cross_texts():
    feat, at = langid.grams(["ab", "", "ab c", "7 ab!"], 16)
    parts = [sorted(feat[at[i] : at[i + 1]].tolist()) for i in range(4)]
    assert parts[1] == [] and set(parts[0]) <= set(parts[2]) and parts[3] == parts[0]
