"""The pipeline's stages against brute force, and the library without the operators."""

import os
import shutil
import subprocess
import sys

from tokenizers import Tokenizer

import corpus_pipeline
from pacekeeper.llm import decontaminate
from pacekeeper.llm.queries import vocabulary_path
from tests.llm.test_core import DOC, slow_hits

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def similar_components(rows):
    """Least doc_id of the texts that hang together by 0.8 of their five-word shingles, for rows (doc_id, text) in order."""
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    of = {d: d for d, _ in rows}
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((of[rows[i][0]], of[rows[j][0]]))
                of = {d: x if c == y else c for d, c in of.items()}
    return of


def plain_pipeline(rows, items):
    """doc_id -> text before encoding, over rows (doc_id, text)."""
    rows = [(d, t) for d, t in rows if t and any(map(str.isalpha, t))]
    last = {}
    for d, t in rows:
        last[t] = max(last.get(t, d), d)
    rows = sorted((d, t) for t, d in last.items())
    comp = similar_components(rows)
    rows = [r for r in rows if comp[r[0]] == r[0]]
    seqs = [(str(i), decontaminate.words((t or "").encode())) for i, t in items]
    out = {}
    for d, t in rows:
        seq = decontaminate.words(t.encode())
        hit, _ = slow_hits(seq, seqs, 10)
        if len(hit) > 0.5 * len(seq):
            continue
        runs, spans = sorted(hit), []
        for p in runs:
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out[d] = decontaminate.strip_spans(t.encode(), [tuple(s) for s in spans]).decode()
    return out


def test_run_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain_pipeline(docs, items)
    assert any(want[d] != t for d, t in docs if d in want) and len(want) < len(docs)
    lib = Tokenizer.from_file(vocabulary_path())
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: lib.encode(t, add_special_tokens=False).ids for d, t in want.items()}


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, "a b c", "en", "s", 5), (2, None, "en", "s", 0), (3, "", None, None, None), (None, "d e f", "en", "s", 5), (1, "a b c", "en", "s", 5), (4, "x " * 5000, "fr", "s", 9)]
    docs = spark.createDataFrame(rows, DOC)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.schema["n_chars"].dataType.simpleString() == "bigint", name
    assert sorted((r.doc_id or 0, r.n_tokens) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()) == [(0, 3), (1, 3), (4, 5000)]
    empty = spark.createDataFrame([], DOC)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_stages_take_clashing_columns(spark):
    names = ["_id", "_sha", "_hash", "_text_hash", "spans", "fp", "root", "row", "recipe", "kept", "component_id", "text_hash", "lang_pred", "_n", "_gone"]
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (3, "A b c", "en", "s", 5)], DOC).selectExpr("*", *[f"'{n}' as `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, before = stage(spark, docs, SF), docs
        assert docs.columns == before.columns, name
    assert [r.asDict()["_id"] for r in docs.collect()] == ["_id"] and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 1


def test_library_works_without_these_operators(tmp_path):
    for name in ("pacekeeper", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "pacekeeper" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pair_construct' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
