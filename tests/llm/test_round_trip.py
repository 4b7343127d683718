"""The last stage of the pipeline decodes what it encodes."""

import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from pacekeeper.llm.queries import vocabulary_path
from tests.llm.test_core import ODD, frame


def test_last_stage_decodes(spark):
    lib = Tokenizer.from_file(vocabulary_path())
    rows = {r.doc_id: r for r in corpus_pipeline.tokens(spark, frame(spark, ODD), "").collect()}
    for i, t in enumerate(ODD):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want = lib.decode(ids, skip_special_tokens=False)
        assert (rows[i].ids, rows[i].n_tokens, rows[i].decoded_sha256) == (ids, len(ids), hashlib.sha256(want.encode()).hexdigest())
