import hashlib
import re
from collections import Counter, namedtuple

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline

from .test_rows import measured, targets
from .test_similarity import classes, gone, shingles
from .test_tokens import RANKS, tik  # noqa: F401

Row = namedtuple("Row", "doc_id text lang source n_chars")


@pytest.fixture(scope="module")
def stages(spark, documents, small):
    out, docs = [documents], documents
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, small).cache()
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    for docs in stages[1:-1]:
        assert docs.schema == stages[0].schema


def test_each_stage_as_by_brute_force(stages, tik):  # noqa: F811
    docs, quality, lines, near, mixed, tokens = (s.collect() for s in stages)
    failed = {r.doc_id: (m := measured(r.text or ""))[0] < 20 or 100 * m[4] > 30 * m[0] for r in docs}
    assert {r.doc_id for r in quality} == {d for d, f in failed.items() if not f}
    removed = gone(quality)
    cut = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in removed) for r in quality}
    assert {r.doc_id: (r.text, r.n_chars) for r in lines} == {d: (t, len(t)) for d, t in cut.items()}
    assert {r.doc_id for r in near} == set(classes({d: shingles(t, 5, True) for d, t in cut.items()}, 80).values())
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in near}
    total = Counter()
    for r in near:
        total[r.source] += size[r.doc_id]
    want, taken = targets(total), Counter()
    for r in mixed:
        taken[r.source] += size[r.doc_id]
    assert all(abs(taken[s] - want[s]) <= max(size[r.doc_id] for r in near if r.source == s) / 2 + 1 for s in want)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    ids = {r.doc_id: tik.encode_ordinary(r.text) for r in near}
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in tokens) == Counter((r.doc_id, len(ids[r.doc_id]), hashlib.sha256(np.array(ids[r.doc_id], "<u4").tobytes()).hexdigest()) for r in mixed)


def test_run_is_the_stages(spark, stages, small):
    assert Counter(map(tuple, corpus_pipeline.run(spark, small).collect())) == Counter(map(tuple, stages[-1].collect()))


def test_odd_documents_pass_through(spark, odd, none, small):
    for docs in (odd, none):
        for _, f in corpus_pipeline.STAGES[:-1]:
            schema = docs.schema
            docs = f(spark, docs, small)
            assert docs.columns == schema.names
        corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
