import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe, pfor, token_counts, token_output, tokenizers_io
from quarry.llm.common import shared_folder

WORD_BPE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBPE(RANKS, P.PATTERN)


def rows(df):
    return df.collect()


@pytest.mark.parametrize("values", [[], [0], [5] * 300, list(range(1000)), [2**32 - 1, 0] * 130, [7] * 127 + [2**31]])
def test_packed_blocks_round_trip(values):
    a = np.array(values, np.uint32)
    file = pfor.Packed(pfor.pack([3, None], [len(a), 0], a))
    assert file.values().tolist() == values and file.doc_ids == [3, None] and file.lengths.tolist() == [len(a), 0]
    for start, stop in ((0, 1), (127, 129), (128, 256), (len(a), len(a))):
        assert file.values(start, min(stop, len(a))).tolist() == values[start : min(stop, len(a))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50), max_size=700))
def test_packed_blocks_round_trip_any(values):
    assert pfor.Packed(pfor.pack([1], [len(values)], np.array(values, np.uint32))).values().tolist() == values


def test_outliers_do_not_widen_a_block():
    a = np.full(128 * 50, 9, np.uint32)
    a[::128] = 40_000
    file = pfor.Packed(pfor.pack([0], [len(a)], a))
    assert set(file.width.tolist()) == {0} and len(file.position) == 50 and (file.values() == a).all()


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_files_hold_what_the_library_gives(spark, library, which, request):
    docs = request.getfixturevalue(which)
    got = rows(token_output.token_files(docs, shared_folder(spark, "t"), WORD_BPE))
    texts = sorted(((r.doc_id, r.text or "") for r in rows(docs)), key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, {}
    for doc_id, text in texts:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        want[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(texts)


def test_files_split_between_documents(spark, documents):
    whole = {tuple(r)[:4] for r in rows(token_output.token_files(documents, shared_folder(spark, "t"), WORD_BPE))}
    got = rows(token_output.token_files(documents, shared_folder(spark, "t"), WORD_BPE, file_values=3000))
    assert {tuple(r)[:4] for r in got} == whole and len({r.file for r in got}) > 10


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_byte_bpe_is_as_the_library(spark, tik, which, request):
    docs = request.getfixturevalue(which)
    want = {r.doc_id: (r.text or "", tik.encode_ordinary(r.text or "")) for r in rows(docs)}
    got = rows(bpe.encode_documents(docs, RANKS, P.PATTERN, keep_ids=True))
    assert len(got) == len(want)
    for r in got:
        text, ids = want[r.doc_id]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_is_as_the_library_on_any_text(tik, coder, text):
    ids = coder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_perfect_hash_is_minimal(coder):
    h = coder.hash
    assert h.n == len(coder.bytes_of) and sorted(map(h.slot, h.keys)) == list(range(h.n))
    assert h.slot(b"not a vocabulary entry at all") == -1 and bpe.PerfectHash([]).slot(b"a") == -1


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_counts_are_the_library_s(spark, library, which, request):
    docs = request.getfixturevalue(which)
    want = {r.doc_id: (len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows(docs)}
    got = rows(token_counts.count_tokens(docs, WORD_BPE))
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(want)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_counts_take_only_the_expected_kind(none):
    with pytest.raises(ValueError):
        token_counts.count_tokens(none, P.path("piece_bpe_32k.model"))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 70_000), st.integers(1, 500), max_size=20), max_size=8))
def test_uses_round_trip(docs):
    ends = np.cumsum([len(d) for d in docs], dtype=np.int64) if docs else np.array([], np.int64)
    codes, times = ([x for d in docs for x in f(d)] for f in (dict.keys, dict.values))
    got = token_counts.unpack_uses(token_counts.pack_uses(ends, np.array(codes, np.int64), np.array(times, np.int64)))
    assert [x.tolist() for x in got] == [ends.tolist(), list(codes), list(times)]


def test_no_rows(spark, none):
    assert token_output.token_files(none, shared_folder(spark, "t"), WORD_BPE).count() == 0
    assert bpe.encode_documents(none, RANKS, P.PATTERN).count() == 0
    assert token_counts.count_tokens(none, WORD_BPE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sS.,!#|<>é’ñİΣ̈1_-\x01\x1f "), min_size=1, max_size=8) | st.sampled_from(["<|endoftext|>", "x<|startoftext|>.", "<|ENDOFTEXT|>", "it's.", "we'LL!!"]), max_size=12))
def test_words_are_as_the_library_s(library, words):
    text = " ".join(words)
    ids = tokenizers_io.word_encoder(WORD_BPE).encode(text.encode())
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_come_back_from_the_old_generation(library, monkeypatch):
    monkeypatch.setattr(tokenizers_io, "MEMO_WORDS", 50)
    monkeypatch.setattr(tokenizers_io, "LEARN", 20)
    own = tokenizers_io.WordEncoder(WORD_BPE)
    texts = [" ".join(f"word{i * j % 97}." for j in range(1, 40)) for i in range(1, 30)]
    got = own.encode_all([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_plain_letters_need_no_normalizer_and_no_pattern(library):
    own, text = tokenizers_io.WordEncoder(WORD_BPE), "The straße naïve THE\nzeileñ ÿ"
    own.library = None
    assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_each_distinct_word_of_many_texts_is_looked_up_once(monkeypatch):
    own, asked = tokenizers_io.WordEncoder(WORD_BPE), []
    recall = own.recall
    monkeypatch.setattr(own, "recall", lambda words: asked.extend(words) or recall(words))
    own.encode_all([b"stone river, Stone river, cloud!"] * 50)
    assert sorted(asked) == [b"!", b",", b"cloud", b"river", b"stone"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abßéÿÀ÷×ñ\u0301\u0338ﬁΣ.,'s<|_9\x01\x85\u00a0 \n\v\x1c"), max_size=30) | st.sampled_from(["", "<|endoftext|>. a", "a<|ENDOFTEXT|>, b"]), max_size=6), st.sampled_from([1, 5, 1 << 23]))
def test_texts_cut_at_spaces_are_as_the_library_s(library, texts, group):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tokenizers_io, "GROUP", group)
        got = tokenizers_io.word_encoder(WORD_BPE).encode_all([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
