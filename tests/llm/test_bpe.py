import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowtide.llm import bpe


@pytest.fixture(scope="module")
def both():
    return bpe.load(bpe.default_path()), Tokenizer.from_file(bpe.default_path())


TEXT = st.one_of(st.text(max_size=60), st.text(alphabet="abthein gs'\n\t é \u0085\x1c0123<|endoftext|>", max_size=80))


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_equal_to_the_library(text):
    mine, theirs = bpe.load(bpe.default_path()), _library()
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == text


_cache = []


def _library():
    if not _cache:
        _cache.append(Tokenizer.from_file(bpe.default_path()))
    return _cache[0]


def test_long_piece(both):
    text = "abcdefgh" * 5000
    assert both[0].encode(text) == both[1].encode(text, add_special_tokens=False).ids


def test_broken_bytes(both):
    ids = both[1].encode("é\U0001f600", add_special_tokens=False).ids
    assert both[0].decode(ids[1:2]) == both[1].decode(ids[1:2], skip_special_tokens=False)


def test_documents(odd, odd_rows, empty, both):
    got = bpe.encode_and_decode(odd).collect()
    want = sorted((r[0] or -1, hashlib.sha256(",".join(map(str, both[1].encode(r[1] or "", add_special_tokens=False).ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in odd_rows)
    assert sorted((r["doc_id"] or -1, r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert bpe.encode_and_decode(empty).count() == 0
    assert bpe.encode_documents(odd.where("doc_id = 6")).first()["ids"] == both[1].encode("one two").ids
