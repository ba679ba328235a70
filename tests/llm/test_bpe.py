"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

from .corpus import documents, frame, odd

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def both():
    codec = bpe.codec(bpe.tokenizer_file(NAME), public_tokenizers.PATTERN)
    return codec, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 's\n\t\r.,!12é漢 　\x1c\x85'"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    codec = bpe.codec(bpe.tokenizer_file(NAME), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_pieces(both):
    codec, library = both
    g = random.Random(2)
    for text in ("ab" * 3000, "a" * 5000, "漢" * 900, "".join(g.choice("abcde") for _ in range(4000)), " " * 3000 + "x"):
        assert codec.encode(text) == library.encode_ordinary(text)


def test_memory_is_emptied(both, monkeypatch):
    codec, library = both
    monkeypatch.setattr(bpe, "MEMORY", 10)
    text = " ".join(f"word{i}" for i in range(200))
    assert codec.encode(text) == library.encode_ordinary(text)


def test_table(spark, both):
    _, library = both
    rows = documents(count=20) + odd()
    out = bpe.encode(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    expected = sorted((str(i), library.encode_ordinary(t or ""), t or "") for i, t in rows)
    for (i, ids, text), r in zip(expected, sorted(out, key=lambda r: (str(r["doc_id"]), r["ids"]))):
        assert (str(r["doc_id"]), r["ids"], r["n_tokens"]) == (i, ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(frame(spark, [])).count() == 0
