"""Byte-level BPE against the tiktoken library."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from conductrisk.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


ODD = [None, "", " ", "  \n\n \t x", "a" * 700, "ab" * 400, "it's we'll I'D 12345 ---==", "日本語 🙂🙂 ñandú",
       "<|endoftext|>", "\x00\x01​", "repeated", "repeated"]


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    data = library.decode_bytes(ids)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(data).hexdigest()


def test_equal_to_the_library(make, texts, library, clashing):
    every = [*texts, *ODD]
    rows = bpe.encode(make(every, extra=clashing), PATH, public_tokenizers.PATTERN).orderBy("row.doc_id").collect()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows] == [expected(library, t) for t in every]
    assert [r.ids for r in rows] == [library.encode_ordinary(t or "") for t in every]
    assert [bytes(r.decoded) for r in rows] == [(t or "").encode() for t in every]
    assert rows[0]["row"].ids == "mine"


def test_small_batches_and_a_full_cache(monkeypatch, library, texts):
    monkeypatch.setattr(bpe, "BATCH_ROWS", 50)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 60)
    coder = bpe.Codec(PATH, public_tokenizers.PATTERN)
    for text in [t for t in texts if t][:12]:
        parts = coder.pieces(text)
        coder.learn(set(parts))
        assert [i for x in parts for i in np.frombuffer(coder.known[x], "<u4")] == library.encode_ordinary(text)


def test_decoder_restores_bytes_that_are_no_text():
    """The decoder joins ids with the vocabulary; it does not look at the input."""
    coder = bpe.Codec(PATH, public_tokenizers.PATTERN)
    coder.con.execute("CREATE TABLE encoded AS SELECT 0 AS piece, [220, 262, 50255]::INTEGER[] AS ids")
    back = {rank: token for token, rank in bpe.read_ranks(PATH).items()}
    assert bytes.fromhex(coder.con.execute(bpe._DECODE).fetchall()[0][1]) == back[220] + back[262] + back[50255]
    coder.changed = {"x": b"\xff"}
    assert coder.decoded(["x", "é"]) == b"\xff" + "é".encode()


def test_empty_table(make):
    assert bpe.encode(make([]), PATH, public_tokenizers.PATTERN).collect() == []
    assert duckdb.__version__
