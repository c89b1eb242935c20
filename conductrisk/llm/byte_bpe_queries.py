"""Query of the byte-level BPE encoder."""

from __future__ import annotations

import public_tokenizers

from conductrisk.llm import bpe
from conductrisk.llm.rows import load

ORACLES: dict[str, str] = {}


def op7_byte_bpe(spark, sf_dir):
    docs = load(spark, sf_dir).select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, with_ids=False).select(
        "row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
