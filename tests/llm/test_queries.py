"""The registered queries on the smallest tables."""

import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
from conductrisk.llm import bpe
from conductrisk.llm.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.fixture(scope="module")
def documents(con):
    return dict(con.sql("SELECT doc_id, text FROM documents").fetchall())


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == cols
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(tuple(r[i] for i in order) for r in result.fetchall())


def test_folds_and_scores(spark, documents, con):
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    lang = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    found = QUERIES["op4_language_id"](spark, SF).collect()
    assert {r.doc_id for r in found} == set(documents)
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in found)
    assert sum(r.lang_pred == lang[r.doc_id] for r in found if r.held_out) >= 0.9 * sum(r.held_out for r in found)
    found = QUERIES["op10_toxicity"](spark, SF).collect()
    assert {r.doc_id for r in found} == set(documents)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in found)
    found = QUERIES["op9_lm_scoring"](spark, SF).collect()
    assert {r.doc_id for r in found} == set(documents) and all(r.held_out == (fold(r.doc_id, 5) == 1) for r in found)
    found = QUERIES["op1_quality_rules"](spark, SF).collect()
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in found)
    assert all(not r.kept for r in found if r.base_failed) and len(found) == len(documents)


def test_tokens_of_whole_texts(spark, documents):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    found = {r.doc_id: r.n_tokens for r in QUERIES["op7_byte_bpe"](spark, SF).collect()}
    assert found == {i: len(library.encode_ordinary(t or "")) for i, t in documents.items()}


def test_packing_covers_all_documents(spark, documents):
    words = {}
    for r in QUERIES["op6_best_fit_packing"](spark, SF).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
    assert words == {i: len((t or "").encode().split()) for i, t in documents.items()}
