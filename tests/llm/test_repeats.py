"""Substring dedup and suffix-array dedup against brute force."""

import hashlib

import pytest

from conductrisk.llm import kernels, phrases, stretches, suffixes


def brute(rows, tokens, window, join):
    """{position of the row: (tokens, removed mask)}; earlier means smaller (id, start), a null id first."""
    key = lambda i: -(1 << 63) if i is None else i
    earliest, out = {}, []
    for doc, text in rows:
        t = tokens(text or "")
        for s in range(len(t) - window + 1):
            w = join(t[s:s + window])
            earliest[w] = min(earliest.get(w, (key(doc), s)), (key(doc), s))
    for doc, text in rows:
        t = tokens(text or "")
        gone = [False] * len(t)
        for s in range(len(t) - window + 1):
            if earliest[join(t[s:s + window])] != (key(doc), s):
                gone[s:s + window] = [True] * window
        out.append((doc, text, t, gone))
    return out


def words_expected(rows):
    out = []
    for doc, _, t, gone in brute(rows, lambda x: x.encode().split(), 20, tuple):
        kept = b" ".join(w for w, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def bytes_expected(rows):
    out = []
    for doc, _, t, gone in brute(rows, lambda x: list(x.encode()), 100, bytes):
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select("row.doc_id", *columns).collect()), key=repr)


WORDS = ("n_words", "n_removed", "kept_sha256")
BYTES = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot", [4096, 2])
def test_words_equal_brute_force(make, texts, hot, monkeypatch):
    monkeypatch.setattr(stretches, "HOT", hot)
    rows = list(enumerate(texts))
    assert got(phrases.dedup(make(texts)), *WORDS) == words_expected(rows)


@pytest.mark.parametrize("hot", [4096, 2])
def test_bytes_equal_brute_force(make, texts, hot, monkeypatch):
    monkeypatch.setattr(stretches, "HOT", hot)
    rows = list(enumerate(texts))
    assert got(suffixes.dedup(make(texts)), *BYTES) == bytes_expected(rows)


def test_null_ids_repeated_rows_and_clashing_columns(make, texts, clashing):
    picked = [t for t in texts if t and len(t) > 300][:6]
    rows = [(None, picked[0]), (3, picked[0]), (3, picked[0]), (5, picked[1]), (5, picked[1] + " end"), (2, picked[2]), (9, None)]
    docs = make([t for _, t in rows], [i for i, _ in rows], extra=clashing)
    # rows with one id are one document: a repeated row is not earlier than itself
    assert got(phrases.dedup(docs), *WORDS) == words_expected(rows)
    assert got(suffixes.dedup(docs), *BYTES) == bytes_expected(rows)
    assert {r.kept for r in phrases.dedup(docs).select("row.kept").collect()} == {"mine"}


def test_empty_table(make):
    assert phrases.dedup(make([])).collect() == []
    assert suffixes.dedup(make([])).collect() == []


def test_text_that_is_kept(make):
    first = " ".join(f"w{i}" for i in range(30))
    rows = phrases.dedup(make([first, "new " + first + " tail"])).orderBy("row.doc_id").collect()
    assert [r.kept for r in rows] == [first, "new tail"]
    both = suffixes.dedup(make([first, "x" + first])).orderBy("row.doc_id").collect()
    assert [bytes(r.kept) for r in both] == [first.encode(), b"x"]


def test_radix_groups_are_the_equal_windows():
    import numpy as np
    data = np.frombuffer(b"abcabcabcxabcabc", np.uint8)
    places = np.arange(len(data) - 5)
    index, group = suffixes.radix_groups(data, places, np.zeros(len(places), np.int64), 6)
    found = {}
    for i, g in zip(index, group, strict=True):
        found.setdefault(g, set()).add(bytes(data[i:i + 6]))
    assert all(len(x) == 1 for x in found.values())
    assert {x for s in found.values() for x in s} == {b"abcabc"} | {b"bcabca", b"cabcab"} & set()


def test_automaton_finds_every_occurrence():
    found = [end for end, _ in phrases.automaton_of([(1, 2), (2, 1, 2)]).iter((1, 2, 1, 2, 3, 1, 2))]
    assert found == [1, 3, 3, 6]
    assert phrases.automaton_of([]) is None


def test_equal_windows_have_equal_anchors():
    import numpy as np
    rng = np.random.default_rng(3)
    tokens = kernels.mix(rng.integers(0, 6, 3000).astype(np.uint64))
    runs = kernels.anchored_runs(tokens, np.array([0, 1000, 1000, 3000]), 20, 8)
    of_window = {}
    for first, count, anchor, value in zip(runs.first, runs.count, runs.anchor, runs.value, strict=True):
        for s in range(first, first + count):
            w = tokens[s:s + 20].tobytes()
            assert of_window.setdefault(w, (anchor - s, value)) == (anchor - s, value)
    assert runs.count.sum() == 1000 - 19 + 2000 - 19
