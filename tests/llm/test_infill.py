"""Fill-in-middle: against a plain version, and the wavelet matrix against counting."""

import hashlib
import random
import re

import numpy as np
import pytest

from conductrisk.llm import infill
from conductrisk.llm.wavelet import WaveletMatrix

SPLIT = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?。！．？]*[\n.!?。！．？]|[^\n.!?。！．？]+",
         "word": r"\S*\s|\S+", "character": r"(?s:.)"}


def plainly(doc_id, text, unit="line", rewritten=100, suffix_first=50):
    text = text or ""
    parts = re.findall(SPLIT[unit], text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rewritten:
        return len(parts), "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return len(parts), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(parts), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rank_counts():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix = WaveletMatrix(symbols, 3)
        at = np.arange(n + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [int((symbols[:i] == s).sum()) for i in at]


@pytest.mark.parametrize("unit", list(infill.UNITS))
def test_equals_plain_version(make, texts, clashing, unit):
    rng = random.Random(2)
    more = ["".join(rng.choice("ab \n.é🙂。") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    marked = ["a<P>b\nc", "x <S", "<", "a<\nb<S\nc", "one\ntwo\n", "\n", "\n\n\n", "no end", "<M>", "Stop. Go! "]
    every = texts + more + marked
    docs = make(every, extra=[*clashing, "'mine' as h1", "'mine' as form", "'mine' as output"])
    found = infill.rewrite(docs, unit, rewritten=80).collect()
    assert len(found) == len(every)
    for r in found:
        want = plainly(r.row.doc_id, every[r.row.doc_id], unit, 80)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
        assert infill.restored(r.form, r.output) == (every[r.row.doc_id] or "") and r.row.form == "mine"


def test_repeated_rows_null_ids_and_empty_table(spark, make):
    text = "a\nb\nc\nd\n"
    found = infill.rewrite(make([text] * 4 + [None], ids=[3, 3, None, None, 9])).collect()
    assert sorted((str(r.row.doc_id), r.output) for r in found) == sorted(
        (str(i), plainly(i, t)[-1]) for i, t in [(3, text)] * 2 + [(None, text)] * 2 + [(9, "")])
    assert infill.rewrite(make([])).collect() == []


def test_long_texts(make):
    """Texts longer than a block, one of them a single line."""
    rng = random.Random(1)
    every = ["".join(rng.choice(["word ", "é\n", "日本 ", "\n"]) for _ in range(900_000)), "y" * 4_200_000, "a\nb\n"]
    found = infill.rewrite(make(every), digests=True).collect()
    assert sorted((r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in found) == [
        (i, *plainly(i, t)[:4], hashlib.sha256(plainly(i, t)[4].encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        for i, t in enumerate(every)]
