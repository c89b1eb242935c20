"""Spelling variants against a plain version that compares all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from conductrisk.llm import spelling


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plainly(rows, dropped=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % dropped == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if distance_one(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=str)


def of(df):
    return sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()), key=str)


def edits(rng, word, letters):
    kind, at = rng.randrange(3), rng.randrange(len(word) + 1)
    if kind == 0:
        return word[:at] + rng.choice(letters) + word[at:]
    at = min(at, len(word) - 1)
    return word[:at] + (rng.choice(letters) if kind == 1 else "") + word[at + 1:]


@pytest.fixture(scope="module")
def corpus():
    """Words over few letters with many near ones, chains of forms, periodic words and accents."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(7, 10))) for _ in range(25)]
    base += ["aaaaaaaa", "abababab", "abcabcabcabc", "Straßenbahn", "ÀÉÎõü×÷ÿ", "quizzical"]
    chain = ["wonderful"] * 1200 + ["wondrful"] * 80 + ["wondrfuls"] * 4
    words = chain + base * 30 + [edits(rng, w, "abcézq") for w in base * 20] + ["aaaaaaa", "aaaaaaaaa"] * 2
    rng.shuffle(words)
    texts = ["".join(w + rng.choice([" ", ", ", "\n", "1", "漢", "-"]) for w in words[i:i + 40]) for i in range(0, len(words), 40)]
    return [*texts, None, "", "a B c", "WONDERFUL Wonderful wonderfuL"]


@pytest.mark.parametrize("dropped", [31, 2])
def test_equals_plain_version(make, corpus, clashing, dropped):
    docs = make(corpus, extra=[*clashing, "'mine' as word", "'mine' as key"])
    found = of(spelling.grouped(docs, dropped=dropped))
    assert found == plainly(enumerate(corpus), dropped)
    assert dropped == 2 or any(r[3] and r[5] != r[3] for r in found)  # a chain of two forms


def test_hot_word_repeated_rows_and_null_ids(make):
    """One row is a third of the table; null ids hash as the empty text."""
    text = "Spelling speling mistakes mistakse spellings"
    rows = [(7, text)] * 40 + [(None, text)] * 20 + [(i, f"{text} varyingly{'x' * (i % 3)}") for i in range(60)]
    found = spelling.grouped(make([t for _, t in rows], ids=[i for i, _ in rows]))
    assert of(found) == plainly(rows)


def test_shared_rare_bigram(make):
    """A third of the words have the same rare bigram at the same place."""
    rng = random.Random(4)
    tails = {"".join(rng.choice("aeiou") for _ in range(6)) for _ in range(150)}
    words = ["qz" + t for t in sorted(tails)] + ["".join(rng.choice("rstln") for _ in range(8)) for _ in range(300)]
    rows = [(i, " ".join(words)) for i in range(3)]
    assert of(spelling.grouped(make([t for _, t in rows]), dropped=10_007)) == plainly(rows, 10_007)


def test_long_words_and_empty_table(make):
    long = ["ab" * 1500, "ab" * 1500 + "b", "ab" * 700 + "b" + "ab" * 800, "a" * 2000, "a" * 1999, "x" + "a" * 1999,
            "z" * 600_000 + " " + "word " * 900_000]
    rng = random.Random(6)
    for n in (31, 32, 33, 34, 100):
        word = "".join(rng.choice("abc") for _ in range(n))
        long += [word, *(edits(rng, word, "abc") for _ in range(40))]
    texts = long + long + ["é" * 8, "é" * 8]
    found = of(spelling.grouped(make(texts), dropped=10_007))
    assert found == plainly(enumerate(texts), 10_007)
    assert spelling.grouped(make([])).collect() == []
    with pytest.raises(ValueError):
        spelling.grouped(make([]), least=3)


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(3)
    for _ in range(300):
        places = rng.sample(range(12), rng.randint(3, 6))
        prefix = sorted((rng.randrange(9), p) for p in places)
        chosen = spelling.pivots_of(prefix)
        options = [(x[0] + y[0]) for x in prefix for y in prefix if y[1] - x[1] >= 2]
        assert len(chosen) == 2 and abs(chosen[0][1] - chosen[1][1]) >= 2
        assert sum(x[0] for x in chosen) == min(options)
